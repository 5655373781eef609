"""What companies belong to: sectors by industry code, largest shareholders, parents of parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.ranks import settled
from quillon.operators.text import isin_check_digit


def _first_hit(df: DataFrame, column: str, probes: Column, known: DataFrame, values: list[str]) -> DataFrame:
    """``df`` with ``values`` of the first probe (array of kind, key, rank) of its trimmed ``column`` that ``known`` (kind, key) has."""
    names = df.select(F.trim(column).alias("__s")).where("length(__s) > 0").distinct()
    tried = names.select("__s", F.explode(probes).alias("p")).select("__s", "p.*").where("key IS NOT NULL")
    hits = tried.join(known, ["kind", "key"])
    best = hits.groupBy("__s").agg(F.min_by(F.struct(*values), "rank").alias("__v")).select("__s", *(F.col(f"__v.{v}").alias(v) for v in values))
    return df.join(best, F.trim(column) == F.col("__s"), "left").drop("__s")


def _probe(rank: int, kind: str, key: Column) -> Column:
    return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), key.alias("key"))


def industry_by_prefix(df: DataFrame, column: str, learned: DataFrame, builtin: DataFrame) -> DataFrame:
    """``df`` with ``industry`` of the industry codes in ``column``: the code itself among the ``learned`` ones (``code, industry``), else the
    longest of its first 6, 4, 3 and 2 digits among the ``builtin`` ones, else of its first 4, 3 and 2 among the learned. Codes that
    aren't digits have none; of rows with one code the first industry in order counts."""
    s = F.col("__s")
    cut = lambda n: F.when(s.rlike("^[0-9]+$"), F.left(s, F.lit(n)))
    probes = F.array(_probe(0, "learned", F.when(s.rlike("^[0-9]+$"), s)), *(_probe(1 + i, "builtin", cut(n)) for i, n in enumerate((6, 4, 3, 2))), *(_probe(9 + i, "learned", cut(n)) for i, n in enumerate((4, 3, 2))))
    one = lambda t, kind: t.where("code IS NOT NULL").groupBy(F.col("code").alias("key")).agg(F.min("industry").alias("industry")).withColumn("kind", F.lit(kind))
    return _first_hit(df, column, probes, one(learned, "learned").unionByName(one(builtin, "builtin")), ["industry"])


def sector_by_division(df: DataFrame, column: str, details: DataFrame, ranges: DataFrame, letters: DataFrame, other: str = "Unclassified") -> DataFrame:
    """``df`` with ``sector`` of the industry codes in ``column``: by the first two digits among ``details`` (``division, sector``), else by the
    range (``low, high, sector``; ranges don't overlap) that holds their number, else by the first letter among ``letters`` (``letter,
    sector``), else ``other``. A division finds its range as of its number: ranges and divisions lie in one order, and the last range
    begun before a division is the one that may hold it."""
    s = F.col("__s")
    division = F.when(s.rlike("^[0-9]{2,}$"), F.left(s, F.lit(2)))
    numbers = df.select(F.trim(column).alias("__s")).select(division.alias("d")).where("d IS NOT NULL").distinct()  # a hundred at most
    line = numbers.select(F.col("d").cast("int").alias("at"), F.lit(1).alias("side"), "d", F.lit(None).cast("int").alias("high"), F.lit(None).cast("string").alias("sector"))
    line = line.unionByName(ranges.select(F.col("low").cast("int").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("d"), F.col("high").cast("int").alias("high"), "sector"))
    begun = F.last(F.when(F.col("side") == 0, F.struct("high", "sector")), ignorenulls=True).over(W.partitionBy(F.lit(0)).orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0))
    held = line.withColumn("r", begun).where("side = 1 AND r.high >= at").select(F.lit("range").alias("kind"), F.col("d").alias("key"), "r.sector")
    known = held.unionByName(details.where("division IS NOT NULL").groupBy(F.col("division").cast("string").alias("key")).agg(F.min("sector").alias("sector")).withColumn("kind", F.lit("detail")))
    known = known.unionByName(letters.groupBy(F.upper("letter").alias("key")).agg(F.min("sector").alias("sector")).withColumn("kind", F.lit("letter")))
    probes = F.array(_probe(0, "detail", division), _probe(1, "range", division), _probe(2, "letter", F.upper(F.left(s, F.lit(1)))))
    return _first_hit(df, column, probes, known, ["sector"]).withColumn("sector", F.coalesce("sector", F.lit(other)))


# Parts of names that make a short Korean name a company's, and what shareholders of some kinds are called.
COMPANY_PARTS = ("산업", "기업", "그룹", "홀딩스", "제약", "화학", "식품", "전자", "통신", "은행", "증권", "카드", "건설", "에너지", "바이오", "공사", "공단", "재단", "협회", "유한회사", "주식회사")
PENSION, INDIVIDUAL, LISTED = "NATIONAL_PENSION_SERVICE", "N/A (Individual)", "KOSPI / KOSDAQ"


def largest_shareholders(df: DataFrame, column: str, master: DataFrame) -> DataFrame:
    """``df`` with ``holder_en, holder_status, holder_isin`` and ``holder_source`` of the shareholders named in ``column``: the national pension; a
    company of ``master`` (``name, name_en, stock, code``) with that name; one whose name begins or ends with it (both of three letters or
    more, the shorter at least half as long); a person (two to four Hangul letters without a company's part); else as named. Of
    several companies listed ones go first, then the smallest code. Null and blank names have none of it."""
    s, n = F.col("__s"), F.col("__n")
    names = df.select(F.trim(column).alias("__s")).where("length(__s) > 0").distinct()
    firms = master.select(F.trim("name").alias("__n"), "name_en", F.nullif(F.trim("stock"), F.lit("")).alias("stock"), "code").where("length(__n) > 0")
    equal = names.join(firms, s == n).withColumn("how", F.lit(0))
    sizes = F.sequence(F.ceil(F.length("__n") / 2).cast("int"), F.length("__n") - 1)
    ends = F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.array(F.left(n, k), F.right(n, k)))))
    part = firms.where("length(__n) >= 3").withColumn("__e", F.explode(F.filter(ends, lambda e: F.length(e) >= 3)))
    part = names.join(part, s == F.col("__e")).drop("__e").withColumn("how", F.lit(1))
    order = F.struct("how", F.col("stock").isNull().alias("unlisted"), "code")
    best = equal.unionByName(part).groupBy("__s").agg(F.min_by(F.struct("how", "name_en", "stock", "code"), order).alias("m"))
    out = df.withColumn("__x", F.trim(column)).join(best, F.col("__x") == s, "left")
    x = F.col("__x")
    pension = F.contains(x, F.lit("국민연금")) | F.contains(F.upper(x), F.lit("NPS"))
    person = x.rlike("^[가-힣]{2,4}$") & ~x.rlike("|".join(COMPANY_PARTS))
    body = F.concat(F.lit("KR7"), F.col("m.stock"), F.lit("00"))
    listed = F.col("m.stock").rlike("^[0-9]{6}$")
    found, there = F.col("m").isNotNull(), F.length(x) > 0
    pick = lambda pension_, firm, person_, rest: F.when(there, F.when(pension, pension_).when(found, firm).when(person, person_).otherwise(rest))
    none = F.lit("")
    return out.withColumns({
        "holder_en": pick(F.lit(PENSION), F.coalesce(F.nullif(F.upper(F.trim("m.name_en")), F.lit("")), x), x, x), "holder_status": pick(F.lit("N/A"), F.when(listed, F.lit(LISTED)).otherwise(none), F.lit(INDIVIDUAL), none),
        "holder_isin": pick(F.lit("N/A"), F.when(listed, F.concat(body, isin_check_digit(body).cast("string"))).otherwise(none), F.lit("N/A"), none),
        "holder_source": pick(F.lit("institution"), F.when(F.col("m.how") == 0, "exact").otherwise("prefix_suffix"), F.lit("individual"), F.lit("unmatched")),
    }).drop("__x", "__s", "m")


def subsidiary_status(parent: Column, isin: Column, kind: Column) -> Column:
    """The listing status of a company with a parent: what it is, and the parent's name and ISIN; without a parent not listed."""
    what = F.when(kind == "delisted", "Delisted").when(kind == "international", "Internationally Listed").otherwise("Subsidiary")
    named = F.concat(what, F.lit(" (subsidiary of "), F.trim(parent), F.when(F.length(F.trim(isin)) > 0, F.concat(F.lit(" - "), F.trim(isin))).otherwise(""), F.lit(")"))
    return F.when(F.length(F.trim(parent)) > 0, named).otherwise("Not listed")


def ultimate_parents(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """``child, root, depth`` from edges of one parent per child (of several the smallest): the parent that has none itself, and how many
    steps away it is. Those that lead into a circle have null in both. Every round joins each child's ancestor with that one's
    own, which doubles the reach; it ends when a round finishes no further child, as circles never do."""
    one = edges.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).groupBy(F.col(child).alias("child")).agg(F.min(parent).alias("up"))
    inner = one.select(F.col("child").alias("up"), F.lit(True).alias("open"))
    now = one.join(inner, "up", "left").select("child", "up", F.lit(1).cast("long").alias("depth"), F.coalesce("open", F.lit(False)).alias("open"))
    now = settled(now)
    left = now.where("open").count()
    while left:
        ahead = now.select(F.col("child").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"), F.col("open").alias("still"))
        now = settled(now.join(ahead, "up", "left").select("child", F.coalesce("far", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("still", F.lit(False)).alias("open")))
        before, left = left, now.where("open").count()
        if left == before:
            break
    return now.select("child", F.when(~F.col("open"), F.col("up")).alias("root"), F.when(~F.col("open"), F.col("depth")).alias("depth"))

