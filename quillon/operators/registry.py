"""Companies and securities looked up in a registry by codes and names. Every step is a join by equal keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import products, similar
from quillon.operators.text import name_key, stock_code


def _tagged(kind: str, key: Column, how: str, rank: int, score: float) -> Column:
    """A probe of a query: the kind of key and the key (null: none), and what a hit is called."""
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(how).alias("how"), F.lit(rank).alias("rank"), F.lit(score).alias("score"))


def _keys(kind: str, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"))


def identify(queries: DataFrame, query: str, registry: DataFrame, cutoff: float | None = None) -> DataFrame:
    """``queries`` with ``code``, ``how`` and ``score``: the row of the registry (``code, isin, corp, name_kr, name_en``, one row
    per code) that the text of ``query`` stands for, by the first rule that finds one: ticker, RIC, ISIN, ISIN with its check
    digit mended, eight-digit number, code of up to six digits, unique end of a code, exact name, a spelling of a name, or all
    words of the query among those of a name (the name with the fewest words wins). Of rows that a rule finds alike the smallest
    code is taken; null where no rule does. Words that very many names share don't multiply the rows (see ``_by_words``). With a ``cutoff`` (0.8 or more), what is left takes the name with the most
    similar spelling (``similar``: one minus edit distance over length; of equally similar names the first in order)."""
    q = F.trim(F.col("__q"))
    asked = queries.select(F.col(query).alias("__q")).where("length(trim(__q)) > 0").distinct()
    code = lambda pattern: F.nullif(F.regexp_extract(q, pattern, 1), F.lit(""))
    plain = F.replace(q, F.lit(" "), F.lit(""))
    number = F.when(plain.rlike("^[0-9]{1,6}$"), plain)
    probes = F.array(
        _tagged("code", code(r"(?i)^(\d{6})\s+(?:KS|KQ|KX)\s+(?:Equity|Index)?$"), "ticker", 1, 1.0),
        _tagged("code", code(r"(?i)^(\d{6})\.(?:KS|KQ|KX|KN)$"), "ric", 2, 1.0),
        _tagged("isin", F.when(q.rlike("(?i)^KR.{10}$"), F.upper(q)), "isin", 3, 1.0),
        _tagged("isin", F.when(q.rlike("(?i)^KR[A-Z0-9]{10}$"), products.isin_fixed(F.upper(q))), "isin_fixed", 4, 0.85),
        _tagged("corp", F.when(q.rlike("^[0-9]{8}$"), q), "corp", 5, 1.0),
        _tagged("code", F.lpad(number, 6, "0"), "code", 6, 1.0),
        _tagged("end", number, "code_end", 7, 0.9),
        _tagged("name_kr", F.nullif(products.letters_only(q), F.lit("")), "name", 8, 0.97),
        _tagged("name", F.get(products.name_variants(q), F.lit(0)), "spelling", 9, 0.95),
        _tagged("name", F.get(products.name_variants(q), F.lit(1)), "spelling", 10, 0.95),
    )
    held = F.array(
        _keys("code", F.col("code")), _keys("isin", F.upper("isin")), _keys("corp", F.col("corp")), _keys("name_kr", products.letters_only(F.col("name_kr"))),
        _keys("name", F.get(products.name_variants(F.col("name_en")), F.lit(0))), _keys("name", F.get(products.name_variants(F.col("name_en")), F.lit(1))),
    )
    known = registry.select("code", F.explode(held).alias("k")).select("code", "k.*").where("length(key) > 0").groupBy("kind", "key").agg(F.min("code").alias("code"))
    ends = registry.select("code", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: F.right(F.col("code"), n))).alias("key"))
    ends = ends.groupBy("key").agg(F.min("code").alias("code"), F.count("*").alias("n")).where("n = 1").select(F.lit("end").alias("kind"), "key", "code")
    tried = asked.select("__q", F.explode(probes).alias("p")).select("__q", "p.*").where("key IS NOT NULL")
    hits = tried.join(known.unionByName(ends), ["kind", "key"])
    first = hits.groupBy("__q").agg(F.min(F.struct("rank", "code", "how", "score")).alias("__hit")).select("__q", "__hit.code", "__hit.how", "__hit.score")
    rest = asked.join(first, "__q", "left_anti")
    found = first.unionByName(_by_words(rest, registry))
    if cutoff is not None:
        found = found.unionByName(_by_spelling(asked.join(found, "__q", "left_anti"), registry, cutoff))
    return queries.join(found, F.col(query) == F.col("__q"), "left").drop("__q")


def _word_pairs(words: str) -> Column:
    """Each two words of a sorted array, with a space between them."""
    x = F.col(words)
    first = F.when(F.size(x) > 1, F.sequence(F.lit(1), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(first, lambda i: F.transform(F.slice(x, i + 1, F.size(x)), lambda y: F.concat(F.get(x, i - 1), F.lit(" "), y))))


def _by_words(rest: DataFrame, registry: DataFrame) -> DataFrame:
    """The name with the fewest words among those that have all words of the query. Queries of one and of two words meet a table that
    holds only the best name of each word and each pair; longer ones meet the names of the pair of their two rarest words, whose
    other words are then compared. So common words don't multiply queries by names; a name has a row for each pair of its words."""
    names = registry.select("code", F.sort_array(products.token_set(F.col("name_en"))).alias("__has"))
    held = names.select("code", "__has", F.size("__has").alias("size"), F.explode(F.concat("__has", _word_pairs("__has"))).alias("k"))
    best = held.groupBy("k").agg(F.min(F.struct("size", "code")).alias("b"))
    asked = rest.select("__q", F.sort_array(products.token_set(F.col("__q"))).alias("__wants")).where("size(__wants) > 0").withColumn("n", F.size("__wants"))
    short = asked.where("n <= 2").join(best, F.array_join("__wants", " ") == F.col("k")).select("__q", "n", "b")
    common = held.where("instr(k, ' ') = 0").groupBy("k").agg(F.count("*").alias("often")).withColumnRenamed("k", "w")
    counted = asked.where("n > 2").select("__q", "__wants", "n", F.explode("__wants").alias("w")).join(common, "w").groupBy("__q", "__wants", "n").agg(F.sort_array(F.collect_list(F.struct("often", "w"))).alias("ws"))
    rare = F.array_join(F.sort_array(F.transform(F.slice("ws", 1, 2), lambda x: x["w"])), " ")
    tried = counted.where("size(ws) = n").withColumn("p", rare).join(held, F.col("p") == F.col("k")).where(F.size(F.array_except("__wants", "__has")) == 0)
    long = tried.groupBy("__q", "n").agg(F.min(F.struct("size", "code")).alias("b"))
    share, several = F.col("n") / F.col("b.size"), F.col("n") >= 2
    return short.unionByName(long).select("__q", "b.code", F.when(several, "words").otherwise("word").alias("how"), F.round(F.when(several, 0.85).otherwise(0.78) + 0.1 * share, 3).alias("score"))


def _by_spelling(rest: DataFrame, registry: DataFrame, cutoff: float) -> DataFrame:
    """The names of the registry in all their spellings against those of the queries."""
    spelt = lambda df, names, key: df.select(key, F.explode(F.concat(*(F.coalesce(products.name_variants(F.col(x)), F.array().cast("array<string>")) for x in names))).alias("__s"))
    known = spelt(registry, ["name_en", "name_kr"], "code").where("length(__s) > 0").groupBy("__s").agg(F.min("code").alias("code"))
    asked = spelt(rest, ["__q"], "__q")
    near = similar.closest(asked, "__s", known, "__s", cutoff)
    best = asked.join(near, F.col("__s") == F.col("a")).groupBy("__q").agg(F.min(F.struct((-F.col("ratio")).alias("o"), F.col("b"))).alias("x"))
    return best.select("__q", F.col("x.b").alias("__s"), (-F.col("x.o")).alias("ratio")).join(known, "__s").select("__q", "code", F.lit("similar").alias("how"), F.round("ratio", 3).alias("score"))


def _pieces(name: str, ratio: float = 0.5) -> Column:
    """Hashes of the strings inside a name, shorter than it, that may count as a match: its beginnings and ends, and what is
    inside with at least ``ratio`` of its length."""
    n, x = F.length(name), F.col(name)
    sizes = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array())
    outer = F.flatten(F.transform(sizes, lambda k: F.array(F.xxhash64(F.left(x, k)), F.xxhash64(F.right(x, k)))))
    long = F.filter(sizes, lambda k: k >= n * ratio)
    inner = F.flatten(F.transform(long, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.substring(x, i, k)))))
    return F.array_distinct(F.concat(outer, inner))


def candidates(names: DataFrame, name: str, registry: DataFrame) -> DataFrame:
    """``name, code, how, rank``: every row of the registry (``code, reg_name, listed, modified``) whose normalised name equals
    the normalised name (exact), or holds it or is held by it (partial: at the beginning or end, or inside with at least half
    of the longer one's length). Ranks of a name: listed ones first, then the latest modified, then the smallest code. By this
    rule a name of one letter is a candidate of all that begin or end with it: rows are as many as there are such pairs."""
    asked = names.select(F.col(name).alias("__n"), name_key(F.col(name)).alias("__k")).where("length(__k) > 0").distinct()
    kept = registry.select("code", "listed", "modified", name_key(F.col("reg_name")).alias("__r")).where("length(__r) > 0")
    keys, regs = asked.select("__k").distinct(), kept.select("__r").distinct()
    same = keys.join(regs, F.col("__k") == F.col("__r")).withColumn("how", F.lit("exact"))
    held = keys.withColumn("__p", F.explode(_pieces("__k"))).join(regs.withColumn("__p", F.xxhash64("__r")), "__p").where(F.contains("__k", "__r"))
    holds = regs.withColumn("__p", F.explode(_pieces("__r"))).join(keys.withColumn("__p", F.xxhash64("__k")), "__p").where(F.contains("__r", "__k"))
    parts = held.select("__k", "__r").unionByName(holds.select("__k", "__r")).withColumn("how", F.lit("partial"))
    w = W.partitionBy("__n").orderBy(F.desc("listed"), F.desc_nulls_last("modified"), "code")
    each = asked.join(same.unionByName(parts), "__k").join(kept, "__r").groupBy("__n", "code").agg(F.min("how").alias("how"), F.max("listed").alias("listed"), F.max("modified").alias("modified"))
    return each.select(F.col("__n").alias(name), "code", "how", F.row_number().over(w).alias("rank"))


def match_registry(names: DataFrame, name: str, anchor: str, registry: DataFrame) -> DataFrame:
    """``names`` with ``code`` and ``how``: by the stock code in ``anchor`` (``anchor``), an equal normalised name (``exact``), or
    the candidate with the longest common extent (``partial``: the longer one of name and registry name is the longest); ``none``
    without any. ``registry`` has ``code, reg_name, stock, listed, modified``."""
    by_stock = registry.where("stock IS NOT NULL").groupBy("stock").agg(F.min("code").alias("__anchor"))
    anchored = names.withColumn("__stock", F.coalesce(stock_code(F.col(anchor)), F.lpad(F.nullif(F.trim(anchor), F.lit("")), 6, "0"))).join(by_stock, F.col("__stock") == F.col("stock"), "left").drop("stock", "__stock")
    rest = anchored.where("__anchor IS NULL").select(name)
    extent = F.greatest(F.length(name_key(F.col(name))), F.length(name_key(F.col("reg_name"))))
    tried = candidates(rest, name, registry).join(registry.select("code", "reg_name"), "code").withColumn("__x", extent)
    order = F.struct(F.when(F.col("how") == "exact", 0).otherwise(1).alias("a"), (-F.col("__x")).alias("b"), F.col("code"))
    best = tried.groupBy(F.col(name).alias("__n")).agg(F.min(F.struct(order.alias("o"), F.col("code"), F.col("how"))).alias("__b"))
    out = anchored.join(best, F.col(name) == F.col("__n"), "left")
    how = F.when(F.col("__anchor").isNotNull(), "anchor").otherwise(F.coalesce("__b.how", F.lit("none")))
    return out.withColumn("code", F.coalesce("__anchor", "__b.code")).withColumn("how", how).drop("__anchor", "__b", "__n")


def search(registry: DataFrame, columns: list[str], text: str, limit: int = 10) -> DataFrame:
    """The first ``limit`` codes of the registry with the text in one of the columns, letters and digits only."""
    wanted = "".join(c for c in text.lower() if c.isascii() and c.isalnum() or "가" <= c <= "힣")
    if not wanted:
        return registry.limit(0)
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(products.letters_only(F.col(c)), F.lit(wanted)), F.lit(False))
    return registry.where(found).dropDuplicates(["code"]).orderBy("code").limit(limit)


def related(codes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``code, relation, other``: the preferred shares of each common share and the common share of each preferred one;
    ``pairs`` has ``common, preferred``."""
    pairs = pairs.dropna(subset=["common", "preferred"])
    down = codes.select("code").join(pairs, F.col("code") == F.col("common")).select("code", F.lit("preferred_of").alias("relation"), F.col("preferred").alias("other"))
    up = codes.select("code").join(pairs, F.col("code") == F.col("preferred")).select("code", F.lit("common_of").alias("relation"), F.col("common").alias("other"))
    return down.unionByName(up)


def keyword_companies(keywords: DataFrame, keyword: str, companies: DataFrame, company: str, brands: DataFrame, names: list[str]) -> DataFrame:
    """``keywords`` with ``company``: the company of that name, or the one whose brand has that name in any of ``names`` (a
    brand's name goes before a company's; the greatest company of brands that share one)."""
    own = companies.select(F.trim(company).alias("__w"), F.col(company).alias("__c"), F.lit(0).alias("__r"))
    for n in names:
        own = own.unionByName(brands.select(F.trim(n).alias("__w"), F.col(company).alias("__c"), F.lit(1).alias("__r")))
    words = own.where("length(__w) > 0").groupBy("__w").agg(F.max(F.struct("__r", "__c")).alias("__m")).select("__w", F.col("__m.__c").alias("company"))
    return keywords.join(words, F.col(keyword) == F.col("__w"), "left").drop("__w")
