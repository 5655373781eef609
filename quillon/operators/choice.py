"""Candidates for a universe of companies: scores from size, place in the sub-sector, segment and listing, a selection with a watch list
and pins, segments and themes worth a closer look, and the state of series at their last day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.panels import min_max, representativeness
from quillon.operators.ranks import positions, settled
from quillon.operators.universe import DEEP_SEGMENTS, HEAT_HIGH, OPPORTUNITY_HIGH

# Parts of a candidate's score, priority of segments (0.3 for others), sizes of universe and watch list.
PARTS = {"size": 0.40, "sector_rep": 0.25, "segment_score": 0.20, "listed_score": 0.15}
SEGMENTS = {
    "ramen": 1.0, "alcohol": 0.9, "snack": 0.8, "beverage": 0.7, "dairy": 0.6, "processed": 0.6, "fresh": 0.5, "bakery": 0.5, "health_food": 0.45, "seafood": 0.4, "meat": 0.4,
    "flour": 0.3, "food_service": 0.3, "food_distribution": 0.3, "holding": 0.2,
}
OTHER_SEGMENT = 0.3
CHOSEN, WATCHED = 20, 10
# What a spicy keyword holds, and the momentum from which a keyword is hot.
SPICY = ("불닭", "매운", "마라", "spicy", "buldak", "hot", "mala")
HOT = 0.2


def _rounded(x: Column, digits: int) -> Column:
    """``x`` rounded as the double that it is: 16384.045 lies below its half, though its shortest text ends in one."""
    return F.round(x * 10**digits) / 10**digits


def score_candidates(candidates: DataFrame, caps: DataFrame) -> DataFrame:
    """``candidates`` (``company, code, listed, segment, sub_sector``) with ``cap``, the parts of the score, ``score`` (0 to 100) and ``rank``
    (equal scores by company, then code). ``caps`` has ``code, cap``; of several the greatest counts, missing ones are 0. Size is the logarithm of the
    cap from the least to the greatest; where no candidate has a cap, listing takes its place (0.5 or 0)."""
    cap = caps.groupBy("code").agg(F.max("cap").cast("double").alias("cap"))
    rows = candidates.withColumn("listed", F.coalesce("listed", F.lit(False))).join(cap, "code", "left").withColumn("cap", F.coalesce("cap", F.lit(0.0)))
    rows = settled(rows)
    known = rows.agg((F.coalesce(F.sum("cap"), F.lit(0.0)) > 0).alias("__known"))  # one row
    rows = min_max(rows.withColumn("__log", F.log1p("cap")), "__log", "size").join(F.broadcast(known))
    alone = F.when(F.col("listed"), 0.5).otherwise(0.0)
    rows = rows.withColumns({"size": F.when(F.col("__known"), F.col("size")).otherwise(alone), "__by": F.when(F.col("__known"), F.col("cap")).otherwise(alone)})
    rows = representativeness(rows, "sub_sector", [F.desc("__by"), F.asc("company"), F.asc("code")])
    priority = F.create_map(*(F.lit(x) for pair in SEGMENTS.items() for x in pair))
    segment = F.coalesce(F.try_element_at(priority, F.coalesce("segment", F.lit(""))), F.lit(OTHER_SEGMENT))
    rows = rows.withColumns({"segment_score": segment, "listed_score": F.when(F.col("listed"), 1.0).otherwise(0.0)})
    score = _rounded(100 * sum((weight * F.col(c) for c, weight in PARTS.items()), F.lit(0.0)), 1)
    ranked = positions(settled(rows.withColumn("score", score)), "score", ["company", "code"])
    return ranked.withColumnRenamed("pos", "rank").drop("__log", "__known", "__by", "rnk", "run")


def _reason() -> Column:
    """What speaks for a candidate, in words."""
    code = F.coalesce(F.col("code"), F.lit(""))
    listed = F.when(F.col("listed"), F.when(code != "", F.concat(F.lit("listed ("), code, F.lit(")"))).otherwise("listed")).otherwise("unlisted")
    given = lambda c, text: F.when(F.trim(c) != "", text)
    place = given("sub_sector", F.concat("sub_sector", F.lit(" place "), F.round("sector_rep", 2).cast("string")))
    cap = F.when(F.col("cap") > 0, F.concat(F.lit("cap "), _rounded(F.col("cap") / 1e12, 2).cast("decimal(18,2)").cast("string"), F.lit("T")))
    return F.concat_ws(", ", listed, place, given("segment", F.concat(F.lit("segment "), "segment")), cap, F.concat(F.lit("score "), F.col("score").cast("string")))


def select_universe(scored: DataFrame, n: int = CHOSEN, watch: int = WATCHED, listed_only: bool = False, pins: DataFrame | None = None) -> DataFrame:
    """``scored`` with ``status`` (selected: the first ``n`` by rank, listed ones alone with ``listed_only``; watch: the next ``watch`` of all others;
    excluded), ``pinned`` and ``reason``. ``pins`` (``company, status``) hold an analyst's decisions, which replace the status;
    of several for a company the greatest counts, blank ones change nothing. Pins don't move others up or down."""
    scored = settled(scored)
    first = scored.where("listed") if listed_only else scored
    chosen = first.orderBy("rank").limit(n).select("rank", F.lit("selected").alias("status"))
    chosen = settled(chosen)
    others = scored.join(F.broadcast(chosen), "rank", "left_anti").orderBy("rank").limit(watch)  # n rows
    found = chosen.unionByName(others.select("rank", F.lit("watch").alias("status")))
    out = scored.join(F.broadcast(found), "rank", "left")  # n + watch rows
    status, pinned = F.coalesce("status", F.lit("excluded")), F.lit(False)
    if pins is not None:
        given = pins.where("trim(status) <> ''").groupBy("company").agg(F.max(F.trim("status")).alias("__pin"))
        out = out.join(given, "company", "left")
        status, pinned = F.coalesce("__pin", status), F.col("__pin").isNotNull()
    return out.withColumns({"status": status, "pinned": pinned, "reason": _reason()}).drop("__pin")


def segment_notes(scored: DataFrame) -> DataFrame:
    """``segment, heat, n, deep, note`` from rows with ``segment, heat``: the mean heat of each segment (null segments are left out) and
    whether its products are worth a look."""
    sums = scored.where("segment IS NOT NULL").groupBy("segment").agg(F.avg("heat").alias("heat"), F.count("*").alias("n")).withColumn("deep", F.col("segment").isin(*DEEP_SEGMENTS))
    note = F.when(F.col("heat").isNull(), "no signals").when(F.col("deep") & (F.col("heat") >= HEAT_HIGH), "deep dive first").when(F.col("deep"), "fit for deep dives").otherwise("companies and brands suffice")
    return sums.withColumn("note", note)


def trend_packages(trends: DataFrame, markers: tuple[str, ...] = SPICY, top: int = 5) -> DataFrame:
    """``theme, drivers, n``: the ``top`` hot keywords by momentum (equal ones by keyword) that hold one of ``markers`` in any case, and of all;
    none without such keywords. ``trends``: ``keyword, momentum``; of repeated keywords the greatest momentum counts."""
    hot = trends.groupBy("keyword").agg(F.max("momentum").alias("m")).where(F.col("m") > HOT).where("keyword IS NOT NULL")
    spicy = F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower("keyword"), m))
    best = lambda df, theme: df.orderBy(F.desc("m"), "keyword").limit(top).withColumn("theme", F.lit(theme))
    rows = best(hot.where(spicy), "spicy").unionByName(best(hot, "rising"))
    words = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "keyword"))), lambda x: x.keyword)  # top rows
    return rows.groupBy("theme").agg(F.array_join(words, ", ").alias("drivers"), F.count("*").alias("n"))


def with_reasons(recommended: DataFrame) -> DataFrame:
    """``recommended`` (``universe.recommendations``) with ``why``: what the action rests on, in words, with heat and opportunity to two digits."""
    two = lambda c: F.round(c, 2).cast("decimal(18,2)").cast("string")
    heat, segment = F.concat(F.lit("heat "), two("heat")), F.coalesce(F.col("segment"), F.lit("no segment"))
    gap = F.when(F.col("opportunity") >= OPPORTUNITY_HIGH, F.concat(F.lit("uncertain consensus "), two("opportunity")))
    why = (
        F.when(F.col("action") == "collect data", "no outside signals")
        .when(F.col("action") == "deep dive", F.concat_ws(", ", heat, F.concat(segment, F.lit(" fits deep dives")), F.lit("listed"), gap))
        .when(F.col("action") == "brand tracker", F.concat_ws(", ", heat, F.lit("listed"), F.concat(segment, F.lit(" is not for deep dives"))))
        .when(F.col("action") == "watch unlisted", F.concat_ws(", ", heat, F.lit("unlisted")))
        .when(F.col("action") == "consensus gap", gap)
        .otherwise(F.concat(heat, F.lit(", nothing special")))
    )
    return recommended.withColumn("why", why)


def recommendation_summary(rows: DataFrame) -> DataFrame:
    """One row from ``status, confidence`` of recommendations: how many there are, how many have signals and of each confidence, and
    which signals nobody has."""
    has = lambda part: F.coalesce(F.bool_or(F.array_contains(F.split("status", ","), part)), F.lit(False))
    lacks = F.concat_ws(",", F.when(F.count_if(F.col("status") != "none") < F.count("*"), "some without signals"), F.when(~has("trend"), "no trends"), F.when(~has("consensus"), "no consensus"))
    level = lambda x: F.count_if(F.col("confidence") == x).alias(x)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("status") != "none").alias("with_signal"), level("high"), level("medium"), level("low"), lacks.alias("lacks"))


def snapshots(series: DataFrame, means: tuple[int, ...] = (5, 20, 60, 200), changes: tuple[int, ...] = (1, 5, 20, 60)) -> DataFrame:
    """A row a key from ``key, day, value``: its last two values, means of the last rows (null unless there are as many) and changes in
    percent over rows (null without such a row, and from 0). Null values count for nothing; keys with under two are left out. Only the
    last rows of a key are kept after its window."""
    rows = series.where("value IS NOT NULL AND NOT isnan(value)").withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("day"))))
    rows = rows.where(F.col("r") <= max(*means, *(c + 1 for c in changes), 2))
    at = lambda i: F.max(F.when(F.col("r") == i, F.col("value")))
    mean = lambda k: F.when(F.count("*") >= k, F.avg(F.when(F.col("r") <= k, F.col("value")))).alias(f"ma{k}")
    change = lambda k: (100 * (at(1) / F.nullif(at(k + 1), F.lit(0.0)) - 1)).alias(f"pct{k}")
    out = rows.groupBy("key").agg(F.max("day").alias("day"), at(1).alias("last"), at(2).alias("prev"), *map(mean, means), *map(change, changes))
    return out.where("prev IS NOT NULL")
