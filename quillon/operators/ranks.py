"""Exact ranks, running sums and percentiles over whole tables, without a window that puts the table into one task.

Rows are dealt into steps of magnitude (`magnitude`: about half a percent wide, so at most some 284,000 steps whatever the
data). Counts and sums per step are small; their running totals are added to what a window within each step gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEPS = 200
_NULLS = -(2**62)


def magnitude(x: Column) -> Column:
    """A whole number that never falls as ``x`` grows; nulls are below everything."""
    return F.coalesce(F.floor(F.signum(x) * F.log1p(F.abs(x)) * STEPS), F.lit(_NULLS))


def positions(df: DataFrame, value: str, ties: list[str], descending: bool = True, step: Column | None = None) -> DataFrame:
    """``df`` with ``pos`` (from 1, equal values by ``ties``), ``rnk`` (equal values share the least position) and ``run``,
    the sum of ``value`` up to the row. Nulls come last in descending order and first in ascending order. ``step`` may replace
    the magnitude, if it never falls as the value grows."""
    way = F.desc if descending else F.asc
    steps = df.withColumn("__b", magnitude(F.col(value)) if step is None else step)
    before = W.orderBy(way("__b")).rowsBetween(W.unboundedPreceding, -1)
    sums = steps.groupBy("__b").agg(F.count("*").alias("__n"), F.sum(value).alias("__s"))
    starts = sums.select("__b", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("__n", "__s")))
    inner = W.partitionBy("__b").orderBy(way(value), *ties)
    placed = steps.join(starts, "__b").withColumns(
        {
            "pos": F.col("__n") + F.row_number().over(inner),
            "rnk": F.col("__n") + F.rank().over(W.partitionBy("__b").orderBy(way(value))),
            "run": F.col("__s") + F.coalesce(F.sum(value).over(inner.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)),
        }
    )
    return placed.drop("__b", "__n", "__s")


def percentiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float], few: bool = False) -> DataFrame:
    """One row per group (one in all, without ``groups``) with a column per entry of ``shares``: the exact percentile,
    interpolated between neighbours, of values that aren't null; groups without values give null. Equal values are counted
    before anything is ordered, and only the steps that hold a wanted place are ordered at all. With ``few`` groups (months, not
    companies) the wanted steps are broadcast: rows are counted by step, and only those of wanted steps move; ``df`` is read twice."""
    key = F.struct(*groups) if groups else F.struct(F.lit(0).alias("all"))
    rows = df.select(key.alias("__g"), F.col(value).cast("double").alias("__v"))
    known = rows.where("__v IS NOT NULL").withColumn("__b", magnitude(F.col("__v")))
    count = lambda x: x.groupBy("__g", "__v").agg(F.count("*").alias("__n")).withColumn("__b", magnitude(F.col("__v")))
    whole = W.partitionBy("__g")
    running = whole.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    counts = None if few else count(known)
    steps = known.groupBy("__g", "__b").agg(F.count("*").alias("__m")) if few else counts.groupBy("__g", "__b").agg(F.sum("__n").alias("__m"))
    steps = steps.withColumns({"__before": F.coalesce(F.sum("__m").over(running), F.lit(0)), "__total": F.sum("__m").over(whole)})
    wanted = []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("__total") - 1)
        wanted += [F.struct(F.lit(name).alias("name"), side(place).alias("place"), weight.alias("weight")) for side, weight in ((F.floor, 1 - (place - F.floor(place))), (F.ceil, place - F.floor(place)))]
    hits = steps.withColumn("__w", F.explode(F.array(*wanted))).where("__w.place >= __before AND __w.place < __before + __m").select("__g", "__b", "__before", "__w")
    if few:
        hits = F.broadcast(settled(hits))  # two a group and share
        counts = count(known.join(hits, ["__g", "__b"], "left_semi"))
    found = counts.join(hits, ["__g", "__b"])
    within = W.partitionBy("__g", "__b", "__w").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumn("__at", F.col("__before") + F.coalesce(F.sum("__n").over(within), F.lit(0))).where("__w.place >= __at AND __w.place < __at + __n")
    parts = {name: F.sum(F.when(F.col("__w.name") == name, F.col("__v") * F.col("__w.weight"))).alias(name) for name in shares}
    best = found.groupBy("__g").agg(*parts.values())
    every = rows.select("__g").distinct() if groups else None
    out = best if every is None else every.join(best, every["__g"].eqNullSafe(best["__g"]), "left").select(every["__g"], *shares)
    return out.select(*(F.col(f"__g.{g}").alias(g) for g in groups), *shares)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, where it has one, so that several uses don't compute it again."""
    return df.checkpoint() if df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir") else df


def discovery_rates(df: DataFrame, p: str, ties: list[str], out: str = "q") -> DataFrame:
    """``out``: the false discovery rate of each row's p-value by the step-up rule (the least of p times rows / rank over this
    and all greater p-values, 1 at most)."""
    step = F.floor(F.col(p) * 100_000)
    df = settled(df)
    ranked = positions(df, p, ties, descending=False, step=step).drop("rnk", "run")
    total = df.agg(F.count("*").alias("__m"))  # one row
    scaled = ranked.join(F.broadcast(total)).withColumns({"__x": F.col(p) * F.col("__m") / F.col("pos"), "__b": step})
    least = scaled.groupBy("__b").agg(F.min("__x").alias("__least"))
    later = least.select("__b", F.min("__least").over(W.orderBy(F.desc("__b")).rowsBetween(W.unboundedPreceding, -1)).alias("__later"))
    inner = W.partitionBy("__b").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    rate = F.least(F.lit(1.0), F.min("__x").over(inner), F.col("__later"))
    return scaled.join(later, "__b").withColumn(out, rate).drop("__m", "__x", "__b", "__later", "pos")
