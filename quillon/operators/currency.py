"""Scores of when to exchange a currency: components of several daily series as of each day, added up, and what they advise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The series, and the components of both scores: series, what of it counts, its factor (with the sign of its effect on the
# rate), and the bound of what it may add.
SERIES = ("USDKRW", "DXY", "UST10Y", "KOSPI", "BRENT", "WTI", "CNY")
SHORT = (("DXY", "pct_5", 15.0, 15), ("UST10Y", "change_5", 100.0, 10), ("KOSPI", "pct_5", -5.0, 10), ("CNY", "pct_5", 10.0, 10), ("USDKRW", "pct_5", 5.0, 15))
MID = (("DXY", "pct_60", 4.0, 20), ("UST10Y", "change_60", 30.0, 15), ("KOSPI", "pct_60", -1.5, 10), ("CNY", "pct_60", 4.0, 10))
STRONG, WEAK = 35, 20


def snapshots(series: DataFrame) -> DataFrame:
    """``key, day, last, ma20, ma60, ma200, pct_5, pct_60, change_5, change_60, rsi`` of each value of ``series`` (``key, day, value``; null values don't count),
    from the second one of a key on. Means need all their values, changes a base (in percent one other than 0); RSI(14) by simple
    means is 50 before fifteen values and without a move, 100 without a fall. A series is one row a day, and is ordered by day."""
    w = W.partitionBy("key").orderBy("day")
    x = F.col("value")
    rows = series.where("value IS NOT NULL").withColumns({"n": F.row_number().over(w), "d": x - F.lag(x).over(w)})
    last = lambda k: w.rowsBetween(1 - k, 0)
    mean = lambda k: F.when(F.col("n") >= k, F.avg(x).over(last(k)))
    base = lambda k: F.lag(x, k).over(w)
    percent = lambda k: 100 * (x / F.nullif(base(k), F.lit(0.0)) - 1)
    up, down = F.avg(F.greatest("d", F.lit(0.0))).over(last(14)), F.avg(F.greatest(-F.col("d"), F.lit(0.0))).over(last(14))
    rsi = F.when((F.col("n") < 15) | ((up == 0) & (down == 0)), 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0))))
    columns = {"last": x, "ma20": mean(20), "ma60": mean(60), "ma200": mean(200), "pct_5": percent(5), "pct_60": percent(60), "change_5": x - base(5), "change_60": x - base(60), "rsi": rsi}
    return rows.select("key", "day", "n", *(c.alias(name) for name, c in columns.items())).where("n >= 2").drop("n")


def as_of(snaps: DataFrame, days: DataFrame) -> DataFrame:
    """One row per ``day`` of ``days`` with the last snapshot of each series up to it, as a struct column a series (null before its first):
    snapshots and days lie in one order per series, so that one pass carries them forward."""
    values = [c for c in snaps.columns if c not in ("key", "day")]
    asked = days.select("day").distinct().select("day", F.explode(F.array(*map(F.lit, SERIES))).alias("key"))
    line = snaps.select("key", "day", F.lit(0).alias("side"), F.struct(*values).alias("s")).unionByName(asked.withColumn("side", F.lit(1)), allowMissingColumns=True)
    carried = line.withColumn("s", F.last("s", ignorenulls=True).over(W.partitionBy("key").orderBy("day", "side").rowsBetween(W.unboundedPreceding, 0))).where("side = 1")
    return carried.groupBy("day").agg(*(F.max(F.when(F.col("key") == k, F.col("s"))).alias(k) for k in SERIES))


def _clip(x: Column, bound: float, low: float | None = None) -> Column:
    """x between its bounds, 0 if it isn't known (greatest and least leave nulls out)."""
    return F.when(x.isNull(), 0.0).otherwise(F.greatest(F.lit(float(-bound if low is None else low)), F.least(F.lit(float(bound)), x)))


def currency_scores(series: DataFrame, days: DataFrame) -> DataFrame:
    """``day, short, mid, combined, advice`` of every day that the rate itself has a snapshot for: from -100 (exchange now) to 100 (wait). Every
    component is clipped to its bound and adds nothing while its series isn't known."""
    rows = as_of(snapshots(series), days).where("USDKRW IS NOT NULL")
    part = lambda rules: sum((_clip(F.col(f"{key}.{what}") * factor, bound) for key, what, factor, bound in rules), F.lit(0.0))
    off = lambda a, b: 100 * (F.col(f"USDKRW.{a}") / F.nullif(F.when(F.col(f"USDKRW.{b}") > 0, F.col(f"USDKRW.{b}")), F.lit(0.0)) - 1)
    rsi = F.col("USDKRW.rsi")
    swing = F.when(rsi >= 70, _clip(-12.5 * ((rsi - 70) / 30 + 1), 0, -25)).when(rsi <= 30, _clip(12.5 * ((30 - rsi) / 30 + 1), 25, 0)).otherwise(_clip((50 - rsi) * 0.2, 10))
    near = off("last", "ma20")
    short = part(SHORT) + swing + _clip(F.when(F.abs(near) <= 1.5, near * 10).otherwise(near * 5), 15)
    oil = F.array_compact(F.array("WTI.pct_60", "BRENT.pct_60"))
    mean = F.when(F.size(oil) > 0, F.aggregate(oil, F.lit(0.0), lambda s, x: s + x) / F.size(oil))
    mid = part(MID) + _clip(off("last", "ma200") * 4, 20) + _clip(off("ma60", "ma200") * 6, 15) + _clip(mean, 10)
    out = rows.select("day", _clip(short, 100).alias("short"), _clip(mid, 100).alias("mid"))
    return out.withColumn("combined", (F.col("short") + F.col("mid")) / 2).withColumn("advice", advice(F.col("short"), F.col("mid")))


def verdict(score: Column) -> Column:
    return F.when(score <= -STRONG, "exchange").when(score <= -WEAK, "rather exchange").when(score < WEAK, "neutral").when(score < STRONG, "rather wait").otherwise("wait")


def advice(short: Column, mid: Column) -> Column:
    """What both scores advise together: at once, in parts, wait, only what is needed soon, or by need."""
    sell, wait = (short <= -WEAK) | (mid <= -WEAK), (short >= WEAK) | (mid >= WEAK)
    return (
        F.when((short <= -STRONG) & (mid <= -WEAK), "at once").when(sell & ~wait, "in parts").when((short >= STRONG) & (mid >= WEAK), "wait").when(wait & ~sell, "only what is needed").otherwise("by need")
    )
