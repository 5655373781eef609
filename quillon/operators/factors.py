"""Factor features, their neutralisation by date, how well sales track disclosed amounts, and the rule-based alpha score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.ranks import percentiles, settled

STEPS = ("log", "winsorize", "sector_z", "rank_pct", "cap_neutral")


def features(panel: DataFrame) -> DataFrame:
    """Eight features by ``code, ym`` from ``sales`` and ``tx``: growth over twelve rows, its change, its mean over three rows (two
    at least), its deviation from six rows (three at least), growth of the count, amount of a transaction and its growth, and
    the part of growth that prices make. Changes from 0 are null."""
    w = W.partitionBy("code").orderBy("ym")
    back = lambda n: w.rowsBetween(1 - n, 0)
    growth = lambda c: 100 * (F.col(c) / F.nullif(F.lag(c, 12).over(w), F.lit(0.0)) - 1)
    p = panel.withColumn("atv", F.col("sales") / F.nullif(F.col("tx"), F.lit(0)))
    p = p.withColumns({"yoy": growth("sales"), "tx_yoy": growth("tx"), "atv_yoy": growth("atv")})
    y, n = F.col("yoy"), lambda k: F.count("yoy").over(back(k))
    z = (y - F.avg("yoy").over(back(6))) / F.nullif(F.stddev_samp("yoy").over(back(6)), F.lit(0.0))
    return p.withColumns({"delta": y - F.lag("yoy").over(w), "smooth3": F.when(n(3) >= 2, F.avg("yoy").over(back(3))), "z6": F.when(n(6) >= 3, z), "price_effect": y - F.col("tx_yoy")})


def neutralised(panel: DataFrame, feature: str, out: str, steps: tuple[str, ...] = STEPS, tails: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """``panel`` (with ``date, sector, cap``) with ``out``: the feature after the given steps, always in the order of ``STEPS``:
    logarithm that keeps the sign, clipping at the date's tails, deviation within date and sector, average rank within date and
    sector (0 to 1), less the mean of date, sector and fifth of ``cap``. Rows without a sector (or ``cap`` in the last step) are
    null after steps that need it; a sector without spread is null after the third."""
    if unknown := set(steps) - set(STEPS):
        raise ValueError(f"unknown steps: {sorted(unknown)}")
    x, group = F.col("__x"), W.partitionBy("date", "sector")
    p = panel.withColumn("__x", F.col(feature).cast("double"))
    if "log" in steps:
        p = p.withColumn("__x", F.signum(x) * F.log1p(F.abs(x)))
    if "winsorize" in steps:
        p = settled(p)
        ends = percentiles(p, ["date"], "__x", {"__lo": tails[0], "__hi": tails[1]})
        p = p.join(ends, "date", "left").withColumn("__x", F.when(x.isNotNull(), F.least(F.greatest(x, "__lo"), "__hi"))).drop("__lo", "__hi")
    if "sector_z" in steps:
        z = (x - F.avg("__x").over(group)) / F.nullif(F.stddev_samp("__x").over(group), F.lit(0.0))
        p = p.withColumn("__x", F.when(F.col("sector").isNotNull(), z))
    if "rank_pct" in steps:
        ties = F.count("*").over(W.partitionBy("date", "sector", "__x"))
        rank = F.rank().over(group.orderBy(F.asc_nulls_last("__x"))) + (ties - 1) / 2
        p = p.withColumn("__x", F.when(F.col("sector").isNotNull() & x.isNotNull(), rank / F.nullif(F.count("__x").over(group), F.lit(0))))
    if "cap_neutral" in steps:
        p = settled(p)
        edges = percentiles(p, ["date"], "cap", {"__e0": 0.0, "__e1": 0.2, "__e2": 0.4, "__e3": 0.6, "__e4": 0.8})
        above = sum((F.when((F.col("cap") > F.col(f"__e{i}")) & (F.col(f"__e{i}") > F.col("__e0")), 1).otherwise(0) for i in range(1, 5)), F.lit(0))
        p = p.join(edges, "date", "left").withColumn("__q", above)
        known = F.col("sector").isNotNull() & F.col("cap").isNotNull()
        mean = F.avg(F.when(known, x)).over(W.partitionBy("date", "sector", "__q"))
        p = p.withColumn("__x", F.when(known, x - mean)).drop("__q", *(f"__e{i}" for i in range(5)))
    return p.withColumnRenamed("__x", out)


def tracking_quality(sales: DataFrame, disclosed: DataFrame, key: str) -> DataFrame:
    """From ``key, quarter, sales`` and ``key, quarter, disclosed``: share of equal signs of both changes, their correlation (0
    without), stability of the ratio, and 0.5, 0.3 and 0.2 of these as a quality. Keys under four common quarters, or three with
    both changes, are left out."""
    w = W.partitionBy(key).orderBy("quarter")
    change = lambda c: F.col(c) / F.nullif(F.lag(c).over(w), F.lit(0.0)) - 1
    both = sales.join(disclosed, [key, "quarter"]).withColumns({"a": change("sales"), "b": change("disclosed"), "r": F.col("sales") / F.nullif(F.col("disclosed"), F.lit(0.0))})
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    a, b = F.when(paired, F.col("a")), F.when(paired, F.col("b"))
    corr = F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))
    cv = F.when((F.count("r") >= 2) & (F.avg("r") > 0), F.stddev_samp("r") / F.nullif(F.avg("r"), F.lit(0.0)))
    out = both.groupBy(key).agg(
        F.count("*").alias("__n"), F.count_if(paired).alias("n"), F.avg(F.when(paired, F.when(F.signum("a") == F.signum("b"), 100.0).otherwise(0.0))).alias("match"),
        F.coalesce(corr, F.lit(0.0)).alias("corr"), F.coalesce(1 / (1 + cv), F.lit(0.0)).alias("stability"),
    ).where("__n >= 4 AND n >= 3")
    quality = F.round(0.5 * F.col("match") + 30 * F.abs("corr") + 20 * F.col("stability"), 1)
    return out.select(key, "n", F.round("match", 1).alias("match"), F.round("corr", 3).alias("corr"), F.round("stability", 3).alias("stability"), quality.alias("quality"))


def alpha_score(df: DataFrame) -> DataFrame:
    """``df`` with ``points``, ``sure`` and ``alpha`` (their product, 100 at most) from ``mom, yoy, demand, anomalies, periods, lead_corr``: points for growth, demand and
    few anomalies, a bonus for a lead correlation above 0.5, and a confidence by how many of the first three are known."""
    scaled = lambda c, low, high: F.least(F.greatest(100 * (F.col(c) - low) / (high - low), F.lit(0.0)), F.lit(100.0))
    yearly = F.when(F.col("yoy").isNull(), 0.0).otherwise(0.4 * scaled("yoy", -20, 40))
    growth = F.when(F.col("mom").isNotNull(), F.round(0.4 * scaled("mom", -20, 30) + yearly, 1)).otherwise(0.0)  # least and greatest pass over nulls
    demand = F.when(F.col("demand").isNotNull(), F.round(0.35 * scaled("demand", 20, 80), 1)).otherwise(0.0)
    rate = F.least(F.lit(1.0), F.col("anomalies") / F.greatest(F.lit(1), F.coalesce("periods", F.lit(12))))
    safety = F.when(F.col("anomalies").isNotNull(), F.round((1 - rate) * 25, 1)).otherwise(0.0)
    bonus = F.when(F.col("lead_corr") > 0.5, F.round(F.least(F.lit(10.0), (F.col("lead_corr") - 0.5) * 20), 1)).otherwise(0.0)
    known = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("mom", "demand", "anomalies")), F.lit(0))
    sure = F.element_at(F.array(*map(F.lit, (0.5, 0.65, 0.82, 1.0))), known + 1)
    return df.withColumns({"points": growth + demand + safety + bonus, "sure": sure}).withColumn("alpha", F.round(F.least(F.lit(100.0), F.col("points") * F.col("sure")), 1))


def isin_chain(matches: DataFrame, exchange: DataFrame) -> DataFrame:
    """``matches`` (``name, corp, stock``) with ``isin, market`` of the exchange's row of that stock code (``stock, isin, market``;
    the smallest ISIN of repeated ones) and ``found``: exchange, not on exchange, unlisted or no match."""
    pad = lambda c: F.lpad(F.nullif(F.trim(c), F.lit("")), 6, "0")
    listed = exchange.select(pad(F.col("stock")).alias("__s"), "isin", "market").where("__s IS NOT NULL").groupBy("__s").agg(F.min(F.struct("isin", "market")).alias("__b"))
    out = matches.withColumn("__k", pad(F.col("stock"))).join(listed, F.col("__k") == F.col("__s"), "left")
    blank = F.coalesce(F.trim("corp"), F.lit("")) == ""
    found = F.when(F.col("__b").isNotNull(), "exchange").when(blank, "no match").when(F.col("__k").isNull(), "unlisted").otherwise("not on exchange")
    return out.select(*matches.columns, F.col("__b.isin").alias("isin"), F.col("__b.market").alias("market"), found.alias("found"))


def upcoming(events: DataFrame, day: str, today: Column, days: int = 30) -> DataFrame:
    """Events of the next ``days`` days, today among them."""
    return events.where(F.date_diff(F.col(day), today).between(0, days))
