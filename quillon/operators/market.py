"""Sales against prices at several frequencies, checks of sales against disclosed revenue, the wide panel of signals and deliveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Greatest lag and short window (both in periods) by frequency.
FREQUENCIES = {"day": (90, 30), "week": (52, 8), "month": (24, 6)}
SPIKE = 50  # percent


def periods(daily: DataFrame, freq: str) -> DataFrame:
    """``key, period, growth, ret, volume_change`` in percent from ``key, day, sales, price, volume``: sums of sales and volume and
    the last price of each period that has rows, changes against the period before. Weeks end on Sunday."""
    at = F.col("day") if freq == "day" else F.date_trunc(freq, "day").cast("date")
    sums = daily.groupBy("key", at.alias("period")).agg(F.sum("sales").alias("s"), F.max_by("price", F.when(F.col("price").isNotNull(), F.col("day"))).alias("p"), F.sum("volume").alias("v"))
    w = W.partitionBy("key").orderBy("period")
    change = lambda c: 100 * (F.col(c) / F.nullif(F.lag(c).over(w), F.lit(0.0)) - 1)
    return sums.select("key", "period", change("s").alias("growth"), change("p").alias("ret"), change("v").alias("volume_change"))


def _corr(a: str, b: str) -> Column:
    """Null under two pairs and where one side is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = (F.when(both, F.col(c)) for c in (a, b))
    return F.when((F.count_if(both) >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.covar_pop(x, y) / _spread(F.stddev_pop(x), F.stddev_pop(y)))


def _spread(a: Column, b: Column) -> Column:
    """The divisor of a correlation; ``corr`` itself fails on constant series in ANSI mode, whatever guards it."""
    return F.nullif(a * b, F.lit(0.0))


def signals(daily: DataFrame, freq: str) -> DataFrame:
    """``scored`` over the ``periods`` of ``daily``."""
    return scored(periods(daily, freq).where("growth IS NOT NULL AND ret IS NOT NULL"), freq)


def scored(rows: DataFrame, freq: str) -> DataFrame:
    """How well each key's sales growth leads its price at one frequency, from ``key, period, growth, ret, volume_change``: the lag
    of the greatest absolute correlation (the smallest of equal ones), the share of equal signs there, how often and how steadily
    the rolling correlation is above 0.2, the correlation of volume, and a score from 0 to 100 with a grade. Keys under four
    periods are left out."""
    most, short = FREQUENCIES[freq]
    w = W.partitionBy("key").orderBy("period")
    rolling = W.partitionBy("key").orderBy("period").rowsBetween(1 - short, 0)
    varied = (F.min("growth").over(rolling) < F.max("growth").over(rolling)) & (F.min("ret").over(rolling) < F.max("ret").over(rolling))
    roll = F.when((F.count("*").over(rolling) == short) & varied, F.covar_pop("growth", "ret").over(rolling) / _spread(F.stddev_pop("growth").over(rolling), F.stddev_pop("ret").over(rolling)))
    rows = rows.withColumns({"roll": roll, "later": F.array(*(F.lead("ret", n).over(w) for n in range(most + 1)))})
    pairs = rows.select("key", "growth", F.posexplode("later").alias("lag", "after")).where("after IS NOT NULL")
    hit = F.round(100 * F.avg(F.when(F.signum("growth") == F.signum("after"), 1.0).otherwise(0.0)), 1)
    lags = pairs.groupBy("key", "lag").agg(F.round(_corr("growth", "after"), 4).alias("corr"), hit.alias("hit_rate"), F.count("*").alias("sample")).where("corr IS NOT NULL")
    best = lags.groupBy("key").agg(F.max_by(F.struct("lag", "corr", "hit_rate", "sample"), F.struct(F.abs("corr"), -F.col("lag"))).alias("b")).select("key", "b.*")
    spread = F.stddev_samp("roll")
    steady = F.when(spread > 0, F.round(1 / (1 + spread), 3)).when(F.count("roll") > 0, 1.0)
    often = F.round(100 * F.avg(F.when(F.col("roll").isNotNull(), F.when(F.col("roll") > 0.2, 1.0).otherwise(0.0))), 1)
    sums = rows.groupBy("key").agg(
        F.count("*").alias("n"), often.alias("persistence"), steady.alias("stability"), F.round(_corr("growth", "volume_change"), 3).alias("volume_corr"),
        F.count_if(F.col("volume_change") > SPIKE).alias("spikes"),
    ).where("n >= 4")
    out = sums.join(best, "key")
    score = (
        35 * F.abs("corr")
        + F.greatest(F.lit(0.0), (F.col("hit_rate") - 50) / 2)
        + F.coalesce(F.col("persistence") / 5, F.lit(10.0))
        + F.least(F.lit(10.0), 20 * F.abs(F.coalesce("volume_corr", F.lit(0.0))))
        + 10 * F.coalesce(F.nullif(F.col("stability"), F.lit(0.0)), F.lit(0.5))
    )
    out = out.withColumn("score", F.round(F.least(F.lit(100.0), score), 1))
    grade = F.when(F.col("score") >= 70, "A").when(F.col("score") >= 50, "B").when(F.col("score") >= 30, "C").otherwise("D")
    strength = F.when(F.abs("corr") >= 0.5, "strong").when(F.abs("corr") >= 0.3, "middle").otherwise("weak")
    return out.withColumns({"grade": grade, "strength": strength})


def whole_market(daily: DataFrame) -> DataFrame:
    """``daily`` of all keys together as key ``all``: sums of sales and volume, and the mean price, by day."""
    return daily.groupBy("day").agg(F.sum("sales").alias("sales"), F.avg("price").alias("price"), F.sum("volume").alias("volume")).withColumn("key", F.lit("all"))


def tracking_sanity(lead: DataFrame, key: str) -> DataFrame:
    """From ``key, sales, disclosed, tracking`` (percent): mean, greatest value and deviation (from three quarters on) of the
    tracking ratio, and a severity with its reasons (unit, scope, quarters, double counting)."""
    t = F.col("tracking")
    sums = lead.groupBy(key).agg(
        F.avg(t).alias("mean"), F.max(t).alias("most"), F.when(F.count(t) > 2, F.stddev_samp(t)).alias("std"), F.count(t).alias("n"), F.count_if(t > 100).alias("above"),
        F.count_if((t > 200) | (t < 0)).alias("extreme"), F.try_divide(F.avg("sales"), F.avg("disclosed")).alias("units"),
    )
    u = F.col("units")
    reasons = F.filter(
        F.array(
            F.when(u > 10, "unit"), F.when(F.col("mean") > 100, "scope"), F.when((F.col("extreme") > 0) | (F.col("std") > 40), "quarters"),
            F.when((F.col("above") > F.col("n") * 0.5) & (F.col("mean") > 80), "double"),
        ),
        lambda x: x.isNotNull(),
    )
    has = lambda name: F.array_contains(F.col("__why"), name)
    out = sums.withColumn("__why", reasons)
    severity = F.when(has("unit") | (F.col("mean") > 150), "critical").when(has("scope") | has("quarters"), "warning").when(F.size("__why") > 0, "caution").otherwise("ok")
    return out.withColumns({"severity": severity, "reasons": F.array_join("__why", ",")}).drop("__why", "units")


def _before(x: str, by: Sequence[str], months: int) -> Column:
    """The value ``months`` calendar months earlier; keys have one row a month."""
    return F.max(x).over(W.partitionBy(*by).orderBy("mn").rangeBetween(-months, -months))


def _month(ym: str) -> Column:
    return (F.floor(F.col(ym) / 100) * 12 + F.col(ym) % 100 - 1).cast("long")


def available(ym: str, lag_days: int = 15) -> Column:
    """The day from which a month's figures are known."""
    first = F.make_date(F.floor(F.col(ym) / 100).cast("int"), (F.col(ym) % 100).cast("int"), F.lit(1))
    return F.date_add(F.last_day(first), lag_days)


def alpha_panel(sales: DataFrame, lag_days: int = 15) -> DataFrame:
    """Eleven signals by ``code`` and month from ``code, sku, ym, amt, qty, trend``: growth over 1, 3 and 12 months, share of the
    month and its changes, price and its growth, shares of products in their first twelve months and of trend products. Rows
    without a code are left out; earlier values are those of the calendar month, not of the row before."""
    skus = sales.where("trim(code) <> ''").groupBy("code", "sku", "ym").agg(F.sum("amt").alias("amt"), F.sum("qty").alias("qty"), F.max(F.coalesce("trend", F.lit(False))).alias("trend"))
    skus = skus.withColumn("mn", _month("ym")).withColumn("new", F.col("mn") - F.min("mn").over(W.partitionBy("sku")) <= 11)
    g = skus.groupBy("code", "ym", "mn").agg(F.sum("amt").alias("sales"), F.sum("qty").alias("quantity"), F.sum(F.when(F.col("new"), F.col("amt")).otherwise(0.0)).alias("__new"), F.sum(F.when(F.col("trend"), F.col("amt")).otherwise(0.0)).alias("__trend"))
    totals = g.groupBy("ym").agg(F.sum("sales").alias("__all"))
    part = lambda x, y, digits: F.when(F.col(y) > 0, F.round(100 * F.col(x) / F.col(y), digits))
    three = W.partitionBy("code").orderBy("mn").rowsBetween(-2, 0)
    g = g.join(totals, "ym").withColumns(
        {
            "share": part("sales", "__all", 4), "asp": F.when(F.col("quantity") > 0, F.round(F.col("sales") / F.col("quantity"), 1)), "newproduct_share": part("__new", "sales", 2),
            "trend_share": part("__trend", "sales", 2), "__three": F.when(F.count("*").over(three) == 3, F.sum("sales").over(three)),
        }
    )
    growth = lambda x, months: 100 * F.round(F.col(x) / F.nullif(_before(x, ["code"], months), F.lit(0.0)) - 1, 4)
    change = lambda x, months, digits: F.round(F.col(x) - _before(x, ["code"], months), digits)
    out = g.withColumns(
        {
            "sales_yoy": growth("sales", 12), "sales_mom": growth("sales", 1), "sales_3m": growth("__three", 3), "asp_yoy": growth("asp", 12), "asp_mom": growth("asp", 1),
            "share_mom": change("share", 1, 4), "share_yoy": change("share", 12, 4), "trend_share_yoy": change("trend_share", 12, 2), "available_date": available("ym", lag_days),
        }
    )
    return out.drop("mn", "__new", "__trend", "__all", "__three")


def delivery_facts(sales: DataFrame, lag_days: int = 15) -> DataFrame:
    """Monthly facts of three tiers (``sku``, ``brand``, ``company``; the columns below a tier are null) from ``company, brand,
    sku, ym, amt, qty``: each tier is the sum of the one below, with growth against the calendar month and year before."""
    tier = sales.groupBy("company", "brand", "sku", "ym").agg(F.sum("amt").alias("sales"), F.sum("qty").alias("quantity"))
    out = None
    for name, keys in (("sku", ["company", "brand", "sku"]), ("brand", ["company", "brand"]), ("company", ["company"])):
        tier = tier.groupBy(*keys, "ym").agg(F.sum("sales").alias("sales"), F.sum("quantity").alias("quantity")) if name != "sku" else tier
        growth = lambda months, by=("__h", *keys): 100 * (F.col("sales") / F.nullif(_before("sales", by, months), F.lit(0.0)) - 1)
        rows = tier.withColumns({"mn": _month("ym"), "__h": F.xxhash64(*keys)})  # names begin alike: sorted by a number first, few are compared
        rows = rows.withColumns({"tier": F.lit(name), "yoy": growth(12), "mom": growth(1), "available_date": available("ym", lag_days)}).drop("mn", "__h")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def basic_sales(daily: DataFrame, channel: str = "") -> DataFrame:
    """Rows of the daily template: day, company, company_brand, channel, amount, quantity, count; people stay blank."""
    named = F.concat_ws("_", "company", "brand")
    return daily.select(F.col("day").cast("string").alias("day"), "company", named.alias("brand"), F.lit(channel).alias("channel"), "amount", "quantity", "lines", F.lit("").alias("people"))


def basic_info(brands: DataFrame, total: str = "Total") -> DataFrame:
    """Each company with its total and each of its named brands, as company_brand."""
    own = brands.where("trim(brand) <> ''").select("company", F.concat_ws("_", "company", "brand").alias("brand"))
    return brands.select("company", F.concat_ws("_", F.col("company"), F.lit(total)).alias("brand")).unionByName(own).distinct()


def brand_categories(sales: DataFrame) -> DataFrame:
    """The most frequent category of each company's brand (the smallest of equal ones) and its rows."""
    counts = sales.where("cat1 IS NOT NULL").groupBy("company", "brand", "cat1").agg(F.count("*").alias("n"))
    return counts.groupBy("company", "brand").agg(F.min(F.struct(-F.col("n"), F.col("cat1").alias("c"), F.col("n").alias("n"))).alias("m")).select("company", "brand", F.col("m.c").alias("category"), F.col("m.n").alias("n"))


def shifted_overlay(panel: DataFrame, lag: int) -> DataFrame:
    """``key, ym, sales, price``: both series from 100 at their first value, the sales ``lag`` rows later."""
    w = W.partitionBy("key").orderBy("ym")
    first = lambda c: F.first(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    level = panel.select("key", "ym", *((100 * F.col(c) / F.nullif(first(c), F.lit(0.0))).alias(c) for c in ("sales", "price")))
    return level.withColumn("sales", F.lag("sales", lag).over(w))


def score_pivot(scores: DataFrame, key: str, kind: str, kinds: list[str], value: str) -> DataFrame:
    """A row a key with the mean of each of the ``kinds`` as a column."""
    return scores.groupBy(key).pivot(kind, kinds).agg(F.avg(value))
