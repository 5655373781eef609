"""Sales against prices by company and for all together, over calendar periods: lags of prices and of volumes, rolling correlations
of two windows, studies of events, and one state a company. Series are short (a row a day at most); companies are many."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quillon.operators import market
from quillon.operators.ranks import settled

#: Both windows of rolling correlations and the horizons of event studies, in periods.
WINDOWS = {"day": ((30, 60), (5, 10, 20, 60)), "week": ((8, 26), (1, 2, 4, 12)), "month": ((6, 12), (1, 2, 3, 6))}
#: The order in which a company's frequencies are tried.
PREFERRED = ("week", "month", "day")

def _series() -> WindowSpec:
    return W.partitionBy("key").orderBy("period")


def _period(freq: str) -> Column:
    return F.col("day").cast("date") if freq == "day" else F.date_trunc(freq, "day").cast("date")


def _following(at: Column, freq: str) -> Column:
    return F.add_months(at, 1) if freq == "month" else F.date_add(at, 7 if freq == "week" else 1)


def _change(now: Column, before: Column) -> Column:
    return 100 * (now / F.nullif(before, F.lit(0)) - 1)


def sales_periods(sales: DataFrame, freq: str) -> DataFrame:
    """``key, period, growth, tx_growth`` in percent from ``key, day, sales, tx``. Periods without rows count as 0: the first one of
    a gap has a growth of -100, and growth from 0 is null, so that no other period of a gap needs a row. Null sales count as 0;
    rows without a day are left out."""
    sums = sales.where("day IS NOT NULL").groupBy("key", _period(freq).alias("period"))
    sums = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("sales", "tx")))
    beside = _following(F.lag("period").over(_series()), freq) == F.col("period")
    grown = lambda c: F.when(beside, _change(F.col(c), F.lag(c).over(_series())))
    rows = sums.withColumns({"growth": grown("sales"), "tx_growth": grown("tx"), "next": _following(F.col("period"), freq), "later": F.lead("period").over(_series())})
    gone = lambda c: F.when(F.col(c) != 0, -100.0)
    own = F.struct("period", "growth", "tx_growth")
    gap = F.when(F.col("later") > F.col("next"), F.struct(F.col("next").alias("period"), gone("sales").alias("growth"), gone("tx").alias("tx_growth")))
    return rows.select("key", F.inline(F.array_compact(F.array(own, gap))))


def price_periods(prices: DataFrame, freq: str) -> DataFrame:
    """``key, period, ret, volume_change`` in percent from ``key, day, price, volume``: the last price of each period against the one
    before it, and summed volumes. Days follow each other as they were traded; after a week or month without rows the change of
    volume is null. Periods without a price are left out."""
    last = F.max(F.when(F.col("price").isNotNull(), F.struct("day", "price")))["price"]
    sums = prices.where("day IS NOT NULL").groupBy("key", _period(freq).alias("period")).agg(last.alias("p"), F.coalesce(F.sum("volume"), F.lit(0)).cast("double").alias("v"))
    before = F.last("p", ignorenulls=True).over(_series().rowsBetween(W.unboundedPreceding, -1))
    volume = _change(F.col("v"), F.lag("v").over(_series()))
    if freq != "day":
        volume = F.when(_following(F.lag("period").over(_series()), freq) == F.col("period"), volume)
    return sums.select("key", "period", "p", _change(F.col("p"), before).alias("ret"), volume.alias("volume_change")).where("p IS NOT NULL").drop("p")


def merged(sales: DataFrame, prices: DataFrame, freq: str) -> DataFrame:
    """Both series where growth and return are known."""
    return sales_periods(sales, freq).join(price_periods(prices, freq), ["key", "period"]).where("growth IS NOT NULL AND ret IS NOT NULL")


def lag_table(rows: DataFrame, x: str, y: str, most: int, least: int = 4) -> DataFrame:
    """``key, lag, corr, n``: ``x`` against the ``y`` of 0 to ``most`` rows later, over rows that have both; keys under ``least`` such
    rows and constant series are left out."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("n", F.count("*").over(W.partitionBy("key"))).where(F.col("n") >= least)
    later = known.select("key", F.col(x).alias("x"), F.array(*(F.lead(y, n).over(_series()) for n in range(most + 1))).alias("later"))
    pairs = later.select("key", "x", F.posexplode("later").alias("lag", "y")).where("y IS NOT NULL")
    return pairs.groupBy("key", "lag").agg(F.round(market._corr("x", "y"), 4).alias("corr"), F.count("*").alias("n")).where("corr IS NOT NULL")


def rolling_pair(rows: DataFrame, windows: tuple[int, int]) -> DataFrame:
    """``key, period, roll_short, roll_long``: correlations of growth and return over the last rows, null before a window is full
    and where one side of it is constant."""

    def over(n: int) -> Column:
        w = _series().rowsBetween(1 - n, 0)
        spread = F.stddev_pop("growth").over(w) * F.stddev_pop("ret").over(w)
        varied = (F.min("growth").over(w) < F.max("growth").over(w)) & (F.min("ret").over(w) < F.max("ret").over(w))
        return F.when((F.count("*").over(w) == n) & varied, F.covar_pop("growth", "ret").over(w) / F.nullif(spread, F.lit(0.0)))

    return rows.select("key", "period", over(windows[0]).alias("roll_short"), over(windows[1]).alias("roll_long"))


def event_study(rows: DataFrame, column: str, horizons: tuple[int, ...], top: float = 0.10, least: int = 5) -> DataFrame:
    """``key, n_events, threshold, horizon, n, ret``: rows of the key's highest ``top`` of ``column`` are events; ``ret`` is the mean return
    compounded over the ``horizon`` rows after them, ``n`` the events that have as many rows after them (``ret`` is null for
    none). Keys with under ``least`` values are left out."""
    ahead = lambda h: F.when(F.count("*").over(_series().rowsBetween(1, h)) == h, F.product(1 + F.col("ret") / 100).over(_series().rowsBetween(1, h)))
    after = rows.select("key", F.col(column).alias("x"), F.array(*(F.struct(F.lit(h).alias("horizon"), (100 * (ahead(h) - 1)).alias("ret")) for h in horizons)).alias("after"))
    cuts = rows.groupBy("key").agg(F.percentile(column, 1 - top).alias("threshold"), F.count(column).alias("n")).where(F.col("n") >= least).drop("n")
    events = after.join(cuts, "key").where("x >= threshold")
    each = events.select("key", "threshold", F.inline("after"))
    return each.groupBy("key", "horizon").agg(F.count("*").alias("n_events"), F.first("threshold").alias("threshold"), F.count("ret").alias("n"), F.avg("ret").alias("ret"))


def all_frequencies(sales: DataFrame, prices: DataFrame) -> DataFrame:
    """``market.scored`` of every frequency, with ``freq``. Both tables are read once a frequency and should be sums by day."""
    return reduce(DataFrame.unionByName, (market.scored(merged(sales, prices, f), f).withColumn("freq", F.lit(f)) for f in PREFERRED))


def company_signals(sales: DataFrame, prices: DataFrame, codes: DataFrame) -> DataFrame:
    """A row for each of ``codes`` (``company, code``, a row a company) with its state and the scores of the first of ``PREFERRED`` that
    has enough periods, from ``company, day, sales, tx`` and ``code, day, price, volume``. States: no code (blank), no prices,
    insufficient (no frequency with four periods), ok."""
    codes = codes.select("company", F.nullif(F.trim("code"), F.lit("")).alias("code"))
    listed = codes.where("code IS NOT NULL")
    daily = sales.groupBy("company", "day").agg(F.sum("sales").alias("sales"), F.sum("tx").alias("tx"))
    s = settled(daily.join(listed, "company").select(F.col("company").alias("key"), "day", "sales", "tx"))
    p = settled(prices.join(listed, "code").select(F.col("company").alias("key"), "day", "price", "volume"))
    found = all_frequencies(s, p)
    place = F.array_position(F.array(*map(F.lit, PREFERRED)), F.col("freq"))
    first = found.groupBy("key").agg(F.min_by(F.struct(*(c for c in found.columns if c != "key")), place).alias("b")).select(F.col("key").alias("company"), "b.*")
    priced = p.where("price IS NOT NULL").select(F.col("key").alias("company"), F.lit(True).alias("priced")).distinct()
    out = codes.join(priced, "company", "left").join(first, "company", "left")
    state = F.when(F.col("code").isNull(), "no code").when(F.col("priced").isNull(), "no prices").when(F.col("freq").isNull(), "insufficient").otherwise("ok")
    return out.withColumn("status", state).drop("priced")


def universe_signals(sales: DataFrame, index: DataFrame) -> DataFrame:
    """Scores at every frequency of the sales of all companies (``day, sales, tx``) against an index (``day, price, volume``)."""
    daily = sales.groupBy("day").agg(F.sum("sales").alias("sales"), F.sum("tx").alias("tx")).withColumn("key", F.lit("all"))
    return all_frequencies(settled(daily), settled(index.withColumn("key", F.lit("all"))))
