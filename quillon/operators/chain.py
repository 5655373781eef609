"""Factor research as one chain: features of a monthly panel, the day they are known, prices from there on, neutralisation, rank
correlations by feature, target and horizon, and a backtest of fifths within sectors.

All features go through the chain as columns of one table, so that it is planned and shuffled once, not per feature, target and horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import factors
from quillon.operators.joins import asof_forward
from quillon.operators.leads import rank_correlation_grid, rank_correlations
from quillon.operators.ranks import percentiles, settled

FEATURES = ("yoy", "delta", "smooth3", "z6", "tx_yoy", "atv", "atv_yoy", "price_effect")
#: Rows of prices that each horizon spans, and the days within which a price must follow the signal.
KINDS = ("raw", "excess", "sector_rel")
HORIZONS = {"1m": 21, "3m": 63, "6m": 126}
TOLERANCE = 10
COST = 15.0  # basis points of each sale and each purchase
DIGITS = 9  # values are ranked at nine digits: sums of doubles differ in the last ones by their order


def signal_day(ym: Column) -> Column:
    """The fifth business day after the month's end."""
    end = F.last_day(F.make_date(F.floor(ym / 100).cast("int"), (ym % 100).cast("int"), F.lit(1)))
    return F.date_add(end, 7 - F.when(F.dayofweek(end) == 7, 1).when(F.dayofweek(end) == 1, 2).otherwise(0))


def _forward(prices: DataFrame, keys: list[str], horizons: dict[str, int]) -> DataFrame:
    """``*keys, day`` and, in a column a horizon, the change in percent from the row after the day over so many rows."""
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy("day")
    start = F.nullif(F.lead("price").over(w), F.lit(0.0))
    return prices.select(*keys, "day", *((100 * (F.lead("price", n + 1).over(w) / start - 1)).alias(h) for h, n in horizons.items()))


def goal_columns(horizons: dict[str, int] = HORIZONS, kinds: Sequence[str] = KINDS) -> dict[str, tuple[str, str]]:
    """The columns of ``wide_targets``: kind and horizon by name."""
    return {f"{kind}_{h}": (kind, h) for kind in kinds for h in horizons}


def wide_targets(prices: DataFrame, index: DataFrame, sectors: DataFrame, days: DataFrame, horizons: dict[str, int] = HORIZONS, kinds: Sequence[str] = KINDS, found: DataFrame | None = None) -> DataFrame:
    """``code, day`` on the given ``days`` and a column for each of ``goal_columns``, null where it isn't known: the return, less that of the index
    (a row a day, in one task), and less the median of the sector that day. Every code of a sector counts for its median, with or without a signal.
    ``found`` (``code, day`` and others) is joined before the columns of all kinds stand beside the returns: its rows that have any return."""
    days = F.broadcast(days.distinct())  # a calendar
    own = _forward(prices.where("price IS NOT NULL"), ["code"], horizons).join(days, "day", "left_semi").where(F.coalesce(*horizons).isNotNull())
    rows = settled(own.join(sectors.select("code", "sector"), "code", "left"))
    value, every = {"raw": F.col}, rows
    if found is not None:
        rows = rows.join(found, ["code", "day"])
    if "sector_rel" in kinds:
        medians = every.where("sector IS NOT NULL").groupBy("day", "sector").agg(*(F.median(h).alias(f"__median_{h}") for h in horizons))
        rows = rows.join(F.broadcast(medians), ["day", "sector"], "left")  # days by sectors
        value["sector_rel"] = lambda h: F.col(h) - F.col(f"__median_{h}")
    if "excess" in kinds:
        market = _forward(index.where("price IS NOT NULL"), [], horizons)
        rows = rows.join(F.broadcast(market.select("day", *(F.col(h).alias(f"__index_{h}") for h in horizons))), "day", "left")  # a calendar
        value["excess"] = lambda h: F.col(h) - F.col(f"__index_{h}")
    own = [] if found is None else [c for c in found.columns if c not in ("code", "day")]
    return rows.select("code", "day", *own, *(F.round(value[kind](h), DIGITS).alias(c) for c, (kind, h) in goal_columns(horizons, kinds).items()))


def targets(prices: DataFrame, index: DataFrame, sectors: DataFrame, days: DataFrame, horizons: dict[str, int] = HORIZONS, kinds: Sequence[str] = KINDS) -> DataFrame:
    """``wide_targets`` as ``code, day, horizon, kind, target``, without nulls."""
    wide = wide_targets(prices, index, sectors, days, horizons, kinds)
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(kind).alias("kind"), F.col(c).alias("target")) for c, (kind, h) in goal_columns(horizons, kinds).items()))
    return wide.select("code", "day", F.inline(each)).where("target IS NOT NULL")


def wide_signals(panel: DataFrame, prices: DataFrame, sectors: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """``code, ym, day, sector`` and a column a feature from ``code, ym, sales, tx``: features clipped at the month's tails and scaled within sectors, of
    rows that have a price within ten days of the day they are known (``day``). Rows without a sector are left out; a sector without spread is null."""
    f = settled(factors.features(panel.where("code IS NOT NULL AND ym IS NOT NULL")).select("code", "ym", *features))
    known = f.select("code", "ym", signal_day(F.col("ym")).alias("signal_day"))
    open_ = known.select("signal_day").distinct().select(F.explode(F.sequence("signal_day", F.date_add("signal_day", TOLERANCE))).alias("day")).distinct()
    near = prices.where("price IS NOT NULL").select("code", "day").join(F.broadcast(open_), "day", "left_semi")  # a calendar
    hits = asof_forward(known, near, ["code"], "signal_day", "day", TOLERANCE).select("code", "ym", "day")
    rows = settled(f.join(hits, ["code", "ym"]).join(sectors.select("code", "sector"), "code", "left"))
    tails = percentiles(rows.unpivot(["ym"], list(features), "feature", "x"), ["ym", "feature"], "x", {"lo": 0.01, "hi": 0.99}, few=True)
    ends = tails.groupBy("ym").agg(*(F.max(F.when(F.col("feature") == c, F.col(end))).alias(f"__{end}_{c}") for c in features for end in ("lo", "hi")))
    inside = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(c, f"__lo_{c}"), f"__hi_{c}")).alias(c)  # noqa: E731  both pass over nulls
    clipped = rows.where("sector IS NOT NULL").join(F.broadcast(settled(ends)), "ym").select("code", "ym", "day", "sector", *map(inside, features))  # months
    spread = clipped.groupBy("ym", "sector").agg(*(x for c in features for x in (F.avg(c).alias(f"__avg_{c}"), F.stddev_samp(c).alias(f"__sd_{c}"))))
    scaled = lambda c: F.round((F.col(c) - F.col(f"__avg_{c}")) / F.nullif(F.col(f"__sd_{c}"), F.lit(0.0)), DIGITS).alias(c)
    return clipped.join(F.broadcast(spread), ["ym", "sector"]).select("code", "ym", "day", "sector", *map(scaled, features))  # months by sectors


def signals(panel: DataFrame, prices: DataFrame, sectors: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """``wide_signals`` as ``code, ym, day, sector, feature, value``, without nulls."""
    return wide_signals(panel, prices, sectors, features).unpivot(["code", "ym", "day", "sector"], list(features), "feature", "value").where("value IS NOT NULL")


def _summed(monthly: DataFrame) -> DataFrame:
    sums = monthly.groupBy("feature", "kind", "horizon").agg(F.count("*").alias("n"), F.avg("corr").alias("ic"), F.coalesce(F.stddev_samp("corr"), F.lit(0.0)).alias("sd"), F.avg((F.col("corr") > 0).cast("double")).alias("hit"))
    ratio = F.when(F.col("sd") > 1e-9, F.col("ic") / F.col("sd")).otherwise(0.0)
    return sums.withColumns({"icir": ratio, "t": ratio * F.sqrt("n")})


def lag_decay(found: DataFrame, goals: DataFrame, least: int = 5) -> DataFrame:
    """``feature, kind, horizon`` with the mean of the monthly rank correlations of ``signals`` and ``targets`` (months of ``least`` pairs on), their
    deviation (0 for one month), t and information ratio (0 without a deviation), and the share above 0."""
    pairs = found.join(goals, ["code", "day"]).select("feature", "kind", "horizon", "ym", F.col("value").alias("a"), F.col("target").alias("b"))
    return _summed(rank_correlations(pairs, ["feature", "kind", "horizon", "ym"], least, None).where("corr IS NOT NULL"))


def wide_lag_decay(rows: DataFrame, features: Sequence[str] = FEATURES, goals: dict[str, tuple[str, str]] | None = None, least: int = 5) -> DataFrame:
    """``lag_decay`` from one row a code and month: ``ym``, a column a feature and the ``goal_columns``. It moves once, where the pairs of all
    features, kinds and horizons are 72 rows."""
    goals = goal_columns() if goals is None else goals
    monthly = rank_correlation_grid(rows, ["ym"], list(features), list(goals), least)
    named = F.create_map(*(x for c, (kind, h) in goals.items() for x in (F.lit(c), F.struct(F.lit(kind).alias("kind"), F.lit(h).alias("horizon")))))
    return _summed(monthly.withColumn("__goal", named[F.col("y")]).select(F.col("x").alias("feature"), "__goal.*", "corr"))


def fifths(rows: DataFrame, groups: list[str], value: str, least: int = 5) -> DataFrame:
    """``rows`` with ``q``, from 1: the part of the group's range of ranks in which the value lies; equal edges count once. Groups of
    under ``least`` rows are left out."""
    rows = settled(rows)
    big = rows.groupBy(*groups).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    edges = percentiles(rows, groups, value, {f"__e{i}": i / 5 for i in range(5)}).join(big, groups)
    above = F.filter(F.array_distinct(F.array(*(f"__e{i}" for i in range(5)))), lambda e: (e > F.col("__e0")) & (F.col(value) > e))
    return rows.join(edges, groups).withColumn("q", F.size(above) + 1).drop(*(f"__e{i}" for i in range(5)))


def backtest(found: DataFrame, goals: DataFrame, feature: str = "yoy", kind: str = "sector_rel", horizon: str = "1m", cost: float = COST) -> DataFrame:
    """``ym, n, low, high, ls, turnover, net``: mean targets of the lowest and the highest fifth within sectors, their difference, the share of all codes
    whose fifth changed from the month before (0 in the first), and the difference after costs."""
    rows = found.where(F.col("feature") == feature).join(goals.where((F.col("kind") == kind) & (F.col("horizon") == horizon)), ["code", "day"])
    rows = settled(fifths(rows.select("code", "ym", "sector", "value", "target"), ["ym", "sector"], "value"))
    months = rows.select("ym").distinct().withColumn("__m", F.row_number().over(W.orderBy("ym")))  # a calendar
    codes = rows.agg(F.count_distinct("code").alias("__codes"))  # one row
    w = W.partitionBy("code").orderBy("__m")
    changed = (F.lag("__m").over(w) == F.col("__m") - 1) & (F.lag("q").over(w) != F.col("q"))
    each = rows.join(F.broadcast(months), "ym").withColumn("__moved", F.when(changed, 1).otherwise(0))
    mean = lambda q: F.avg(F.when(F.col("q") == q, F.col("target")))
    out = each.groupBy("ym").agg(F.count("*").alias("n"), mean(1).alias("low"), mean(5).alias("high"), F.sum("__moved").alias("__moved")).join(F.broadcast(codes))
    out = out.withColumns({"ls": F.col("high") - F.col("low"), "turnover": F.col("__moved") / F.col("__codes")}).drop("__moved", "__codes")
    return out.withColumn("net", F.col("ls") - F.col("turnover") * F.lit(2 * cost / 100))


def performance(months: DataFrame, a_year: int = 12) -> DataFrame:
    """One row from ``backtest``: months with both fifths, Sharpe ratio before and after costs (0 without a deviation), yearly return, share of
    gains, mean turnover of all months, and the deepest fall of the summed differences from their height."""
    w = W.orderBy("ym").rowsBetween(W.unboundedPreceding, 0)  # a calendar
    run = months.withColumn("__cum", F.sum("ls").over(w))
    run = run.withColumn("__fall", F.when(F.col("ls").isNotNull(), F.col("__cum") - F.max("__cum").over(w)))
    sharpe = lambda x: F.coalesce(F.when(F.stddev_samp(x) > 0, F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * F.sqrt(F.lit(a_year))), F.lit(0.0))
    return run.agg(
        F.count("ls").alias("n"), sharpe("ls").alias("sharpe"), sharpe("net").alias("sharpe_net"), (F.avg("ls") * a_year).alias("annual"), F.avg(F.when(F.col("ls").isNotNull(), (F.col("ls") > 0).cast("double"))).alias("hit"),
        F.avg("turnover").alias("turnover"), F.coalesce(F.min("__fall"), F.lit(0.0)).alias("max_drawdown"),
    )
