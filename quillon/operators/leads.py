"""Signals of a monthly panel and how far they lead another series: rank correlations by lag, with the lag chosen on the first
part of each series and measured on the rest."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.ranks import discovery_rates

SIGNALS = ("sales_yoy", "asp_yoy", "share", "share_mom")


def monthly_signals(panel: DataFrame) -> DataFrame:
    """``code, ym, signal, value`` of rows with a code: growth of sales and of the price over twelve rows, share of the month's
    sales and its change, in percent; without null values. ``panel`` has ``code, ym, amt, qty``."""
    rows = panel.where("code <> ''").groupBy("code", "ym").agg(F.sum("amt").alias("amt"), F.sum("qty").alias("qty"))
    months = rows.groupBy("ym").agg(F.sum("amt").alias("__all"))
    w = W.partitionBy("code").orderBy("ym")

    def growth(x: Column) -> Column:
        return 100 * (x / F.nullif(F.lag(x, 12).over(w), F.lit(0)) - 1)

    wide = rows.join(months, "ym").withColumns({"share": 100 * F.col("amt") / F.nullif(F.col("__all"), F.lit(0)), "asp": F.col("amt") / F.when(F.col("qty") > 0, F.col("qty"))})
    wide = wide.withColumns({"sales_yoy": growth(F.col("amt")), "asp_yoy": growth(F.col("asp")), "share_mom": F.col("share") - F.lag("share").over(w)})
    return wide.unpivot(["code", "ym"], list(SIGNALS), "signal", "value").where("value IS NOT NULL")


def lead_pairs(signals: DataFrame, targets: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """``*keys, lag, a, b``: each ``value`` of ``signals`` with the ``target`` of the same keys that lies 0 to ``most`` rows after
    the one of the same ``order``."""
    w = W.partitionBy(*keys).orderBy(order)
    later = targets.select(*keys, order, F.array(*(F.lead("target", n).over(w) for n in range(most + 1))).alias("__t"))
    each = signals.join(later, [*keys, order]).select(*keys, F.col("value").alias("a"), F.posexplode("__t").alias("lag", "b"))
    return each.where("a IS NOT NULL AND b IS NOT NULL")


def rank_correlations(pairs: DataFrame, by: list[str], least: int, digits: int | None = 3) -> DataFrame:
    """``*by, n, corr, hit``: Spearman's correlation to ``digits`` (null below ``least`` pairs and for constant series) and the
    share of pairs of one sign."""

    def twice_average_rank(x: str) -> Column:
        return 2 * F.rank().over(W.partitionBy(*by).orderBy(x)) + F.count("*").over(W.partitionBy(*by, x)) - 1

    def whole(x: Column) -> Column:  # products of sums pass 2^63 from some 55,000 pairs on
        return x.cast("decimal(38,0)")

    def moment(x: str, y: str) -> Column:  # of whole numbers, hence exact: equal correlations round alike
        return (whole(F.count("*")) * whole(F.sum(F.col(x) * F.col(y))) - whole(F.sum(x)) * whole(F.sum(y))).cast("double")

    ranked = pairs.withColumns({"__a": twice_average_rank("a"), "__b": twice_average_rank("b")})
    spread = F.sqrt(moment("__a", "__a") * moment("__b", "__b"))
    varied = (F.count("*") >= least) & (F.min("a") < F.max("a")) & (F.min("b") < F.max("b"))
    same = F.avg(F.when(F.signum("a") == F.signum("b"), 1.0).otherwise(0.0))
    corr = moment("__a", "__b") / F.nullif(spread, F.lit(0.0))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(varied, corr if digits is None else F.round(corr, digits)).alias("corr"), F.round(same, 2).alias("hit"))


def rank_correlation_grid(rows: DataFrame, by: list[str], left: list[str], right: list[str], least: int) -> DataFrame:
    """``*by, x, y, n, corr``: Spearman's correlation of every column of ``left`` with every one of ``right`` over the rows that have both, as
    ``rank_correlations`` has it for their pairs; those that are null there are left out. Columns are doubles. Rows move once, not once for every two
    columns; a group is one frame in a task, eight bytes for each row and column."""

    def grid(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = {c: frame[c].to_numpy(float) for c in (*left, *right)}
        known = {c: ~np.isnan(v) for c, v in values.items()}
        order = {c: np.argsort(v, kind="stable")[: known[c].sum()] for c, v in values.items()}  # unknown ones are last

        def ranks(c: str, both: np.ndarray) -> np.ndarray:  # twice the average rank, whole numbers
            at = order[c][both[order[c]]]
            v = values[c][at]
            first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            many = np.diff(first, append=len(v))
            out = np.zeros(len(both), np.int64)
            out[at] = np.repeat(2 * first + many + 1, many)
            return out[both]

        def product(p: np.ndarray, q: np.ndarray) -> int:  # exact: 50,000 products at a time stay below 2^63
            return sum(int(p[i : i + 50_000] @ q[i : i + 50_000]) for i in range(0, len(p), 50_000))

        out = []
        for x in left:
            for y in right:
                both = known[x] & known[y]
                n = int(both.sum())
                if n < least or n < 2:
                    continue
                p, q = ranks(x, both), ranks(y, both)
                if p.min() == p.max() or q.min() == q.max():
                    continue
                moment = lambda a, b: float(len(a) * product(a, b) - int(a.sum()) * int(b.sum()))
                out.append((*key, x, y, n, moment(p, q) / math.sqrt(moment(p, p) * moment(q, q))))
        return pd.DataFrame(out, columns=[*by, "x", "y", "n", "corr"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "x string, y string, n long, corr double"])
    return rows.select(*by, *left, *right).groupBy(*by).applyInPandas(grid, schema)


def best_lag(correlations: DataFrame, keys: list[str]) -> DataFrame:
    """The lag of each key with the greatest absolute correlation, the smallest of equal ones."""
    known = correlations.where("corr IS NOT NULL")
    best = F.max_by(F.struct("lag", "corr", "n"), F.struct(F.abs("corr"), -F.col("lag")))
    return known.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def normal_p(corr: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation by the normal approximation; erfc by a polynomial (error below 2e-7). 1 up to three pairs."""
    r = F.least(F.abs(corr), F.lit(0.999999))
    x = r * F.sqrt((n - 2) / (1 - r * r)) / F.sqrt(F.lit(2.0))
    k = 1 / (1 + 0.3275911 * x)
    # fixed values: coefficients of the polynomial for erfc
    sum_ = ((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k
    return F.when((n > 3) & corr.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum_ * F.exp(-x * x)))).otherwise(1.0)


def _lagged(most: int, least: int) -> Callable[..., Column]:
    """Spearman's correlations of one series a row, as ``rank_correlations`` of ``lead_pairs`` has them: for the whole series, its months up to
    the cut and those after it, by lag, three numbers each (correlation, share of pairs of one sign, pairs)."""

    def ranks(x: np.ndarray) -> np.ndarray:  # twice the average rank, whole numbers
        _, place, many = np.unique(x, return_inverse=True, return_counts=True)
        return (2 * np.cumsum(many) - many + 1)[place]

    def cell(a: np.ndarray, b: np.ndarray) -> list:
        n = len(a)
        if not n:
            return [None, None, 0.0]
        same = float(np.mean((np.sign(a) == np.sign(b)) | (np.isnan(a) & np.isnan(b))))
        p, q = ranks(a), ranks(b)
        if n < least or p.min() == p.max() or q.min() == q.max():
            return [None, same, float(n)]
        moment = lambda x, y: float(n * int(x @ y) - int(x.sum()) * int(y.sum()))  # noqa: E731  exact
        return [moment(p, q) / math.sqrt(moment(p, p) * moment(q, q)), same, float(n)]

    def one(ym: np.ndarray, value: np.ndarray, months: np.ndarray, target: np.ndarray, cut: int) -> list:
        out = []
        for own, theirs in ((ym == ym, months == months), (ym <= cut, months <= cut), (ym > cut, months > cut)):
            m, t = months[theirs], target[theirs]
            _, i, j = np.intersect1d(ym[own], m, assume_unique=True, return_indices=True)
            a = value[own][i]
            for lag in range(most + 1):
                known = j + lag < len(t)
                out += cell(a[known], t[j[known] + lag])
        return out

    @F.pandas_udf("array<double>")
    def lagged(ym: pd.Series, value: pd.Series, months: pd.Series, target: pd.Series, cut: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(ym, value, months, target, cut, strict=True)], dtype=object)

    return lagged


def returns_research(signals: DataFrame, returns: DataFrame, most: int = 6, share: float = 0.6, least: int = 12, level: float = 0.10) -> DataFrame:
    """Signals (``code, signal, ym, value``) against returns (``code, ym, target``). The lag is the best one up to the month in
    which ``share`` of a signal's rows are past; ``oos`` is the correlation at that lag after it, ``full`` over all. p-values are
    those of ``full``, q their false discovery rate over all series. Series under ``least`` + 4 rows are left out. A series, one row a month, is
    one row of lists, so that no window sorts its pairs for every lag and part."""
    keys, parts = ["code", "signal"], ("full", "train", "test")
    listed = lambda df, by, x: df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ym", F.col(x).cast("double").alias("x")))).alias("__" + x))  # noqa: E731  a calendar
    s = listed(signals, keys, "value").where(F.size("__value") >= least + 4)
    s = s.withColumn("__cut", F.get("__value", F.floor(F.size("__value") * share).cast("int"))["ym"])
    both = s.join(listed(returns, ["code"], "target"), "code")
    measured = both.select(*keys, _lagged(most, least)(*(F.col(c).cast(kind) for c, kind in (("__value.ym", "array<long>"), ("__value.x", "array<double>"), ("__target.ym", "array<long>"), ("__target.x", "array<double>"), ("__cut", "long")))).alias("__m"))
    at_ = lambda i: F.get("__m", F.lit(i))
    cells = [(part, lag, 3 * (k * (most + 1) + lag)) for k, part in enumerate(parts) for lag in range(most + 1)]
    found = F.array(*(F.struct(F.lit(part).alias("part"), F.lit(lag).alias("lag"), F.round(at_(i), 3).alias("corr"), (F.round(100 * at_(i + 1)) / 100).alias("hit"), at_(i + 2).cast("long").alias("n")) for part, lag, i in cells))
    each = measured.select(*keys, F.filter(found, lambda c: c.n > 0).alias("__c"))

    def at(part: str, lag: Column) -> Column:
        return F.get(F.filter("__c", lambda c: (c.part == part) & (c.lag == lag)), F.lit(0))

    ranked = F.transform(F.filter("__c", lambda c: (c.part == "train") & c.corr.isNotNull()), lambda c: F.struct(F.abs(c.corr).alias("size"), (-c.lag).alias("back"), c.lag.alias("lag"), c.corr.alias("corr")))
    chosen = each.select(*keys, "__c", F.array_max(ranked).alias("__best")).where("__best IS NOT NULL").select(*keys, "__c", "__best.lag", F.col("__best.corr").alias("train"))
    full, test = at("full", F.col("lag")), at("test", F.col("lag"))
    rows = chosen.select(*keys, "lag", "train", full["corr"].alias("full"), full["hit"].alias("hit"), full["n"].alias("n"), test["corr"].alias("oos"), F.coalesce(test["n"], F.lit(0)).alias("oos_n")).where("full IS NOT NULL")
    rated = discovery_rates(rows.withColumn("p", F.round(normal_p(F.col("full"), F.col("n")), 4)), "p", keys).withColumn("q", F.round("q", 4))
    steady = (F.abs("oos") >= 0.2) & (F.col("oos_n") >= 12)
    return rated.withColumn("confidence", F.when((F.col("q") < level) & steady, "high").when(F.col("q") < level, "medium").otherwise("low"))


def revenue_research(sales: DataFrame, revenue: DataFrame, most: int = 4, least: int = 8, level: float = 0.10) -> DataFrame:
    """Growth of sales over four quarters against that of disclosed revenue (both ``code, quarter, x``): the best lag in quarters
    over all rows, p-values and false discovery rates. There are too few quarters for a part that is held out."""

    def growth(df: DataFrame, out: str) -> DataFrame:
        before = F.lag("x", 4).over(W.partitionBy("code").orderBy("quarter"))
        return df.select("code", "quarter", (100 * (F.col("x") / F.nullif(before, F.lit(0)) - 1)).alias(out)).dropna()

    found = rank_correlations(lead_pairs(growth(sales, "value"), growth(revenue, "target"), ["code"], "quarter", most), ["code", "lag"], least)
    rows = best_lag(found, ["code"]).withColumn("p", F.round(normal_p(F.col("corr"), F.col("n")), 4))
    rated = discovery_rates(rows, "p", ["code"]).withColumn("q", F.round("q", 4))
    return rated.withColumn("confidence", F.when((F.col("q") < level) & (F.col("n") >= 12), "high").when(F.col("q") < level, "medium").otherwise("low"))
