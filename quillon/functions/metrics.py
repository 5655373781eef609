"""Null-safe arithmetic, scores and period codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def pct_change(x: Column, w: WindowSpec, rows: int = 1, padded: bool = False) -> Column:
    """Percent change against ``rows`` rows before; ``padded`` repeats the last value for missing ones first."""
    if padded:
        x = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return 100 * (F.try_divide(x, F.lag(x, rows).over(w)) - 1)


def rolling_z(x: Column, w: WindowSpec, rows: int = 6, least: int = 3) -> Column:
    f = w.rowsBetween(1 - rows, 0)
    return F.when(F.count(x).over(f) >= least, F.try_divide(x - F.avg(x).over(f), F.stddev_samp(x).over(f)))


def clamp(x: Column, low: float = 0, high: float = 100, missing: float = 50) -> Column:
    return F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(missing)).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def grade(score: Column) -> Column:
    return F.when(score >= 70, "A").when(score >= 50, "B").when(score >= 30, "C").otherwise("D")


def month_number(ym: Column) -> Column:
    return (F.floor(ym / 100) * 12 + ym % 100).cast("int")


def quarter_code(ym: Column) -> Column:
    """YYYYQ of YYYYMM."""
    return (F.floor(ym / 100) * 10 + F.ceil((ym % 100) / 3)).cast("int")
