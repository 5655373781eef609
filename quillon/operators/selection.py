"""Filters and prices of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_token(column: str, wanted: list[str]) -> Column:
    """Any element of a comma list equals one of the wanted words, whatever their case."""
    tokens = F.transform(F.split(F.col(column), ","), lambda x: F.lower(F.trim(x)))
    return F.coalesce(F.arrays_overlap(tokens, F.array(*(F.lit(w.lower().strip()) for w in wanted))), F.lit(False))


def free_text(columns: list[str], pattern: str) -> Column:
    """The pattern matches any of the columns, whatever their case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(F.col(c)).rlike(pattern.lower()), F.lit(False))
    return found


def in_range(df: DataFrame, column: str, low: float, high: float) -> Column:
    """Between low and high; nulls pass only where the range covers all values of the unfiltered table. The bounds are a
    scalar subquery, so nothing runs before the filtered table does."""
    bounds = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("b")).scalar()
    whole = F.coalesce((bounds["lo"] >= low) & (bounds["hi"] <= high), F.lit(True))
    return F.coalesce(F.col(column).between(low, high), whole)


def apply_filters(df: DataFrame, text: tuple[list[str], str] | None = None, equal: dict[str, list] | None = None, tokens: dict[str, list[str]] | None = None, ranges: dict[str, tuple[float, float]] | None = None, required: list[str] = (), excluded: list[str] = ()) -> DataFrame:
    """All families of filters together; Catalyst merges them into one scan."""
    keep = F.lit(True)
    if text:
        keep = keep & free_text(*text)
    for c, values in (equal or {}).items():
        keep = keep & F.col(c).cast("string").isin([str(v) for v in values])
    for c, words in (tokens or {}).items():
        keep = keep & any_token(c, words)
    for c, (low, high) in (ranges or {}).items():
        keep = keep & in_range(df, c, low, high)
    for c in required:
        keep = keep & F.coalesce(F.col(c), F.lit(False))
    for c in excluded:
        keep = keep & ~F.coalesce(F.col(c), F.lit(False))
    return df.where(keep)


def unit_price(base: Column, sources: Column, floor: float = 300.0) -> Column:
    """Half price without sources, never under the floor, to tens (ties to even)."""
    return F.bround(F.greatest(F.when(sources > 0, base).otherwise(base / 2), F.lit(floor)), -1)


def volume_tier(n: Column) -> Column:
    return F.when(n >= 100, 0.7).when(n >= 50, 0.8).when(n >= 10, 0.9).otherwise(1.0)
