"""Joins that Spark has no keyword for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_day: str, right_day: str, tolerance: int) -> DataFrame:
    """For each row of ``left`` the first row of ``right`` with the same keys from its day on, at most ``tolerance`` days
    later; rows without one are dropped. Days are dealt into stretches of ``tolerance + 1`` days: a row meets its own
    stretch and the next one, so the join is an equi-join whose size is bounded by what two stretches hold."""
    width = tolerance + 1
    number = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / width)
    a = left.groupBy(*left.columns).agg(F.count("*").alias("__n")).withColumn("__b", F.explode(F.array(number(F.col(left_day)), number(F.col(left_day)) + 1)))
    right = right.select(*(F.col(c).alias(c if c in keys else f"__r_{c}") for c in right.columns))
    day = f"__r_{right_day}"
    gap = F.datediff(F.col(day), F.col(left_day))
    found = a.join(right.withColumn("__b", number(F.col(day))), [*keys, "__b"]).where(gap.between(0, tolerance))
    others = [c for c in right.columns if c not in keys]
    best = found.groupBy("__n", *left.columns).agg(F.min_by(F.struct(*others), F.struct(day, *[c for c in others if c != day])).alias("__best"))
    best = best.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n"))))  # equal rows are joined once
    return best.select(*left.columns, *(F.col(f"__best.{c}").alias(c.removeprefix("__r_") if c.removeprefix("__r_") not in left.columns else c.removeprefix("__r_") + "_right") for c in others))


def overlay(base: DataFrame, curated: DataFrame, registry: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Curated values win where they aren't blank, the registry fills what is left, '' what neither has."""
    c = curated.select(key, *(F.col(x).alias(f"__c_{x}") for x in columns))
    r = registry.select(key, *(F.col(x).alias(f"__r_{x}") for x in columns))
    out = base.join(c, key, "left").join(r, key, "left")
    return out.select(*base.columns, *(F.coalesce(F.nullif(F.col(f"__c_{x}"), F.lit("")), F.col(f"__r_{x}"), F.lit("")).alias(x) for x in columns))


def merge_fresh(old: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows over existing ones, column by column."""
    columns = [c for c in old.columns if c != key]
    f = fresh.select(key, *(F.col(c).alias(f"__f_{c}") for c in columns if c in fresh.columns))
    pick: list[Column] = [F.coalesce(f"__f_{c}", c).alias(c) if c in fresh.columns else F.col(c) for c in columns]
    return old.join(f, key, "full").select(key, *pick)
