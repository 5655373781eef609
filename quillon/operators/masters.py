"""Identifiers and masters: business numbers, merchant codes, representative brands, sign-offs, shares by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def business_number(raw: Column) -> Column:
    """Ten digits of a business number, shorter ones with zeros before them; null without digits or with more than ten."""
    digits = F.regexp_replace(raw, r"\D", "")
    return F.when(F.length(digits).between(1, 10), F.lpad(digits, 10, "0"))


def business_form(number: Column) -> Column:
    """A business number as 000-00-00000."""
    return F.concat_ws("-", F.substring(number, 1, 3), F.substring(number, 4, 2), F.substring(number, 6, 5))


def merchant_code(code: Column) -> Column:
    """A merchant's code without the mark of its variant (fixed values: single, combined, summed)."""
    return F.regexp_replace(code, r"(?i)__(SINGLE|COMBINED|SUMMED)$", "")


def signed_off(marks: Column, needed: Column) -> Column:
    """Whether every needed sign-off is there and true in the map ``marks``; null maps hold none, and nothing needed is signed."""
    return F.forall(needed, lambda x: F.coalesce(F.element_at(marks, x), F.lit(False)))


def representative_brands(keys: DataFrame, curated: DataFrame, recommended: DataFrame, key: str, n: int = 5) -> DataFrame:
    """``n`` slots of each key of ``keys``: curated brands first, then recommended ones not among them, each in their ``place``,
    then blank ones. The other two tables have ``key, brand, place``; ranks are within a key."""
    both = curated.select(key, "brand", "place", F.lit(0).alias("__from")).unionByName(recommended.select(key, "brand", "place", F.lit(1).alias("__from")))
    first = both.groupBy(key, "brand").agg(F.min(F.struct("__from", "place")).alias("__at"))
    slot = F.row_number().over(W.partitionBy(key).orderBy("__at", "brand"))
    picks = first.withColumn("slot", slot).where(F.col("slot") <= n).select(key, "slot", "brand", F.element_at(F.array(F.lit("curated"), F.lit("recommended")), F.col("__at.__from") + 1).alias("reason"))
    slots = keys.select(key).distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return slots.join(picks, [key, "slot"], "left").select(key, "slot", F.coalesce("brand", F.lit("")).alias("brand"), F.coalesce("reason", F.lit("none")).alias("reason"))


def share_matrix(df: DataFrame, key: str, period: str, amount: str) -> DataFrame:
    """Every key in every period of the table: its share of the period's amount in percent, 0 where it has none. Periods are
    those of a calendar: their list is what a key's row is spread over."""
    sums = df.groupBy(key, period).agg(F.sum(amount).alias("__x"))
    totals = sums.groupBy(period).agg(F.sum("__x").alias("__all"))
    periods = totals.agg(F.collect_list(period).alias("__p"))  # one row
    spine = sums.select(key).distinct().join(F.broadcast(periods)).select(key, F.explode("__p").alias(period))
    shares = sums.join(totals, period).select(key, period, (100 * F.col("__x") / F.nullif(F.col("__all"), F.lit(0))).alias("share"))
    return spine.join(shares, [key, period], "left").fillna(0.0, ["share"])


def largest_series(df: DataFrame, key: str, period: str, amount: str, n: int = 6) -> DataFrame:
    """The series of the ``n`` keys with the largest sums."""
    sums = df.groupBy(key, period).agg(F.sum(amount).alias("amt"))
    top = sums.groupBy(key).agg(F.sum("amt").alias("__x")).orderBy(F.desc("__x"), key).limit(n).select(key)
    return sums.join(F.broadcast(top), key, "left_semi")  # n rows


def cumulative_rate(trades: DataFrame, key: str, day: str, paid: str, got: str) -> DataFrame:
    """``key, day, rate``: what was got per unit paid up to the day's last trade, for every day on which any key traded from
    the key's first trade on; a day without a trade repeats the last rate. Sums run over days, each day's trades being added first."""
    daily = trades.groupBy(key, day).agg(F.sum(paid).alias("__p"), F.sum(got).alias("__g"))
    days = daily.select(day).distinct().agg(F.collect_list(day).alias("__d"))  # one row over a calendar
    first = daily.groupBy(key).agg(F.min(day).alias("__first")).join(F.broadcast(days))
    spine = first.select(key, "__first", F.explode("__d").alias(day)).where(F.col(day) >= F.col("__first"))
    w = W.partitionBy(key).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    filled = spine.join(daily, [key, day], "left")
    return filled.select(key, day, (F.sum("__g").over(w) / F.nullif(F.sum("__p").over(w), F.lit(0))).alias("rate"))
