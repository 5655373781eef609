"""Codes, names and matching."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def stock_code(x: Column) -> Column:
    """Six digits of an ISIN (KR7...), of an A-code, of ten digits (the second to the seventh) or of six; else null.
    Dashes and spaces don't count, nor do other characters that aren't digits in the last two forms."""
    x = F.regexp_replace(F.upper(x), r"[-\s]", "")
    digits = F.regexp_replace(x, r"\D", "")
    return (
        F.when(x.rlike(r"^KR[0-9A-Z]{10}$"), F.substring(x, 4, 6))
        .when(x.rlike(r"^A[0-9]{6}$"), F.substring(x, 2, 6))
        .when(F.length(digits) == 10, F.substring(digits, 2, 6))
        .when(F.length(digits) == 6, digits)
    )


def isin_check_digit(body: Column) -> Column:
    """Check digit of eleven ISIN characters: letters become numbers, then every second digit from the right counts
    double (digit sums)."""
    digits = F.concat_ws("", F.transform(F.split(body, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)))
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * (F.lit(2) - i % 2))
    total = F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v))
    return F.pmod(F.lit(10) - total % 10, F.lit(10))


def name_key(x: Column) -> Column:
    """Lower case letters and digits of every script, without company forms (Korean ones only at the ends)."""
    x = F.regexp_replace(F.lower(F.trim(x)), r"^(주식회사|㈜|\(주\))\s*", "")
    x = F.regexp_replace(x, r"\s*(주식회사|㈜|\(주\)|\(유\)|유한회사|홀딩스)\s*$", "")
    x = F.regexp_replace(x, r"(?<![\p{L}\p{N}_])(co|ltd|inc|corp|company|limited)(?![\p{L}\p{N}_])\.?", "")
    return F.regexp_replace(x, r"[^\p{L}\p{M}\p{N}]+", "")


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks; for the remainder that exact rules leave."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def _parts(name: str, ratio: float) -> Column:
    """Hashes of the distinct strings inside a name, shorter than it and of at least ``ratio`` of its length."""
    n = F.length(name)
    low = F.greatest(F.lit(1), F.ceil(n * ratio - 1e-9)).cast("int")
    of_size = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.substring(F.col(name), i, k)))
    return F.array_distinct(F.when(low < n, F.flatten(F.transform(F.sequence(low, n - 1), of_size))).otherwise(F.array()))


def match_names(left: DataFrame, registry: DataFrame, name: str, key: str, ratio: float = 0.5) -> DataFrame:
    """``left`` with ``matched`` (a ``key`` of the registry) and ``how``: equal normalised names, else the longest
    registry name that contains the name or is inside it, where the shorter has at least ``ratio`` of the longer's
    length. The second step joins the strings inside the names of one side with the names of the other, both ways, so
    that only names that contain each other meet, whatever their script and length. All joins are by merging: Spark takes
    a side's size from before it is exploded, or from compressed files, and would send millions of rows through the driver."""
    exact = registry.select(F.col(key).alias("__key"), name_key(F.col(name)).alias("__reg")).where("length(__reg) > 0").groupBy("__reg").agg(F.min("__key").alias("__exact"))
    first = left.withColumn("__name", name_key(F.col(name))).join(exact.hint("merge"), F.col("__name") == F.col("__reg"), "left").drop("__reg")
    rest = first.where(F.col("__exact").isNull() & (F.length("__name") > 0)).select("__name").distinct()
    inside = rest.withColumn("__p", F.explode(_parts("__name", ratio))).hint("merge").join(exact.withColumn("__p", F.xxhash64("__reg")), "__p").where(F.col("__name").contains(F.col("__reg")))
    around = exact.withColumn("__p", F.explode(_parts("__reg", ratio))).hint("merge").join(rest.withColumn("__p", F.xxhash64("__name")), "__p").where(F.col("__reg").contains(F.col("__name")))
    best = inside.unionByName(around).groupBy("__name").agg(F.max_by("__exact", F.struct(F.length("__reg"), F.col("__reg"))).alias("__long"))
    out = first.join(best.hint("merge"), "__name", "left")
    how = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__long").isNotNull(), "contains").otherwise("none")
    return out.withColumn("matched", F.coalesce("__exact", "__long")).withColumn("how", how).drop("__name", "__exact", "__long")


def keyword_tags(df: DataFrame, column: str, tags: dict[str, list[str]], gate: Column | None = None) -> DataFrame:
    """A boolean column per tag: any of its words occurs (and the gate holds)."""
    for tag, words in tags.items():
        hit = F.coalesce(F.lower(F.col(column)).rlike("|".join(words)), F.lit(False))
        df = df.withColumn(tag, hit & gate if gate is not None else hit)
    return df


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keyed upsert of an append-only table: the first row of each key in the given order stays."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
