"""Similar spellings: a similarity join on edit distance that meets candidates only.

Two strings are similar if ``1 - d / n`` reaches the cutoff, d being their edit distance and n the longer one's length; so many
edits, k, are allowed. Up to two edits, strings meet by what is left of them: k edits between two strings leave both the same
string once each has lost k letters at most, and the shorter one no more than its own length allows. Above, a string that is cut
into k // 2 + 1 segments keeps one of them under one edit, and that one moves by s places only, where s letters to the left and
the rest of the difference in length to the right cost k at most; segments and the substrings that may be one meet by what is
left of them without a letter. An equi-join on hashes of these finds what may be similar, and edit distances are computed for
that alone. Keys are nearly as long as the strings, so that words made of the same syllables do not meet for these alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHOLE = 2  # the most edits under which whole strings meet


def _without(x: Column, *at: Column) -> Column:
    """A string without the letters at some places, in order."""
    ends = [F.lit(0), *at]
    return F.concat(*(F.substring(x, i + 1, j - i - 1) for i, j in zip(ends, at, strict=False)), F.substring(x, ends[-1] + 1, F.length(x)))


def _shorter(x: Column, letters: int = 1) -> Column:
    """All strings that are left of one that loses a letter, or two."""
    if letters == 1:
        return F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: _without(x, i))).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(x) > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.transform(F.sequence(i + 1, F.length(x)), lambda j: _without(x, i, j))))).otherwise(F.array().cast("array<string>"))


def _met(left: DataFrame, a: str, right: DataFrame, b: str, cutoff: float) -> DataFrame:
    """``a, b, distance`` of similar strings; a pair may come more than once."""
    if not 0.6 <= cutoff <= 1:
        raise ValueError("the cutoff must be from 0.6 to 1")
    edits = lambda n: F.floor(n * (1 - cutoff) + 1e-9).cast("int")  # noqa: E731  the most for a pair whose longer string has n letters
    longest = lambda n: F.floor(n / cutoff + 1e-9).cast("int")  # noqa: E731  the longest partner of n letters

    def segment(m: Column, k: Column, i: Column) -> tuple[Column, Column]:
        """(letters before, length) of a segment; the last ones are a letter longer if the length doesn't divide."""
        parts = F.floor(k / 2).cast("int") + 1
        base, short = F.floor(m / parts).cast("int"), parts - m % parts
        return (i * base + F.greatest(i - short, F.lit(0))).cast("int"), base + F.when(i >= short, 1).otherwise(0)

    def whole(df: DataFrame, x: str) -> DataFrame:
        e = edits(F.length(x))
        none = F.array().cast("array<string>")
        kept = F.concat(F.array(x), F.when(e > 0, _shorter(F.col(x))).otherwise(none), F.when(e > 1, _shorter(F.col(x), 2)).otherwise(none))
        return df.where(e <= WHOLE).select(x, F.explode(F.array_distinct(F.transform(kept, lambda s: F.xxhash64(s)))).alias("key"))

    mine = left.select(F.col(a).alias("a")).where("length(a) > 0").distinct()
    theirs = right.select(F.col(b).alias("b")).where("length(b) > 0").distinct()
    m, n, k, i, t, d = (F.col(c) for c in "mnkitd")
    at, size = segment(m, k, i)
    numbers = F.explode(F.sequence(F.lit(0), F.floor(k / 2).cast("int")))
    keys = lambda strings: F.explode(F.array_distinct(F.transform(strings, lambda s: F.xxhash64(m, k, i, s)))).alias("key")
    cut = theirs.withColumn("m", F.length("b")).where(edits(longest(m)) > WHOLE).withColumn("k", F.explode(F.sequence(F.greatest(edits(m), F.lit(WHOLE + 1)), edits(longest(m))))).withColumn("i", numbers)
    piece = F.substring(F.col("b"), at + 1, size)
    held = cut.select("b", keys(F.concat(F.array(piece), _shorter(piece))))
    tried = mine.withColumn("n", F.length("a")).where(edits(longest(n)) > WHOLE).withColumn("m", F.explode(F.sequence(n - edits(n), longest(n)))).withColumn("k", edits(F.greatest("n", "m")))
    tried = tried.where((F.abs(n - m) <= k) & (k > WHOLE)).withColumn("i", numbers)
    moved = tried.withColumn("t", F.explode(F.sequence(F.ceil((n - m - k) / 2).cast("int") - 1, F.floor((n - m + k) / 2).cast("int") + 1))).withColumn("d", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    ends = F.when(i == 0, t == 0).otherwise(True) & F.when(i == F.floor(k / 2), t + d == n - m).otherwise(True)  # the first segment starts where the string does, the last one ends there
    moved = moved.where((F.abs(t) + F.abs(d) + F.abs(n - m - t - d) <= k) & ends & (at + t >= 0) & (size + d > 0) & (at + t + size + d <= n))
    piece = F.substring(F.col("a"), at + t + 1, size + d)
    asked = moved.select("a", keys(F.when(d < 0, F.array(piece)).when(d > 0, _shorter(piece)).otherwise(F.concat(F.array(piece), _shorter(piece)))))
    met = whole(mine, "a").unionByName(asked).join(whole(theirs, "b").unionByName(held), "key")
    return met.select("a", "b", F.levenshtein("a", "b").alias("distance")).where(F.col("distance") <= edits(F.greatest(F.length("a"), F.length("b"))))


def similar_pairs(left: DataFrame, a: str, right: DataFrame, b: str, cutoff: float = 0.8) -> DataFrame:
    """``a, b, distance``: the distinct strings of column ``a`` of ``left`` and ``b`` of ``right`` that are similar. Equal strings are
    (distance 0); null and empty ones are not. Cutoffs below 0.6 raise, as short strings would have more segments than letters."""
    return _met(left, a, right, b, cutoff).distinct()


def closest(left: DataFrame, a: str, right: DataFrame, b: str, cutoff: float = 0.8) -> DataFrame:
    """``a, b, ratio``: the most similar string of the right side for each one of the left that has any; ties go to the first in order."""
    ratio = 1 - F.col("distance") / F.greatest(F.length("a"), F.length("b"))
    pairs = _met(left, a, right, b, cutoff).withColumn("ratio", ratio)
    return pairs.groupBy("a").agg(F.min(F.struct((-F.col("ratio")).alias("o"), F.col("b"))).alias("x")).select("a", "x.b", (-F.col("x.o")).alias("ratio"))
