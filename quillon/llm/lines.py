"""Line dedup with levelled sorted runs of line hashes (DataFrame functions only).

``LineRuns`` keeps what has been seen as *runs*: tables bucketed and sorted by line hash, so that a new batch joins
them without moving them. Each batch merge-anti-joins the runs: lines that a run has already settled (found in
``min_docs`` documents, their largest document known) stay out, and what is left becomes a run of its own. Once a level
holds ``fanout`` runs, they are merged into one run of the next level, which adds up their counts. ``dedup_lines`` feeds
it the documents in batches of falling ``doc_id``, so the first document counted for a line is the one that keeps it.

Defined cases: null and empty texts are one empty line; rows that share a ``doc_id`` are one document; a null
``doc_id`` counts as one document below all others; lines shorter than ``min_chars`` are never dropped; extra columns
pass through (columns named like the operator's own outputs are replaced).
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._store import bucketed, discard, materialise, shared_path

SPACES = " \t\n\x0b\f\r"
#: Stands for a null doc_id.
NO_ID = -(2**63)
RUN = "k binary, n long, last long"


def ascii_lower(x: Column) -> Column:
    """A-Z lower-cased and nothing else (``lower`` is the fast path where there is nothing else)."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(
        F.translate(x, string.ascii_uppercase, string.ascii_lowercase)
    )


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACES)))


def line_hash(key: Column) -> Column:
    return F.unhex(F.md5(key.cast("binary")))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs of RUN: a line's hash, the documents counted and the largest of them."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout, self.buckets = spark, min_docs, fanout, buckets
        self.levels: list[list[tuple[DataFrame, str]]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        path = shared_path(self.spark, "line-run")
        run = bucketed(rows.select("k", "n", "last"), "k", path, self.buckets, sort=True)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((run, path))

    def add(self, batch: DataFrame) -> None:
        """``batch``: one row (RUN) per distinct line of documents below all earlier ones."""
        for run, _ in (x for level in self.levels for x in level):
            settled = run.where(F.col("n") >= self.min_docs).select("k").hint("merge")
            batch = batch.join(settled, "k", "left_anti")
        self._write(batch, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._merge([self.levels[level]], level + 1)
            level += 1

    def _merge(self, levels: list[list[tuple[DataFrame, str]]], to: int) -> None:
        runs = [x for level in levels for x in level]

        def both(a: DataFrame, b: DataFrame) -> DataFrame:  # a merge join of what is bucketed alike: nothing moves
            rows = a.join(b.withColumnsRenamed({"n": "n_", "last": "last_"}).hint("merge"), "k", "full")
            return rows.select("k", (F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))).alias("n"), F.greatest("last", "last_").alias("last"))

        merged = reduce(both, (run for run, _ in runs))
        for level in levels:
            level.clear()
        self._write(merged, to)
        for _, path in runs:
            discard(self.spark, path)

    def totals(self) -> DataFrame:
        """Every line seen: hash, documents counted (from ``min_docs`` on, perhaps not all), largest document."""
        if sum(map(len, self.levels)) > 1:
            self._merge([level for level in self.levels if level], len(self.levels))
        (_, path), *_ = (x for level in self.levels for x in level)
        return self.spark.read.schema(RUN).parquet(path)  # by its path: a join may then deal it out anew and split hot lines


def line_postings(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(k, doc)``: each distinct line of at least ``min_chars`` code points of each row."""
    keys = F.filter(F.transform(text_lines(F.col("text")), line_key), lambda k: F.char_length(k) >= min_chars)
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.explode(F.array_distinct(keys)).alias("key")
    ).select(line_hash(F.col("key")).alias("k"), "doc")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, fanout: int = 2, least_batches: int = 4, batch_rows: int = 1 << 28) -> DataFrame:
    """``docs`` with the kept lines as ``text`` and the counts ``n_lines`` (before dropping) and ``n_dropped``.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code
    points in at least ``min_docs`` documents stay only in the largest ``doc_id`` that holds them. Batches are equal
    shares of the documents, ``least_batches`` of them, and more where a batch would have over ``batch_rows`` lines.
    """
    spark = docs.sparkSession
    posts = materialise(line_postings(docs, min_chars), "line-postings")
    batches = max(least_batches, -(-posts.count() // batch_rows))
    shares = [1 - k / batches for k in range(1, batches)]
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"))
    rows, distinct = ids.agg(F.count("*"), F.countDistinct("doc")).first()
    edges = ids.agg(F.percentile_approx("doc", shares, 1000 * batches)).first()[0]
    counted = posts if rows == distinct else posts.distinct()
    runs, above = LineRuns(spark, min_docs, fanout), None
    for edge in [*sorted(set(edges or []), reverse=True), None]:  # from the largest documents down
        batch = counted if edge is None else counted.where(F.col("doc") > edge)
        batch = batch if above is None else batch.where(F.col("doc") <= above)
        runs.add(batch.groupBy("k").agg(F.count("*").alias("n"), F.max("doc").alias("last")))
        above = edge
    common = runs.totals().where(F.col("n") >= min_docs).select("k", "last")
    drops = posts.join(common, "k").where(F.col("doc") != F.col("last")).groupBy("doc").agg(F.collect_set("k").alias("__drops"))
    keep = F.filter(
        F.col("__lines"),
        lambda x: ~F.when(F.char_length(line_key(x)) >= min_chars, F.array_contains("__drops", line_hash(line_key(x)))).otherwise(False),
    )
    out = (
        docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
        .join(drops.withColumnRenamed("doc", "__doc").hint("shuffle_hash"), "__doc", "left")
        .withColumn("__lines", text_lines(F.col("text")))
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("__kept", F.when(F.col("__drops").isNull(), F.col("__lines")).otherwise(keep))
        .withColumn("n_dropped", (F.col("n_lines") - F.size("__kept")).cast("long"))
        .withColumn("text", F.array_join("__kept", "\n"))
    )
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*names, "n_lines", "n_dropped")
