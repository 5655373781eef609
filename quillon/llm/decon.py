"""Benchmark decontamination by greedy string tiling.

Texts are sequences of lower-case tokens (runs of letters and digits; single characters in scripts without spaces). Documents and benchmark items are joined on seeds,
the hashes of ``seed`` consecutive tokens; a (document, item) pair with seeds in common is then tiled: the longest match
between unmarked tokens is marked on both sides, again and again, until none of ``seed`` tokens is left. A match of L
tokens is a run of L - seed + 1 seeds on one diagonal, so running Karp-Rabin hashes are all that has to be compared. The
share of the item's tokens under tiles is its coverage: passages whose parts were reordered are covered as well.

The seeds that tasks filter by are held in sorted blocks of at most ``block_seeds`` hashes; a larger benchmark takes more
passes over the documents, one after the other, never more memory.

Defined cases: rows of the benchmark that share an item_id are texts of their own, and the item has the coverage of the one
that is covered most; null and empty texts match nothing; an item of fewer tokens than ``seed`` is one seed of its own length
and an item without tokens matches nothing; rows that share a doc_id are judged by their own texts, and those that share
the text too get the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._bytes import chunks, mix, token_spans, word_hash
from quillon.llm._store import materialise

def seeds_of(texts: pa.Array, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk: (row, token position, seed hash, tokens in the row) of all runs of ``sizes`` tokens."""
    for a, _, data, offsets in chunks(texts):
        start, end, row = token_spans(data, offsets)
        if not len(start):
            continue
        token = word_hash(data, start, end)
        n = np.bincount(row, minlength=len(offsets) - 1)
        place = np.arange(len(token)) - np.concatenate([[0], np.cumsum(n)])[row]
        for size in sizes:
            if len(token) < size:
                continue
            h = np.full(len(token) - size + 1, np.uint64(size))
            for k in range(size):
                h = mix(h * np.uint64(3) + token[k : len(token) - size + 1 + k])
            ok = place[: len(h)] + size <= n[row[: len(h)]]
            at = row[: len(h)][ok]
            yield at + a, place[: len(h)][ok], h[ok].view(np.int64), n[at]


SEEDS = "item_id long, t long, ipos int, size int, n_item int, seed long"


def item_seeds(benchmark: DataFrame, seed: int) -> DataFrame:
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size in range(1, seed + 1):
                for row, place, h, n in seeds_of(batch.column(2), [size]):
                    ok = (size == seed) | (n == size)
                    k = int(ok.sum())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row[ok])), batch.column(1).take(pa.array(row[ok])), pa.array(place[ok].astype(np.int32)), pa.array(np.full(k, size, np.int32)), pa.array(n[ok].astype(np.int32)), pa.array(h[ok])],
                        ["item_id", "t", "ipos", "size", "n_item", "seed"],
                    )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("t"), F.lower("text").alias("text"))
    return rows.dropDuplicates(["item_id", "t"]).mapInArrow(make, SEEDS)


def seed_hits(docs: DataFrame, seeds: DataFrame, block_seeds: int) -> DataFrame:
    """``doc_id, h, dpos, seed``: where documents hold seeds of the benchmark."""
    spark = docs.sparkSession
    known = seeds.select("seed").distinct()
    blocks = max(1, -(-known.count() // block_seeds))
    sizes = [r[0] for r in seeds.select("size").distinct().collect()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.lower("text").alias("text"))
    out = None
    for k in range(blocks):
        some = known.where(F.pmod("seed", F.lit(blocks)) == k).toPandas()["seed"].to_numpy(np.int64)
        held = spark.sparkContext.broadcast(np.sort(some))

        def find(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            wanted = held.value
            for batch in batches:
                for row, place, h, _ in seeds_of(batch.column(2), sizes):
                    at = np.searchsorted(wanted, h)
                    hit = np.flatnonzero((at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == h)) if len(wanted) else []
                    if len(hit):
                        take = pa.array(row[hit])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(take), batch.column(1).take(take), pa.array(place[hit].astype(np.int32)), pa.array(h[hit])],
                            ["doc_id", "h", "dpos", "seed"],
                        )

        found = rows.mapInArrow(find, "doc_id long, h long, dpos int, seed long")
        found = materialise(found, "hits")  # so that the block's seeds can go before the next block's come
        held.destroy()
        out = found if out is None else out.unionAll(found)
    return out


def tile(dpos: np.ndarray, ipos: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document position, item position, tokens) from the common seeds of one pair."""
    order = np.lexsort((dpos, dpos.astype(np.int64) - ipos))
    d, i = dpos[order].astype(np.int64), ipos[order].astype(np.int64)
    tiles: list[tuple[int, int, int]] = []
    while len(d):
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] - i[1:] != d[:-1] - i[:-1]) | (d[1:] != d[:-1] + 1)
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(d)))
        best = int(length.max())
        marked_d, marked_i = [], []
        for k in first[length == best]:
            a, b, n = int(d[k]), int(i[k]), best + size - 1
            if all(a >= y or a + n <= x for x, y in marked_d) and all(b >= y or b + n <= x for x, y in marked_i):
                tiles.append((a, b, n))
                marked_d.append((a, a + n))
                marked_i.append((b, b + n))
                if len(marked_i) * size > int(i.max()) + size:
                    break
        free = np.ones(len(d), bool)
        for (x, y), (u, v) in zip(marked_d, marked_i, strict=True):
            free &= ((d + size <= x) | (d >= y)) & ((i + size <= u) | (i >= v))
        d, i = d[free], i[free]
    return tiles


def contamination(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.5, block_seeds: int = 1 << 22) -> DataFrame:
    """``doc_id, h, item_id, coverage, n_tiles`` of the pairs whose item is covered by at least ``coverage``
    (h: xxhash64 of the text)."""
    seeds = materialise(item_seeds(benchmark, seed), "item-seeds")
    hits = seed_hits(docs, seeds, block_seeds).distinct()
    pairs = hits.join(seeds, "seed").select("doc_id", "h", "item_id", "t", "dpos", "ipos", "size", "n_item")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        size, n = int(pdf["size"].iloc[0]), int(pdf["n_item"].iloc[0])
        tiles = tile(pdf["dpos"].to_numpy(), pdf["ipos"].to_numpy(), size)
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "h": pdf["h"].iloc[:1], "item_id": pdf["item_id"].iloc[:1], "t": pdf["t"].iloc[:1], "coverage": sum(x[2] for x in tiles) / n, "n_tiles": len(tiles)})

    # a pair whose seeds touch too few of the item's tokens can't reach the coverage, whatever the tiles
    touched = pairs.select("doc_id", "h", "item_id", "t", "n_item", F.explode(F.sequence("ipos", F.col("ipos") + F.col("size") - 1)).alias("at")).groupBy("doc_id", "h", "item_id", "t", "n_item").agg(F.countDistinct("at").alias("n"))
    able = touched.where(F.col("n") >= coverage * F.col("n_item")).select(*(F.col(c).alias(f"{c}_") for c in ("doc_id", "h", "item_id", "t")))
    on: Column = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("h") == F.col("h_")) & F.col("item_id").eqNullSafe(F.col("item_id_")) & (F.col("t") == F.col("t_"))
    judged = pairs.join(able, on, "left_semi").groupBy("doc_id", "h", "item_id", "t").applyInPandas(judge, "doc_id long, h long, item_id long, t long, coverage double, n_tiles int")
    best = judged.where(F.col("coverage") >= coverage).groupBy("doc_id", "h", "item_id").agg(F.max(F.struct("coverage", "n_tiles")).alias("b"))
    return best.select("doc_id", "h", "item_id", "b.coverage", "b.n_tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.5) -> DataFrame:
    """``docs`` with ``n_items`` (benchmark items it holds), ``worst`` (highest coverage, 0 if none) and ``item_ids``."""
    found = contamination(docs, benchmark, seed, coverage).groupBy("doc_id", "h").agg(
        F.count("*").alias("n_items"), F.max("coverage").alias("worst"), F.sort_array(F.collect_list("item_id")).alias("item_ids")
    )
    found = found.withColumnsRenamed({"doc_id": "__id", "h": "__h"})
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h"))
    names = [c for c in docs.columns if c not in ("n_items", "worst", "item_ids")]
    return docs.select(*names).join(found.hint("shuffle_hash"), on, "left").select(
        *names, F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("worst", F.lit(0.0)).alias("worst"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids")
    )
