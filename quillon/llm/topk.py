"""Exact top-k search by an impact-ordered score-at-a-time index.

Vectors become integers, floor(scale * x). A shard's index has one posting list per component, ordered by falling
impact, the component's magnitude, and cut into segments of equal quantised impact. A query takes segments in the order
of the most they can add to a score (its own component times the impact), a round of segments at a time, into one
accumulator per vector. What is still to come is bounded by the heads of the lists left over; the query stops when that
bound proves that no more than a few vectors can be among its k best, or at the ends of the lists, and rescores exactly
those vectors. Shards meet the queries in blocks; each gives k rows a query, ranked over all shards in the end.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null
id; vectors only meet those of their own length; a query's own id is never its answer; of query rows that share an id the
smallest vector is asked; candidate rows that share an id are candidates of their own; ties go to the smaller id. Vectors
with a scaled component that no long holds take no part; scores that no long holds become the least or greatest long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm._store import materialise

SHARD, QUERIES = 16384, 1024
BLOCK = "dim int, block string, ids binary, data binary"


def blocks(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """BLOCK: up to ``size`` integer vectors of one length a row."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def row(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            number += 1
            return pa.RecordBatch.from_pydict(
                {"dim": pa.array([dim], pa.int32()), "block": [f"{part}-{number}"], "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([data.tobytes()], pa.binary())}
            )

        for batch in batches:
            ids, vec = batch.column(0).to_numpy(), batch.column(1)
            length = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
            values = pc.fill_null(vec.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
            for dim in np.unique(length):
                at = np.flatnonzero(length == dim)
                x = values[starts[at][:, None] + np.arange(dim)]
                x = np.floor(scale * x)
                fine = (np.abs(x) < 2.0**63).all(axis=1)
                for a in range(0, int(fine.sum()), size):
                    part_ids, part_x = ids[at[fine]][a : a + size], x[fine][a : a + size].astype(np.int64)
                    held.setdefault(int(dim), []).append((part_ids, part_x))
                    if sum(len(y[0]) for y in held[int(dim)]) >= size:
                        yield row(int(dim))
        for dim in list(held):
            yield row(dim)

    some = vectors.where("vec_id IS NOT NULL AND size(embedding) > 0")
    return some.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(pack, BLOCK)


class ImpactIndex:
    """Posting lists of one shard by falling impact, with the ends of their segments."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, levels: int = 64):
        self.ids, self.data = ids, data
        size = np.abs(data)
        self.most = int(size.max())
        self.order = np.argsort(-size, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(data, self.order.T, axis=0).T.copy()
        self.step = np.maximum(1, -(-size.max(axis=0) // levels))
        level = size // self.step  # quantised impact: a segment holds |x| from level * step to (level + 1) * step - 1
        self.top = level.max(axis=0)
        #: ends[d, l]: how many postings of d have a level of at least l
        self.ends = np.stack([np.bincount(level[:, d], minlength=levels + 2)[::-1].cumsum()[::-1] for d in range(data.shape[1])])

    def search(self, query: np.ndarray, own: int, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """(position, score) of the k best, and of all that tie with the last."""
        if len(query) * self.most * int(np.abs(query).max()) >= 2**62:  # sums may leave 64 bits
            may = np.flatnonzero(self.ids != own)
            exact = np.clip(self.data[may].astype(object) @ query.astype(object), -(2**63), 2**63 - 1).astype(np.int64)
            best = np.lexsort((self.ids[may], ~exact))[:k]
            return may[best], exact[best]
        n, weight = len(self.ids), np.abs(query)
        score = np.zeros(n, np.int64)
        there = self.ids != own
        done = np.zeros(len(query), np.int64)
        most = weight * ((self.top + 1) * self.step - 1)
        limit = int(most.max())
        for turn in range(rounds):
            limit = limit // 2 if turn < rounds - 1 else 0
            # segments whose postings can add more than limit: level l with weight * ((l + 1) * step - 1) > limit
            least = np.where(weight > 0, (limit // np.maximum(weight, 1) + 1) // self.step, self.top + 1)
            least = np.minimum(least, self.top + 1)
            for d in np.flatnonzero(least <= self.top):
                end = self.ends[d, least[d]]
                if end > done[d]:
                    score[self.order[d, done[d] : end]] += query[d] * self.values[d, done[d] : end]
                    done[d] = end
            rest = int((weight * np.maximum(least * self.step - 1, 0)).sum())
            good = score[there]
            if len(good) <= k:
                may = np.flatnonzero(there)
                break
            kth = np.partition(good, len(good) - k)[len(good) - k] - rest
            may = np.flatnonzero(there & (score + rest >= kth))
            if rest == 0 or len(may) <= 4 * k:
                break
        exact = self.data[may] @ query
        best = np.lexsort((self.ids[may], -exact))[:k]
        return may[best], exact[best]


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of the highest inner product for each query."""
    copies = max(64, 2 * -(-vectors.count() // SHARD))  # twice as many keys as shards: few shards share one
    shards = blocks(vectors, SHARD, scale).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    asked = queries.where(whole).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = materialise(blocks(asked, QUERIES, scale), "queries").select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("salt"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")
    )

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != last:
                    ids, last = np.frombuffer(row["ids"], np.int64), row["block"]
                    index = ImpactIndex(ids, np.frombuffer(row["data"], np.int64).reshape(len(ids), -1))
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                q_data = np.frombuffer(row["q_data"], np.int64).reshape(len(q_ids), -1)
                out: list[tuple] = []
                for own, query in zip(q_ids, q_data, strict=True):
                    at, score = index.search(query, own, k)
                    out.append((np.full(len(at), own), index.ids[at], score))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    found = shards.join(asked, ["dim", "salt"]).select("block", "ids", "data", "q_ids", "q_data").mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
