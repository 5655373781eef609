"""Target-distribution importance resampling by hashed word and word-pair features.

A document's features are its words and its pairs of neighbouring words. Their buckets are counted over all documents and
over a target (the benchmark texts); a bucket's gain is the logarithm of how much more frequent it is in the target. A
document's weight is the mean gain of its features, and documents are drawn without replacement by the highest sums of
weight and Gumbel noise.

Every task keeps a trie of the words that it meets: a node for each word below the root, and one for each word below
another. A node holds the CRC state of the path to it (a child continues its parent's state, so that no feature is ever
spelt out), and how often the path was walked. Counting walks the trie and gives out a total for each bucket; these totals
are merged by a groupBy over as many rows as tasks times buckets. Scoring walks such a trie again, with the bucket's gain
attached to every node. A trie that has reached ``max_nodes`` is given up for a new one, after its counts were taken: memory
is bounded and nothing is lost. Buckets' gains are broadcast, of which there are ``buckets``.

Ranks: scores are whole numbers of a range that doesn't grow with the rows, so their histogram gives the lowest score that
can be drawn; what lies above it is range-partitioned by score and doc_id, and every partition numbers its rows from the
number of rows before it. No task orders the table.

Defined cases: a null or wordless text has no features and weight 0; a null doc_id counts as an empty string in the noise
and comes last among ties; rows that share a doc_id are rows of their own, in any order among equals; no documents or no
target: all counts are 0 and the formula holds; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._bytes import LOWER, chunks, word_spans
from quillon.llm._crc import crc_of, joined
from quillon.llm._store import materialise

#: Digits, letters and all bytes of characters beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SCORED = "doc_id long, n_words long, n_features long, weight long"


class WordTrie:
    """Words below the root and words below words: CRC states, walks, and gains once they are attached."""

    def __init__(self, buckets: int, gains: np.ndarray | None = None):
        self.buckets, self.gains = buckets, gains
        self.words: dict[bytes, int] = {}
        self.state, self.spaced, self.length = (np.zeros(0, t) for t in (np.uint32, np.uint32, np.int64))
        self.path = np.zeros(0, np.int64)  # sorted: number of the upper word in the high half, of the lower one in the low
        self.path_state = np.zeros(0, np.uint32)
        self.walks, self.path_walks = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.words) + len(self.path)

    def number(self, words: pa.Array) -> np.ndarray:
        """The root's child of each word; words that are new get one."""
        coded = words.dictionary_encode()
        listed, known = coded.dictionary.to_pylist(), len(self.words)
        own = np.fromiter((self.words.setdefault(w, len(self.words)) for w in listed), np.int64, len(listed))
        fresh = [w for w, i in zip(listed, own.tolist(), strict=True) if i >= known]
        if fresh:
            state, length = crc_of(fresh), np.fromiter(map(len, fresh), np.int64, len(fresh)) + 1
            self.state = np.append(self.state, state)
            self.spaced = np.append(self.spaced, joined(crc_of([b" "]).repeat(len(fresh)), state, length - 1))
            self.length = np.append(self.length, length)
            self.walks = np.append(self.walks, np.zeros(len(fresh), np.int64))
        return own[coded.indices.to_numpy()]

    def below(self, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node of each distinct pair, index of each pair among them); pairs that are new get a node."""
        pairs, which = np.unique((upper << 32) | lower, return_inverse=True)
        at = np.searchsorted(self.path, pairs)
        new = np.ones(len(pairs), bool)
        new[at < len(self.path)] = self.path[at[at < len(self.path)]] != pairs[at < len(self.path)]
        if new.any():
            first, second = pairs[new] >> 32, pairs[new] & 0xFFFFFFFF
            state = joined(self.state[first], self.spaced[second], self.length[second])
            self.path, self.path_state = np.insert(self.path, at[new], pairs[new]), np.insert(self.path_state, at[new], state)
            self.path_walks = np.insert(self.path_walks, at[new], 0)
            at = np.searchsorted(self.path, pairs)
        return at, which

    def walk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row of each word, its node, row of each pair, nodes of the distinct pairs, index of each pair among those)."""
        data = LOWER[data]
        start, end, row = word_spans(data, offsets, WORD)
        ends = np.concatenate([[0], np.cumsum(end - start)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[WORD[data]])])
        node = self.number(words)
        same = np.flatnonzero(row[1:] == row[:-1])
        return row, node, row[same], *self.below(node[same], node[same + 1])

    def count(self, data: np.ndarray, offsets: np.ndarray) -> None:
        _, node, _, at, which = self.walk(data, offsets)
        self.walks += np.bincount(node, minlength=len(self.walks))
        self.path_walks[at] += np.bincount(which, minlength=len(at))

    def totals(self) -> np.ndarray:
        out = np.zeros(self.buckets, np.int64)
        np.add.at(out, self.state % np.uint32(self.buckets), self.walks)
        np.add.at(out, self.path_state % np.uint32(self.buckets), self.path_walks)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, sum of gains) of each row."""
        row, node, pair_row, at, which = self.walk(data, offsets)
        n = len(offsets) - 1
        gains = np.zeros(n, np.int64)
        np.add.at(gains, row, self.gains[self.state[node] % np.uint32(self.buckets)])
        np.add.at(gains, pair_row, self.gains[self.path_state[at] % np.uint32(self.buckets)][which])
        return np.bincount(row, minlength=n), gains


def bucket_totals(texts: DataFrame, buckets: int, max_nodes: int = 1 << 20) -> np.ndarray:
    """How often features of all ``text``s fall into each bucket."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, trie = np.zeros(buckets, np.int64), WordTrie(buckets)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                trie.count(data, offsets)
                if len(trie) > max_nodes:
                    out, trie = out + trie.totals(), WordTrie(buckets)
        out += trie.totals()
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(out[some])], ["bucket", "n"])

    merged = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[merged.column("bucket").to_numpy()] = merged.column("n").to_numpy()
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket."""
    k = len(source)
    ratio = (target + 1.0) * float(source.sum() + k) / ((source + 1.0) * float(target.sum() + k))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gains: np.ndarray, max_nodes: int = 1 << 20) -> DataFrame:
    """SCORED: a document's words, features and floored mean gain."""
    held, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(buckets, held.value)
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                n, total = trie.score(data, offsets)
                features = np.maximum(2 * n - 1, 0)
                weight = np.where(n > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x.astype(np.int64)) for x in (n, features, weight))], ["doc_id", "n_words", "n_features", "weight"])
                if len(trie) > max_nodes:
                    trie = WordTrie(buckets, held.value)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, SCORED)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 Gumbel) drawn by a hash of the seed and the doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` (materialised; doc_id, n_words, score) with ``rank``: 1, 2, 3... by falling score among the ``percent`` of
    documents with at least ``least_words`` words that are drawn, else null."""
    spark, able = scored.sparkSession, F.col("n_words") >= least_words
    # scores are whole numbers between bounds set by the formula: some 100,000 rows at most, however many documents
    counts = sorted(((r["score"], r["n"]) for r in scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    many, above, lowest = percent * sum(n for _, n in counts) // 100, 0, None
    for score, n in counts:
        if above >= many:
            break
        above, lowest = above + n, score
    none = F.lit(None).cast("long")
    if lowest is None:
        return scored.withColumn("rank", none)
    high = able & (F.col("score") >= lowest)
    place = F.monotonically_increasing_id()  # the partition's number, then the row's number in it
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = scored.where(high).repartitionByRange(*order, F.xxhash64("n_features", "weight")).sortWithinPartitions(*order)
    dealt = materialise(dealt.withColumn("__at", place), "drawn")
    part = F.shiftright("__at", 33)
    sizes, before, total = dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect(), [], 0
    for r in sizes:
        before.append((r["p"], total))
        total += r["n"]
    offsets = F.broadcast(spark.createDataFrame(before, "__p long, __before long"))  # a row per partition
    ranked = dealt.join(offsets, part == F.col("__p")).withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND(F.lit(2**33 - 1)) + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= many, F.col("rank"))).select(*scored.columns, "rank")
    return ranked.unionAll(scored.where(~high).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7, max_nodes: int = 1 << 20) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row; rows with a rank are drawn."""
    gains = gains_of(bucket_totals(docs, buckets, max_nodes), bucket_totals(target, buckets, max_nodes))
    scored = weights(docs, gains, max_nodes).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(materialise(scored, "weights"), percent, least_words)
