"""Removal of repeated byte strings by bucket refinement at sampled offsets.

A byte is removed if a string of ``size`` bytes that covers it starts anywhere else in the corpus, in the same document
included. Sorting all suffixes is avoided, and so is a row for every offset: of the ``gram``-byte grams inside each window
of ``size`` bytes, the one with the least hash is the window's anchor, so equal windows have equal anchors at equal
places, and a text has an anchor in about ``2 / (size - gram)`` of its positions.

0. Texts are packed into compressed blocks, a table bucketed by block: from then on only offsets move, never texts.
1. Buckets: anchors with the same gram. Alone in its bucket, an anchor's windows occur once.
2. Members whose whole stretches (what the windows of one anchor cover) agree are repeated; each kind of stretch goes on
   as one member.
3. Refinement: a member's windows are divided into sections by their offset from the anchor. The windows of a section
   have a core in common, longer than that of the section above. The identifier of the core's bytes at the earlier and
   later offsets refines the bucket's identifier, and only buckets that still have several members go on: a member that
   is alone is not repeated, members whose whole sections agree are, the rest is divided again, down to single windows.

This departs from bucket-pointer refinement over all offsets in two points: only sampled offsets have rows (one of 8 bytes
for every offset would be several times the input), and identifiers are hashes (of 128 bits once a bucket is refined), so
that they need no sort to be named.

Counting is partial aggregation and a join by identifier, never a group in one task. Defined cases: null texts are empty;
texts of fewer bytes than ``size`` lose nothing; repeated rows are repeated strings; rows that share a doc_id are texts of
their own; matches may start inside a character (the kept bytes are then not valid UTF-8 and are given as binary); columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._bytes import CHUNK, chunks, mix, prefix_hash, span_hash
from quillon.llm._store import bucketed, materialise, shared_path

#: Identifiers of gram and stretch, block and offset of the anchor, first window (before the anchor) and their number.
ANCHORS = "h long, f long, block long, a int, dn int"
#: Numbers of windows in the sections of the refinement's rounds.
SECTIONS = (33, 7, 1)
BLOCK_BYTES = 4 << 20


def window_anchors(data: np.ndarray, offsets: np.ndarray, size: int, gram: int):
    """(row, anchor, first window, number of windows, gram hash, stretch hash) of the anchors of a chunk, positions in
    the chunk. Of equal hashes the leftmost is the anchor."""
    starts = np.flatnonzero(np.diff(offsets) >= size)
    if not len(starts):
        return None
    pre = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    h = span_hash(pre, at, at + gram)
    low = h & ~np.uint64(2**24 - 1)
    wide = size - gram + 1
    out = []
    for lo in range(0, len(data), 1 << 23):  # positions fit into 24 bits beside the hash
        part = low[lo : lo + (1 << 23) + wide] | np.arange(len(low[lo : lo + (1 << 23) + wide]), dtype=np.uint64)
        span = 1
        while span * 2 <= wide and len(part) > span:
            part = np.minimum(part[:-span], part[span:])
            span *= 2
        rest = wide - span
        if rest:
            part = np.minimum(part[:-rest], part[rest:]) if len(part) > rest else part[:0]
        out.append((part[: 1 << 23] & np.uint64(2**24 - 1)).astype(np.int64) + lo)
    anchor = np.concatenate(out)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    s = np.flatnonzero(row[: len(data) - size + 1] == row[size - 1 :])
    anchor = anchor[s]
    new = np.ones(len(s), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)
    first = s[new]
    last = s[np.append(np.flatnonzero(new)[1:], len(s)) - 1]
    anchor = anchor[new]
    f = mix(span_hash(pre, first, last + size) + mix((anchor - first).astype(np.uint64) * np.uint64(2**20) + (last - first).astype(np.uint64)))
    return row[first], anchor, first, last - first + 1, h[anchor], f


def text_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block, ids, sizes, data``: each task's texts in compressed blocks of about ``block_bytes`` bytes, one text at least."""
    names = ["block", "ids", "sizes", "data"]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, sizes, data, held = [], [], [], 0

        def done() -> pa.RecordBatch:
            packed = zstandard.ZstdCompressor(level=3).compress(b"".join(data))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.concatenate(ids).tolist()], pa.list_(pa.int64())), pa.array([np.concatenate(sizes)], pa.list_(pa.int32())), pa.array([packed], pa.binary())], names)

        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column(1)):
                ids.append(np.array(batch.column(0).slice(lo, hi - lo).to_pylist(), object))
                sizes.append(np.diff(offsets).astype(np.int32))
                data.append(raw.tobytes())
                held += len(raw) + 64 * (hi - lo)
                if held >= block_bytes:
                    yield done()
                    block, ids, sizes, data, held = block + 1, [], [], [], 0
        if ids:
            yield done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, "block long, ids array<long>, sizes array<int>, data binary")


def _opened(sizes: pa.Scalar, data: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """A block's bytes and the offsets of its texts."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_buffer()), np.uint8)
    return raw, np.concatenate([[0], np.cumsum(sizes.values.to_numpy(zero_copy_only=False).astype(np.int64))])


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first text, text after the last) of runs of texts of about CHUNK bytes: what is hashed at once."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1))
        yield i, j
        i = j


def anchors(blocks: DataFrame, size: int, gram: int) -> DataFrame:
    """ANCHORS of the texts, offsets in their blocks."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, data in zip(*batch.columns, strict=True):
                raw, offsets = _opened(sizes, data)
                for i, j in _pieces(offsets):
                    lo = offsets[i]
                    got = window_anchors(raw[lo : offsets[j]], offsets[i : j + 1] - lo, size, gram)
                    if got is not None:
                        _, a, first, n, h, f = got
                        columns = [pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), pa.array(np.full(len(a), block.as_py())), *(pa.array(x.astype(np.int32)) for x in (a + lo, (a - first) << 8 | n))]
                        yield pa.RecordBatch.from_arrays(columns, ["h", "f", "block", "a", "dn"])

    return blocks.select("block", "sizes", "data").mapInArrow(find, ANCHORS)


MEMBERS = ["x", "y", "a", "first", "n", "open"]
KINDS = "x long, y long, f long, g long, block long, a int, first int, n int, open boolean"


def divided(blocks: DataFrame, members: DataFrame, section: int, size: int, gram: int) -> DataFrame:
    """KINDS: the members (x, y: their bucket's identifier; block, a, first, n, open) cut into sections of windows, counted
    from the earliest window that the anchor can have. Their cores refine x and y; f and g name the whole section."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, data, rows in zip(*batch.columns, strict=True):
                raw, offsets = _opened(sizes, data)
                given = [rows.values.field(i).to_numpy(zero_copy_only=False) for i in range(len(MEMBERS))]
                order = np.argsort(given[3], kind="stable")
                given = [x[order] for x in given]
                for i, j in _pieces(offsets):
                    lo = offsets[i]
                    some = slice(*np.searchsorted(given[3], [lo, offsets[j]]))
                    if some.start < some.stop:
                        columns = _sections(raw[lo : offsets[j]], int(lo), *(x[some] for x in given), section, size, gram)
                        out = pa.table([*columns[:4], pa.array(np.full(len(columns[0]), block.as_py())), *columns[4:]], [x.split()[0] for x in KINDS.split(", ")])
                        yield from out.to_batches(65536)

    lists = members.groupBy("block").agg(F.collect_list(F.struct(*MEMBERS)).alias("m"))
    return blocks.join(lists, "block").select("block", "sizes", "data", "m").mapInArrow(cut, KINDS)


def _sections(raw: np.ndarray, lo: int, x, y, a, first, n, open_, section: int, size: int, gram: int) -> list[pa.Array]:
    q = first.astype(np.int64) - a + (size - gram)  # the first window, from the earliest on
    least, most = q // section, (q + n - 1) // section
    each = np.repeat(np.arange(len(q)), most - least + 1)
    b = least[each] + np.arange(len(each)) - np.repeat(np.cumsum(most - least + 1) - (most - least + 1), most - least + 1)
    low, high = b * section, np.minimum((b + 1) * section, size - gram + 1) - 1
    own, own_high = np.maximum(q[each], low), np.minimum((q + n - 1)[each], high)
    zero = (first - lo - q)[each]
    names = []
    for which, old in enumerate((x, y)):
        pre, old = prefix_hash(raw, which), old.view(np.uint64)[each]
        core = span_hash(pre, zero + high, zero + low + size, which)
        whole = span_hash(pre, zero + own, zero + own_high + size, which)
        names.append((mix(mix(old * np.uint64(3) + b.astype(np.uint64)) + core), mix(mix(old * np.uint64(5) + own.astype(np.uint64)) + whole)))
    (x, f), (y, g) = names
    return [*(pa.array(v.view(np.int64)) for v in (x, y, f, g)), *(pa.array(v.astype(np.int32)) for v in (a[each], zero + own + lo, own_high - own + 1)), pa.array(open_[each].astype(bool))]


def settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over KINDS, whose x and y name a bucket, and f and g what its members must agree in: the open members
    found to be repeated (block, first, n), and those that go on, one of each kind in buckets of several."""
    bucket, kind = ["x", "y"], ["x", "y", "f", "g"]
    kinds = rows.groupBy(*kind).agg(F.count("*").alias("m"), F.max("open").alias("some"), F.min(F.struct("block", "a", "first", "n")).alias("r"))
    kinds = materialise(kinds.withColumn("open", (F.col("m") == 1) & F.col("some")), "kinds")
    again = kinds.where("m > 1 AND some").select(*kind)
    mixed = kinds.groupBy(*bucket).agg(F.count("*").alias("kinds"), F.max("open").alias("any")).where("kinds > 1 AND any").select(*bucket)
    mixed = materialise(mixed, "mixed")
    repeated = rows.where("open").join(again, kind).select("block", "first", "n")
    return materialise(repeated, "repeated"), materialise(kinds.join(mixed, bucket).select(*bucket, "r.*", "open"), "members")


def repeated_spans(blocks: DataFrame, size: int = 200, gram: int = 40) -> DataFrame:
    """``block, first, n``: runs of repeated windows of ``size`` bytes, by block and offset; they may overlap."""
    found = anchors(blocks, size, gram)
    buckets = found.groupBy("h").agg(F.count("*").alias("c"), F.min("f").alias("lo"), F.max("f").alias("hi")).where("c > 1")
    buckets = materialise(buckets.select("h", (F.col("lo") == F.col("hi")).alias("alike")), "grams")  # a table: the join can then split a frequent gram
    shared = materialise(found.join(buckets, "h"), "buckets")
    first, n = F.col("a") - F.shiftright("dn", 8), F.col("dn").bitwiseAND(F.lit(255))
    out = shared.where("alike").select("block", first.alias("first"), n.alias("n"))
    h = F.col("h")
    mixed = shared.where("NOT alike").select(h.alias("x"), h.alias("y"), "f", F.col("f").alias("g"), "block", "a", first.alias("first"), n.alias("n"), F.lit(True).alias("open"))
    repeated, on = settle(mixed)
    out = out.unionAll(repeated)
    for section in SECTIONS:
        repeated, on = settle(materialise(divided(blocks, on, section, size, gram), "sections"))
        out = out.unionAll(repeated)
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, size: int = 200, gram: int = 40) -> DataFrame:
    """One row per row of ``docs`` (RESULT): the bytes kept, and how many bytes in how many runs were removed. ``size -
    gram`` is at most 254."""
    blocks = bucketed(text_blocks(docs), "block", shared_path(docs.sparkSession, "text-blocks"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, data, spans in zip(*batch.columns, strict=True):
                raw, offsets = _opened(sizes, data)
                depth = np.zeros(len(raw) + 1, np.int32)
                if spans.is_valid:
                    first, n = (spans.values.field(i).to_numpy() for i in range(2))
                    np.add.at(depth, first, 1)
                    np.add.at(depth, first + n - 1 + size, -1)
                gone = np.cumsum(depth[:-1], dtype=np.int32) > 0
                removed = np.concatenate([np.zeros(1, np.int32), np.cumsum(gone, dtype=np.int32)])
                starts = gone.copy()  # a run starts where a text does or a kept byte was before
                starts[1:] &= ~gone[:-1]
                inner = offsets[:-1][offsets[:-1] < len(raw)]
                starts[inner] |= gone[inner]
                runs = np.concatenate([np.zeros(1, np.int32), np.cumsum(starts, dtype=np.int32)])
                ends = offsets - removed[offsets]
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[~gone].tobytes())]).cast(pa.binary())
                count = lambda total: pa.array((total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64))
                yield from pa.Table.from_arrays([ids.values, pa.array(np.diff(offsets)), count(removed), count(runs), kept], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]).to_batches(8192)

    spans = repeated_spans(blocks, size, gram).distinct().groupBy("block").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    return blocks.join(spans, "block", "left").select("ids", "sizes", "data", "spans").mapInArrow(cut, RESULT)
