"""BPE encoding and decoding through a table of distinct words.

1. Tasks split their documents into words by the tokenizer's own rules, in blocks of bounded size. A block is stored once:
   its distinct words, each with its index in the block, and its documents as sequences of such indexes (packed).
2. The distinct words of all blocks are encoded, each once. Decoding joins their ids with the id-to-piece table (as large
   as the vocabulary, and so broadcast): the text that a word's ids decode to is made once as well.
3. A join by word and one by block bring ids and decoded words back; a block's sequences are then filled in by position.
   The blocks are a table bucketed by block, so the sequences themselves never move.

The vocabulary file is a parameter: a ``tokenizers`` JSON file with BPE, a splitting pattern and no decoder, so that the
pieces of a text are those of its words, joined by spaces. Defined cases: a null text is empty, an empty text has no ids;
repeated rows and repeated or null doc_ids are rows of their own; other columns are not carried along.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._store import bucketed, materialise, shared_path

BLOCK_CHARS = 32 << 20
_LETTER = "a-zªµºß-öø-ÿ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t\n\x0b\f\r \x85\xa0"
#: The word pattern of the vocabulary, for lower-case texts of Latin-1 characters only.
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: The splitting pattern that LATIN stands for; vocabularies with another one are split by the library alone.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Words:
    """The vocabulary file, as a splitter of texts and an encoder of single words."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        spec = json.load(open(path, encoding="utf-8"))
        first, *rest = spec["pre_tokenizer"]["pretokenizers"]
        pattern = first["pattern"]["Regex"]
        whole = Tokenizer.from_file(path)
        self.normalizer, self.split = whole.normalizer, Split(Regex(pattern), "removed", invert=True)
        self.latin = pattern == PATTERN
        special = [x["content"] for x in spec["added_tokens"]]
        self.special, self.names = re.compile("(" + "|".join(map(re.escape, special)) + ")"), set(special)
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": rest[0], "truncation": None, "padding": None}))
        self.size = whole.get_vocab_size(with_added_tokens=True)
        self.pieces = [whole.id_to_token(i) for i in range(self.size)]

    def words(self, text: str) -> list[str]:
        if not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return [w for x in parts for w in ([x] if x in self.names else self._plain(x))]

    def _plain(self, text: str) -> list[str]:
        if self.latin and (text.isascii() or _is_latin(text)):
            return LATIN.findall(text.lower())
        return [w for w, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def encode(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch(words, add_special_tokens=False)]


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(path)


def _planes(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes | pa.Buffer) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)


#: A word's place: its block in the high bits, its index in the low ones (a block has fewer characters than 2**IDX_BITS).
IDX_BITS = 28
BLOCKS = "block long, at long, word string, ids array<long>, counts array<int>, codes binary"


def split_blocks(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """BLOCKS: a row per distinct word of each block (at, word), and a row with the block's documents (ids, counts,
    codes). The indexes fall with the words' frequency to a power of two, and rise with the words among those: codes and
    words both pack well. A block ends before it has 2**IDX_BITS characters, unless it is one text."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, words = TaskContext.get().partitionId(), 0, vocabulary(path)
        index: dict[str, int] = {}
        ids: list = []
        counts: list[int] = []
        codes: list[np.ndarray] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            block = (part << 16) + number
            all_codes = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
            listed, counted = list(index), np.bincount(all_codes, minlength=len(index))
            by_word = np.array(sorted(range(len(listed)), key=listed.__getitem__), np.int64)
            order = by_word[np.argsort(-np.log2(np.maximum(counted[by_word], 1)).astype(np.int8), kind="stable")]
            rank = np.empty(len(index), np.uint32)
            rank[order] = np.arange(len(index), dtype=np.uint32)
            if len(index) > 2**IDX_BITS:
                raise ValueError("a text has more distinct words than a block can number")
            for a in range(0, len(listed), 50_000):
                some = order[a : a + 50_000]
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array((block << IDX_BITS) + np.arange(a, a + n)), pa.array([listed[i] for i in some], pa.string()), *(pa.nulls(n, t) for t in types[3:])],
                    names,
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([ids], types[3]), pa.array([counts], types[4]), pa.array([_pack(_planes(rank[all_codes]))], types[5])],
                names,
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = words.words(text)
                own = np.fromiter((index.setdefault(w, len(index)) for w in found), np.uint32, len(found))
                ids.append(doc_id.as_py())
                counts.append(len(found))
                codes.append(own)
                size += len(text)
                if size >= block_chars:
                    yield from done()
                    index, ids, counts, codes, size, number = {}, [], [], [], 0, number + 1
        if ids:
            yield from done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, BLOCKS)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """``id, piece``: one row per id of the vocabulary."""
    pieces = vocabulary(path).pieces
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(pieces)), pa.int32()), "piece": pa.array(pieces, pa.string())}))


def word_table(words: DataFrame, path: str, decode: bool, buckets: int) -> DataFrame:
    """``word, ids, decoded`` of the distinct ``word``s: each is encoded once, and its ids are joined with their pieces."""

    @F.pandas_udf("array<int>")
    def encode(words):
        import pandas as pd

        return pd.Series(vocabulary(path).encode(words.tolist()))

    coded = words.select("word", encode("word").alias("ids"))
    if not decode:
        return coded.withColumn("decoded", F.lit(""))
    coded = coded.repartition(buckets, "word")  # before the ids become rows: these and the join by word then stay in place
    each = coded.select("word", "ids", F.posexplode_outer("ids").alias("pos", "id")).join(F.broadcast(piece_table(words.sparkSession, path)), "id", "left")
    piece = F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"])
    return each.groupBy("word").agg(F.first("ids").alias("ids"), F.array_join(piece, " ").alias("decoded"))


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (of, idx, ids, decoded) sorted by ``of``, those of one block packed into one row."""
    for batch in batches:
        of = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        out = []
        for i, j in zip(edges, edges[1:], strict=False):
            if i < j:
                _, idx, ids, decoded = batch.slice(i, j - i).columns
                flat, text = ids.flatten().to_numpy(), "".join(decoded.to_pylist()).encode()
                sizes = [len(flat), j - i]
                numbers = [idx.to_numpy(), pc.list_value_length(ids).to_numpy(), pc.binary_length(decoded).to_numpy(), flat]
                out.append((of[i], _pack(np.array(sizes, "<u4").tobytes() + b"".join(map(_planes, numbers)) + text)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["of", "words"])


def _unpacked(packs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(place of each index, lengths, ids, decoded words) of a block's packs; a place is a row of what follows it."""
    idx, lengths, ids, words = [], [], [], []
    for pack in packs:
        raw = _unpack(pack.as_buffer())
        flat, n = (int(x) for x in raw[:8].view("<u4"))
        ends = 8 + 4 * np.cumsum([n, n, n, flat])
        parts = [_numbers(raw[a:b]) for a, b in zip([8, *ends[:-1]], ends, strict=True)]
        idx.append(parts[0])
        lengths.append(parts[1])
        ids.append(parts[3].astype(np.int32))
        words.append(pa.StringArray.from_buffers(n, pa.py_buffer(_offsets(parts[2]).astype(np.int32)), pa.py_buffer(raw[ends[-1] :].tobytes())))
    idx = np.concatenate(idx)
    place = np.empty(len(idx), np.int32)
    place[idx] = np.arange(len(idx), dtype=np.int32)
    return place, np.concatenate(lengths).astype(np.int32), np.concatenate(ids), pa.concat_arrays(words)


CODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def _fill(left: pa.Table, right: pa.Table) -> pa.Table:
    """CODED rows of a block from its sequences and its packed words, some 500,000 words at once."""
    out: list[pa.Table] = []
    if right.num_rows:
        place, lengths, ids, words = _unpacked(right.column("words"))
        starts, full = _offsets(lengths), lengths > 0
    for row in left.to_pylist():
        codes, counts = _numbers(_unpack(row["codes"])), np.asarray(row["counts"], np.int64)
        ends, doc = _offsets(counts), 0
        while doc < len(counts):
            last = max(doc + 1, int(np.searchsorted(ends, ends[doc] + 500_000, "right")) - 1)
            n = last - doc
            if ends[last] == ends[doc]:
                listed, text = pa.array([[]] * n, CODED.field(1).type), pa.array([""] * n, pa.string())
            else:
                at = place[codes[ends[doc] : ends[last]]]
                before = _offsets(lengths[at])
                where = np.repeat(starts[at] - before[:-1], lengths[at]) + np.arange(before[-1])
                inner = ends[doc : last + 1] - ends[doc]
                listed = pa.ListArray.from_arrays(pa.array(before[inner].astype(np.int32)), pa.array(ids[where]))
                some = _offsets(full[at])
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(some[inner].astype(np.int32)), words.take(pa.array(at[full[at]]))), " ")
            out.append(pa.Table.from_arrays([pa.array(row["doc_ids"][doc:last], pa.int64()), listed, text], schema=CODED))
            doc = last
    return pa.concat_tables(out) if out else CODED.empty_table()


def code_documents(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS, decode: bool = True) -> DataFrame:
    """``doc_id, ids array<int>, decoded``: every row's text as the library encodes it without added special tokens, and
    what these ids decode to, special tokens included."""
    spark = docs.sparkSession
    blocks = bucketed(split_blocks(docs, path, block_chars), "block", shared_path(spark, "bpe-blocks"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one exchange serves both the distinct words and the join that brings their ids back
    each = blocks.where("word IS NOT NULL").select("word", "at").repartition(buckets, "word")
    words = each.groupBy("word").agg(F.min("at").alias("first")).where("first IS NOT NULL").select("word")
    back = each.join(word_table(words, path, decode, buckets).hint("merge"), "word").select(
        F.shiftright("at", IDX_BITS).alias("of"), F.col("at").bitwiseAND(F.lit(2**IDX_BITS - 1)).cast("int").alias("idx"), "ids", "decoded"
    )
    packs = back.sortWithinPartitions("of").mapInArrow(_packed, "of long, words binary")
    codes = blocks.where("codes IS NOT NULL").select("block", F.col("ids").alias("doc_ids"), "counts", "codes")
    return codes.groupBy("block").cogroup(packs.groupBy("of")).applyInArrow(_fill, "doc_id long, ids array<int>, decoded string")


def encode_documents(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, ids array<int>``: encoding alone."""
    return code_documents(docs, path, block_chars, decode=False).select("doc_id", "ids")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, whatever its ``ids`` are: every id is joined with its piece, and the pieces of a row
    are put together again by position. ``code_documents`` does this once per distinct word instead."""
    rows = materialise(encoded.drop("decoded").withColumn("__row", F.monotonically_increasing_id()), "encoded")
    each = rows.select("__row", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(piece_table(encoded.sparkSession, path)), "id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), " ")
    joined = rows.join(each.groupBy("__row").agg(text.alias("decoded")), "__row", "left")
    return joined.withColumn("decoded", F.coalesce("decoded", F.lit(""))).drop("__row")
