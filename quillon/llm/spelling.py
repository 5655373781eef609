"""Spelling variants of words, grouped by a symmetric-delete join.

1. Counting. Tasks find the runs of letters of whole texts, drop a letter of those that a hash of document and run picks,
   and add up the words that are left; a groupBy merges these counts. Words of at least ``least_chars`` code points and
   ``least_n`` occurrences go on, numbered in code-point order.
2. Symmetric deletes. Every word emits itself and its single deletions, each with the place of the letter that was deleted.
   Rows meet on equal keys, and the place makes their distance exact without spelling out pairs: words that give the same key
   by deleting at the *same* place differ there by one replaced letter and nowhere else; a word that equals another's
   deletion differs from it by one inserted letter. (The same key at different places is two edits apart, or a pair that
   another key of theirs finds, and doesn't count.) A deletion that several places give, in a run of equal letters, counts
   once against the word that equals it. So a key's rows need only its groups' sizes and two best members, by windows: as
   many rows leave as came, and a key has at most (alphabet x length) rows, however many words there are.
3. Forms. The counts and best neighbours of all keys of a word are added up; its form is its most frequent near word if that
   is at least ``ratio`` times as frequent. Chains of forms rise in frequency by that ratio, so that a few rounds of joining
   each root with its own root reach their ends.

Keys are the strings themselves. Keys of over ``LONG`` code points are two rolling hashes of them modulo 2**61 - 1 with
bases drawn for every call, as spelling out n deletions of n letters would grow with the square of n.

Defined cases: null, empty and letterless texts have no words; a null doc_id counts as an empty string in the hash; repeated
rows count again; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._bytes import LOWER, chunks, word_spans
from quillon.llm._crc import crc_of, joined
from quillon.llm._store import materialise

#: Code points up to which keys are spelt out.
LONG = 100
PRIME = 2**61 - 1
KEYS = "key string, place long, first boolean, id long, n long"


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of A-Z, a-z and U+00C0 to U+00FF, which are the bytes C3 and one after it."""
    inside = np.zeros(256, bool)
    inside[[*range(65, 91), *range(97, 123)]] = True
    mask, wide = inside[data], data == 0xC3
    mask |= wide
    mask[1:] |= wide[:-1]
    flags = np.zeros(256, bool)
    flags[1] = True
    return word_spans(mask.view(np.uint8), offsets, flags)


def word_counts(docs: DataFrame, one_in: int, least_chars: int, max_words: int) -> DataFrame:
    """``word, n``: a row per word and task, or more once a task holds ``max_words``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, data, offsets in chunks(batch.column(1)):
                data = LOWER[data]
                start, end, row = letter_runs(data, offsets)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                length = chars[end] - chars[start]
                keep = length >= least_chars
                start, end, row, length = start[keep], end[keep], row[keep], length[keep]
                if not len(start):
                    continue
                lead = np.concatenate([[0], np.cumsum(end - start)])
                spots = np.repeat(start - lead[:-1], end - start) + np.arange(lead[-1])
                runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(lead), pa.py_buffer(data[spots])]).dictionary_encode()
                listed, code = runs.dictionary.to_pylist(), runs.indices.to_numpy()
                prefix = crc_of([f"{'' if i is None else i}:".encode() for i in ids[a:b]])
                crc = joined(prefix[row], crc_of(listed)[code], end - start)
                hit = crc % np.uint32(one_in) == 0
                times = np.bincount(code[~hit], minlength=len(listed))
                for word, n in zip(listed, times.tolist(), strict=True):
                    if n:
                        counts[word] = counts.get(word, 0) + n
                for k in np.flatnonzero(hit).tolist():
                    if length[k] > least_chars:
                        word, at = listed[code[k]].decode(), int(crc[k]) % int(length[k])
                        word = (word[:at] + word[at + 1 :]).encode()
                        counts[word] = counts.get(word, 0) + 1
                if len(counts) > max_words:
                    yield rows()
                    counts = {}
        yield rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")


def _powers(base: int, n: int) -> list[int]:
    out = [1]
    for _ in range(n):
        out.append(out[-1] * base % PRIME)
    return out


def deletions(word: str, bases: tuple[int, int], long: int = LONG) -> Iterator[tuple[str, int, bool]]:
    """(key, place, is it the first place that gives this key): the word itself at place -1, then its single deletions."""
    n = len(word)
    hashes = []
    if n > long:
        for base in bases:
            front, power = [0], _powers(base, n)
            for c in word:
                front.append((front[-1] * base + ord(c) + 1) % PRIME)
            hashes.append((front, power))

    def key(at: int) -> str:
        if n - (at >= 0) <= long:
            return word if at < 0 else word[:at] + word[at + 1 :]
        if at < 0:
            return "#" + ":".join(f"{front[n]:x}" for front, _ in hashes)
        back = n - at - 1  # letters after the deleted one
        return "#" + ":".join(f"{(front[at] * power[back] + front[n] - front[at + 1] * power[back]) % PRIME:x}" for front, power in hashes)

    yield key(-1), -1, True
    for at in range(n):
        yield key(at), at, at == 0 or word[at] != word[at - 1]


def emitted(words: DataFrame, long: int = LONG) -> DataFrame:
    """KEYS of ``words`` (id, word, n)."""
    bases = (secrets.randbelow(PRIME - 2**32) + 2**31, secrets.randbelow(PRIME - 2**32) + 2**31)
    names = [x.split()[0] for x in KEYS.split(", ")]

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for key, place, first in deletions(word, bases, long):
                    out.append((key, place, first, i, n))
                    if len(out) == 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names)

    return words.select("id", "word", "n").mapInArrow(emit, KEYS)


def near_words(words: DataFrame, long: int = LONG) -> DataFrame:
    """``id, n_near, best``: how many words are near each word that has any, and the most frequent of them as (n, -id)."""
    rows = emitted(words, long).withColumn("own", F.struct("n", (-F.col("id")).alias("o")))
    key, deleted = Window.partitionBy("key"), F.col("place") >= 0
    group = Window.partitionBy("key", "place")
    ranked = group.orderBy(F.col("own").desc())
    told = rows.select(
        "id", "place", "first", "own",
        F.count("*").over(group).alias("size"), F.lag("own").over(ranked).alias("better"), F.lead("own").over(ranked).alias("next"), F.max("own").over(group).alias("top"),
        F.max(F.when(~deleted, F.col("own"))).over(key).alias("equal"),
        F.count(F.when(deleted & F.col("first"), 1)).over(key).alias("longer"), F.max(F.when(deleted & F.col("first"), F.col("own"))).over(key).alias("longest"),
    )
    replaced = F.when(deleted, F.col("size") - 1).otherwise(0)
    other = F.when(deleted, F.when(F.col("better").isNull(), F.col("next")).otherwise(F.col("top")))
    inserted = F.when(~deleted, F.col("longer")).otherwise(F.when(F.col("first") & F.col("equal").isNotNull(), 1).otherwise(0))
    through = F.when(~deleted, F.col("longest")).otherwise(F.when(F.col("first"), F.col("equal")))
    found = told.select("id", (replaced + inserted).alias("k"), F.greatest(other, through).alias("best")).where("k > 0")
    return found.groupBy("id").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``id, root`` from ``id, form``: each id's form's form's... that has none itself."""
    now, left = materialise(forms.select("id", F.col("form").alias("root")), "roots"), True
    while left:
        ahead = now.select(F.col("id").alias("root"), F.col("root").alias("ahead"))
        now = materialise(now.join(ahead, "root", "left").select("id", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        left = bool(now.where("moved").head(1))
    return now.select("id", "root")


def spelling_groups(docs: DataFrame, one_in: int = 31, least_chars: int = 7, least_n: int = 2, ratio: int = 10, max_words: int = 1 << 19, long: int = LONG) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: one row per word."""
    counted = word_counts(docs, one_in, least_chars, max_words).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)
    counted = materialise(counted, "counted")  # the ranges of words are drawn from it, then it is read again
    words = materialise(counted.repartitionByRange("word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id()), "words")
    near = materialise(near_words(words, long), "near")
    best = words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.o")).alias("form"), F.col("best.n").alias("form_n"))
    best = materialise(best.withColumn("form", F.when(F.col("form_n") >= ratio * F.col("n"), F.col("form"))), "forms")
    of = roots(best.where("form IS NOT NULL"))
    named = words.select("id", "word")
    pairs = best.where("form IS NOT NULL").join(of, "id")
    pairs = pairs.join(named.toDF("form", "form_word"), "form").join(named.toDF("root", "root_word"), "root")
    exact = pairs.where(F.levenshtein("word", "form_word", 1) == 1)  # what the keys promise, checked on the words themselves
    out = best.select("id", "word", "n", "n_near").join(exact.select("id", "form_word", "root_word", "form_n"), "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
