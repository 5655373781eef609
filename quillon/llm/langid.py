"""Language identification by sparse multinomial logistic regression on character n-grams.

Features are the runs of one to three characters of the lower-case text in which letters stand, with everything between
letters as one kind of space at a run's edges; they are hashed into ``2**bits`` buckets. A bucket's value is its share of the
document's n-grams (term frequency) times its inverse document frequency, which is counted over all documents that may be
learned from. The weights are trained by follow-the-regularised-leader with elastic-net penalties (each coordinate has a
learning rate of its own; the L1 part leaves most weights at exactly 0) on a bounded sample: of each language, about
``label_rows`` / languages rows or ``label_chars`` / languages characters, whichever is less, by a hash of doc_id and text. A
fifth of the sample is kept out of training and sets the temperature that divides the logits.

Counting and scoring pass over whole texts in tasks; a task holds one number per bucket, and the driver holds those numbers,
the sample's features (at most 3 x 8 bytes for each of ``label_chars`` characters) and the weights that aren't 0.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing can be learned
from (no row outside the held-out part that has a language and a letter); with one language, every other text gets it; null
languages are never learned; a null doc_id counts as an empty string in the hashes; repeated rows count again in the
document frequencies but are learned from once; ties go to the first language in order; extra columns pass through, except
those named like the results. More than ``max_langs`` languages are an error, as the model has a column for each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillon.llm._bytes import mix
from quillon.llm._labels import held_out

UNKNOWN = "und"
#: Characters handled at once; longer texts are taken in pieces that overlap by two.
PIECE = 1 << 19
#: Puts the vectors' lengths near 1, so that the usual rates of learning fit.
SCALE = 8.0


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def pieces(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, row of each, may an n-gram start here): texts one after the other, each between two spaces."""
    parts: list[tuple[int, str, int]] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(p for _, p, _ in parts).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(p) for _, p, _ in parts])
        starts = np.ones(len(codes), bool)
        for end, (_, p, n) in zip(np.cumsum(lengths).tolist(), parts, strict=True):
            starts[end - len(p) + n : end] = False
        return codes, np.repeat(np.array([row for row, _, _ in parts]), lengths), starts

    for row, text in enumerate(texts):
        text = f" {text.lower()} "
        for a in range(0, len(text), PIECE):
            part = text[a : a + PIECE + 2]
            last = a + PIECE >= len(text)
            parts.append((row, part if last else part + "  ", len(part) if last else PIECE))
            size += len(part)
            if size >= PIECE:
                yield out()
                parts, size = [], 0
    if parts:
        yield out()


def grams(texts: Iterable[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of the n-grams of each piece, ordered by row within each length of n-gram."""
    letters = _letters()
    for codes, row, start in pieces(texts):
        letter = letters[codes]
        c = np.where(letter, codes, 32).astype(np.uint64)
        n = len(c)
        bucket, of = [], []
        key = np.zeros(n, np.uint64)
        for size in (1, 2, 3):
            if n < size:
                break
            k = n - size + 1
            key = key[:k] | (c[size - 1 :] << np.uint64(21 * (size - 1)))
            ok = letter[:k] if size == 1 else letter[:k] | letter[1 : k + 1] if size == 2 else letter[1 : k + 1]
            ok = np.flatnonzero(ok & start[:k])
            bucket.append((mix(key[ok]) >> np.uint64(64 - bits)).astype(np.int64))
            of.append(row[ok])
        yield np.concatenate(bucket), np.concatenate(of)


def _texts(column: pa.Array) -> list[str]:
    return [x.decode("utf-8", "replace") if x is not None else "" for x in column.cast(pa.binary()).to_pylist()]


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of some texts at once."""
    a, size = 0, 0
    for b, text in enumerate(texts):
        size += len(text)
        if size >= PIECE or b == len(texts) - 1:
            yield a, texts[a : b + 1]
            a, size = b + 1, 0


def document_frequencies(docs: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """How many rows there are, and how many hold each bucket."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows, seen = np.zeros(1 << bits, np.int64), 0, np.full(1 << bits, -1)
        for batch in batches:
            for _, texts in _groups(_texts(batch.column(0))):
                found = list(grams(texts, bits))
                bucket, row = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(row, kind="stable")
                bucket, ends = bucket[order], np.cumsum(np.bincount(row, minlength=len(texts)))
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    its, at = bucket[a:b], np.arange(rows, rows + b - a)
                    seen[its] = at  # the last place of each bucket stays
                    out[its[seen[its] == at]] += 1
                rows += len(texts)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(out[some], rows))], ["bucket", "n"])

    merged = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = merged.column("bucket").to_numpy(), merged.column("n").to_numpy()
    out = np.zeros(1 << bits, np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return int(n[bucket < 0].sum()), out


@dataclass
class LanguageModel:
    """``weights`` [kept buckets + 1, languages], idf and scale included, a last row of zeros; ``slot``: a bucket's row."""

    langs: list[str]
    bits: int
    slot: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(logits, number of n-grams) of each text."""
        out, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for bucket, row in grams(texts, self.bits):
            n += np.bincount(row, minlength=len(texts))
            at = self.slot[bucket]
            held = at < len(self.weights) - 1
            at, row = at[held], row[held]
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(row, weights=self.weights[at, k], minlength=len(texts))
        return out / np.maximum(n, 1)[:, None] + self.shift, n


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader (proximal, per coordinate) for a multinomial logistic regression."""

    def __init__(self, features: int, langs: int, alpha: float = 0.5, beta: float = 0.1, l1: float = 0.05, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((features + 1, langs)), np.zeros((features + 1, langs))  # the last one is the intercept

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        """One document: its features (the intercept among them), their values, its language."""
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p[None]
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log-loss, by golden-section search on its logarithm. Labels count as right
    with (n + 1) / (n + 2) only, so that a fold without errors doesn't make every score 1."""
    if not len(y):
        return 1.0
    doubt = 1 / (len(y) + 2)

    def loss(t: float) -> float:
        p = np.log(np.maximum(softmax(logits / np.exp(t)), 1e-12))
        return float(-((1 - doubt) * p[np.arange(len(y)), y] + doubt * p.mean(axis=1)).mean())

    a, b, g = np.log(0.02), np.log(50.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def sample_features(docs: DataFrame, label_rows: int, label_chars: int, bits: int, max_langs: int) -> tuple[list[str], pa.Table]:
    """(languages in order, ``doc_id, y, held, at, x``): the sample's buckets and their shares of its n-grams."""
    rows = docs.where("lang IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    totals = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("c")).orderBy("lang").limit(max_langs + 1).collect()
    if len(totals) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs, k = sorted(r["lang"] for r in totals), max(1, len(totals))
    if not langs:
        return langs, pa.table({"y": pa.array([], pa.int64())})
    shares = [(r["lang"], langs.index(r["lang"]), int(10**9 * min(1.0, label_rows / k / r["n"], label_chars / k / max(1, r["c"])))) for r in totals]
    share = F.broadcast(rows.sparkSession.createDataFrame(shares, "lang string, y long, share long"))
    draw = F.xxhash64("doc_id", "text", F.lit("share"))
    some = rows.join(share, "lang").where(F.pmod(draw, F.lit(10**9)) < F.col("share")).dropDuplicates(["doc_id", "text"])
    some = some.select("doc_id", "y", (F.pmod(F.xxhash64("doc_id", "text", F.lit("fold")), F.lit(5)) == 0).alias("held"), "text")

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = [], []
            for text in _texts(batch.column(3)):
                found = [np.unique(b, return_counts=True) for b, _ in grams([text], bits)]
                bucket, n = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
                own, which = np.unique(bucket, return_inverse=True)
                n = np.bincount(which, weights=n, minlength=len(own))
                at.append(own.astype(np.int32))
                x.append((n / max(n.sum(), 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "y", "held", "at", "x"])

    return langs, some.mapInArrow(make, "doc_id long, y long, held boolean, at array<int>, x array<float>").toArrow()


def fit_language_model(docs: DataFrame, label_rows: int = 4000, label_chars: int = 8_000_000, bits: int = 17, epochs: int = 3, max_langs: int = 1000) -> LanguageModel | None:
    """The model from all rows of ``docs`` (doc_id, text, lang), none of which may be held out; None without evidence."""
    langs, table = sample_features(docs, label_rows, label_chars, bits, max_langs)
    if not table.num_rows:
        return None
    sample = [r for r in zip(*(table.column(c).to_numpy() for c in ("doc_id", "y", "held", "at", "x")), strict=True) if len(r[3])]
    if not sample:
        return None
    sample.sort(key=lambda r: (str(r[0]), int(r[1]), r[3].tobytes()))  # the rows come in any order
    rows, df = document_frequencies(docs, bits)
    idf = np.log((1 + rows) / (1 + df)) + 1
    known = np.unique(np.concatenate([r[3] for r in sample]))
    number = np.full(1 << bits, len(known), np.int32)
    number[known] = np.arange(len(known))
    model, order = Ftrl(len(known), len(langs)), np.random.default_rng(20260101)
    vectors = [(np.append(number[at], len(known)), np.append(SCALE * x * idf[at], 1.0), int(y)) for _, y, _, at, x in sample]
    train = [v for v, r in zip(vectors, sample, strict=True) if not r[2]] or vectors
    for _ in range(epochs):
        for i in order.permutation(len(train)):
            model.learn(*train[i])
    weights = model.weights(slice(None))
    fold = [v for v, r in zip(vectors, sample, strict=True) if r[2]] or vectors
    temperature = fit_temperature(np.array([x @ weights[at] for at, x, _ in fold]), np.array([y for _, _, y in fold]))
    kept = np.flatnonzero(weights[:-1].any(axis=1))
    slot = np.full(1 << bits, len(kept), np.int32)
    slot[known[kept]] = np.arange(len(kept))
    table = np.vstack([weights[kept] * (SCALE * idf[known[kept]])[:, None], np.zeros((1, len(langs)))])
    return LanguageModel(langs, bits, slot, table, weights[-1], temperature)


def predict_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows, at = docs.select(*names), names.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for a, texts in _groups(_texts(batch.column(at))):
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if model is not None:
                    logits, n = model.logits(texts)
                    p = softmax(logits / model.temperature)
                    score = np.where(n > 0, p.max(axis=1), 0.0)
                    lang = [model.langs[k] if m else UNKNOWN for k, m in zip(p.argmax(axis=1).tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, len(texts)).columns, pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return rows.mapInArrow(predict, StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify_languages(docs: DataFrame, **fit) -> DataFrame:
    """``docs`` (doc_id, text, lang and others) with ``held_out`` (crc32 of doc_id as text, modulo 4, is 2), ``lang_pred`` and
    ``score``. The prediction reads the text alone."""
    out = held_out(F.col("doc_id"), 4, 2)
    model = fit_language_model(docs.where(~out).select("doc_id", "text", "lang"), **fit)
    return predict_language(docs, model).withColumn("held_out", out)
