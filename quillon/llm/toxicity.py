"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posterior labels.

1. Voters: groups of lexicon words (a fixed list, and words that the labelled rows show to be tell-tale) and patterns
   (aimed at the reader, repeated, dense, shouted). A voter speaks or is silent; a document's votes are a bit mask.
2. The label model is fitted to the counts of all masks over all documents (at most 2**VOTERS rows, whatever the input):
   EM estimates the prior and each voter's rates in both classes; the correlations of voters within the classes, from the
   same counts, take weight from voters that repeat each other.
3. A linear classifier of hashed words and votes is trained on the posteriors of the documents of the labelled rows, whose
   labels set its scale. It scores every document.

Labels are learned only from rows that aren't held out (``_labels.held_out``), of which at most about ``label_rows`` are
used. What comes to the driver is bounded by that: a list of word cells for each such document, and the words that pass. Defined cases: null and empty texts have no votes and no words and get the score of the intercept; without
labelled rows the fixed lexicon alone votes and the label model's posterior is the score; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._bytes import LOWER, chunks, mix, prefix_hash, span_hash, token_spans
from quillon.llm._labels import fit_scale, held_out, labelled_texts, sigmoid
from quillon.llm._store import materialise

#: Common insults.
LEXICON = ["idiot", "moron", "stupid", "dumb", "loser", "trash", "scum", "clown", "pathetic", "worthless", "disgusting", "filth", "vermin", "imbecile", "fool", "garbage", "ugly", "hate", "shut", "kill"]
READER = ["you", "your", "yours", "youre"]
GROUPS, PATTERNS = 10, 4
VOTERS = GROUPS + PATTERNS
WORD_BITS = 16


def word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return span_hash(prefix_hash(data), ends - np.diff(ends, prepend=0), ends)


@dataclass
class Lexicon:
    """Sorted word hashes with the voter of each."""

    hashes: np.ndarray
    group: np.ndarray
    reader: np.ndarray

    @classmethod
    def of(cls, fixed: list[str], learned: np.ndarray) -> Lexicon:
        h = np.concatenate([word_hashes(fixed), learned])
        h, first = np.unique(h, return_index=True)
        return cls(h, first % GROUPS, np.sort(word_hashes(READER)))


def words_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, row of each, share of capitals in each row)."""
    for a, b, data, offsets in chunks(texts):
        start, end, row = token_spans(LOWER[data], offsets)
        h = span_hash(prefix_hash(LOWER[data]), start, end) if len(start) else np.zeros(0, np.uint64)
        capital = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        size = np.maximum(np.diff(offsets), 1)
        yield a, b, h, row, (capital[offsets[1:]] - capital[offsets[:-1]]) / size


def _held(sorted_: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    return at, sorted_[at] == h


def votes_of(lexicon: Lexicon, h: np.ndarray, row: np.ndarray, rows: int, capitals: np.ndarray) -> np.ndarray:
    """[rows, VOTERS] of 0 and 1."""
    at, hit = _held(lexicon.hashes, h)
    votes = np.zeros((rows, VOTERS), bool)
    votes[row[hit], lexicon.group[at[hit]]] = True
    n, words = np.bincount(row[hit], minlength=rows), np.bincount(row, minlength=rows)
    _, reader = _held(lexicon.reader, h)
    near = np.zeros(len(h), bool)
    for k in (1, 2, 3):
        if len(h) > k:
            near[k:] |= hit[k:] & reader[:-k] & (row[k:] == row[:-k])
    votes[:, GROUPS] = np.bincount(row[near], minlength=rows) > 0
    votes[:, GROUPS + 1] = n >= 2
    votes[:, GROUPS + 2] = (n > 0) & (n >= 0.01 * words)
    votes[:, GROUPS + 3] = (n > 0) & (capitals > 0.3)
    return votes


def learned_words(labelled: DataFrame, toxic: int, clean: int, least: int = 5, odds: float = 10.0) -> np.ndarray:
    """Hashes of words that at least ``least`` toxic documents hold, whose odds (smoothed) are over ``odds`` times the base."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy()
            for a, _, h, row, _ in words_of(batch.column(1)):
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)  # a word once per document
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                names, at = np.unique(h[new], return_inverse=True)
                bad = np.bincount(at, weights=y[row[new] + a], minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(bad), pa.array(np.bincount(at, minlength=len(names)))], ["h", "bad", "n"])

    words = labelled.select("y", "text").mapInArrow(count, "h long, bad long, n long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    good = F.col("n") - F.col("bad") + 0.5
    telling = words.where((F.col("bad") >= least) & ((F.col("bad") + 0.5) / good > odds * (toxic + 1) / (clean + 1)))
    return np.sort(telling.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


@dataclass
class LabelModel:
    prior: float
    #: log likelihood ratios of a vote and of silence, already weighted for correlation
    speak: np.ndarray
    silent: np.ndarray
    correlation: np.ndarray = field(repr=False)

    @classmethod
    def fit(cls, masks: np.ndarray, counts: np.ndarray, start: np.ndarray, steps: int = 100) -> LabelModel:
        """EM over distinct vote vectors [n, VOTERS] and their counts; ``start``: first guess of their posteriors."""
        post, w = start, counts.astype(float)
        for _ in range(steps):
            one, zero = w * post, w * (1 - post)
            prior = np.clip(one.sum() / max(w.sum(), 1), 1e-4, 0.5)
            rate1 = (one @ masks + 0.5) / (one.sum() + 1)
            rate0 = (zero @ masks + 1e-3) / (zero.sum() + 1)
            rate1, rate0 = np.clip(rate1, 1e-6, 1 - 1e-6), np.clip(rate0, 1e-6, 1 - 1e-6)
            speak, silent = np.log(rate1 / rate0), np.log((1 - rate1) / (1 - rate0))
            post = sigmoid(np.log(prior / (1 - prior)) + masks @ speak + (1 - masks) @ silent)
        rho = np.zeros((VOTERS, VOTERS))
        for share, rate in ((w * post, rate1), (w * (1 - post), rate0)):
            centred = masks - rate
            cov = (centred * share[:, None]).T @ centred / max(share.sum(), 1e-9)
            rho = np.maximum(rho, cov / np.sqrt(np.outer(rate * (1 - rate), rate * (1 - rate))))
        np.fill_diagonal(rho, 0)
        weight = 1 / (1 + np.clip(rho, 0, 1).sum(axis=1))
        return cls(float(prior), weight * speak, weight * silent, rho)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return sigmoid(np.log(self.prior / (1 - self.prior)) + votes @ self.speak + (1 - votes) @ self.silent)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    vote_weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, cell: np.ndarray, doc: np.ndarray, value: np.ndarray, rows: int, votes: np.ndarray) -> np.ndarray:
        return self.intercept + votes @ self.vote_weights + np.bincount(doc, weights=value * self.weights[cell], minlength=rows)


def word_cells(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed bag of words: (cell, row, value), each row's distinct cells with values of length 1 in sum of squares."""
    both = np.unique((row.astype(np.uint64) << np.uint64(WORD_BITS)) | (mix(h) >> np.uint64(64 - WORD_BITS)))
    doc, cell = (both >> np.uint64(WORD_BITS)).astype(np.int64), (both & np.uint64(2**WORD_BITS - 1)).astype(np.int64)
    return cell, doc, 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=rows), 1))[doc]


def train_linear(cell: np.ndarray, doc: np.ndarray, value: np.ndarray, votes: np.ndarray, target: np.ndarray, steps: int = 150, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on posterior labels by Adam on the whole sample."""
    n = len(target)
    theta = np.zeros(2**WORD_BITS + VOTERS + 1)
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    theta[-1] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    for t in range(1, steps + 1):
        z = theta[-1] + votes @ theta[2**WORD_BITS : -1] + np.bincount(doc, weights=value * theta[cell], minlength=n)
        err = (sigmoid(z) - target) / n
        g = np.concatenate([np.bincount(cell, weights=value * err[doc], minlength=2**WORD_BITS), err @ votes, [err.sum()]]) + ridge * theta
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        theta -= 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-9)
    return theta[: 2**WORD_BITS], theta[2**WORD_BITS : -1], float(theta[-1])


def _features(labelled: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(labels, votes, word cells) of the labelled documents: words are counted in tasks, texts stay there."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, row, capitals in words_of(batch.column(1)):
                mask = votes_of(lexicon, h, row, b - a, capitals) @ (1 << np.arange(VOTERS))
                cell, doc, _ = word_cells(h, row, b - a)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))]).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(mask.astype(np.int32)), cells], ["y", "mask", "cells"])

    got = labelled.select("y", "text").mapInArrow(make, "y int, mask int, cells array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return np.zeros(0), np.zeros((0, VOTERS)), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    lists = got.column("cells").chunk(0)
    n = np.diff(lists.offsets.to_numpy())
    doc = np.repeat(np.arange(got.num_rows), n)
    votes = (got.column("mask").to_numpy()[:, None] >> np.arange(VOTERS)) & 1
    return got.column("y").to_numpy().astype(float), votes.astype(float), (lists.flatten().to_numpy().astype(np.int64), doc, (1 / np.sqrt(np.maximum(n, 1)))[doc])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_rows: int = 8000) -> ToxicityModel:
    labelled = materialise(labelled_texts(docs, labels, "toxic", label_rows).select("y", "text"), "labelled")
    clean, toxic = ({r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}.get(y, 0) for y in (0, 1))
    lexicon = Lexicon.of(LEXICON, learned_words(labelled, toxic, clean))

    def cast(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, wh, wrow, caps in words_of(batch.column(0)):
                mask = votes_of(lexicon, wh, wrow, b - a, caps) @ (1 << np.arange(VOTERS))
                masks, n = np.unique(mask, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(masks.astype(np.int32)), pa.array(n.astype(np.int64))], ["mask", "n"])

    counted = docs.select("text").mapInArrow(cast, "mask int, n long").groupBy("mask").agg(F.sum("n").alias("n")).toPandas()
    masks = (counted["mask"].to_numpy()[:, None] >> np.arange(VOTERS)) & 1
    start = np.clip(masks[:, :GROUPS].sum(axis=1) / 2, 0.02, 0.98)
    model = LabelModel.fit(masks.astype(float), counted["n"].to_numpy(), start)

    y, votes, cells = _features(labelled, lexicon)
    if not len(y):  # nothing to train on: the label model decides
        return ToxicityModel(lexicon, np.zeros(2**WORD_BITS), model.speak - model.silent, float(np.log(model.prior / (1 - model.prior)) + model.silent.sum()))
    out = ToxicityModel(lexicon, *train_linear(*cells, votes, model.posterior(votes)))
    if toxic and clean:
        out.slope, out.shift = fit_scale(out.raw(*cells, len(y), votes), y)
    return out


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``toxicity`` from 0 to 1."""
    names = [c for c in docs.columns if c != "toxicity"]
    at = names.index("text")
    schema = docs.select(*names).schema.add("toxicity", "double")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, row, capitals in words_of(batch.column(at)):
                raw = model.raw(*word_cells(h, row, b - a), b - a, votes_of(model.lexicon, h, row, b - a, capitals).astype(float))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sigmoid(model.slope * raw + model.shift))], [*names, "toxicity"])

    return docs.select(*names).mapInArrow(score, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``toxicity`` and ``held_out``."""
    return score_toxicity(docs, fit_toxicity(docs, labels)).withColumn("held_out", held_out(F.col("doc_id")))
