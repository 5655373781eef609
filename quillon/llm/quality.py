"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features describe its characters and words and those of the lines before and after
it; transitions between the two states make runs of lines agree. The model is trained by maximum likelihood (gradients
by forward-backward) on at most about ``label_rows`` labelled documents, whose lines take their document's label. A
document's quality is the mean of its lines' marginals of being good, weighted by their lengths, put on the scale of the
labels by a logistic curve.

Labels are learned only from rows that aren't held out (``_labels.held_out``). Defined cases: null and empty texts are
one empty line, which weighs 1; without labelled rows of both labels every score is 0.5; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._bytes import LOWER, NOT_SPACE, chunks, prefix_hash, span_hash, word_spans
from quillon.llm._labels import fit_scale, held_out, labelled_texts, sigmoid

_CLASSES = [range(65, 91), range(97, 123), range(48, 58), b" \t", b".,;:?", b"!", b"|", b"#$%&*@^~<>=+\\{}[]", b"\"'()/-_`", range(128, 256)]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _k, _bytes in enumerate(_CLASSES):
    _CLASS[list(_bytes)] = _k
OWN = len(_CLASSES) + 7
#: A line's own features, those of both neighbours, whether there are neighbours, and a constant.
FEATURES = 3 * OWN + 3


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, document of each line, length of each line in bytes, at least 1)."""
    cut = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], cut + 1]))
    # an empty document shares its start with the next one: give it a line of its own
    empty = np.flatnonzero(np.diff(offsets) == 0)
    doc = np.searchsorted(offsets, starts, "right") - 1
    keep = starts < offsets[-1] if len(offsets) else np.zeros(0, bool)
    last_break = np.isin(starts, offsets[1:]) & np.isin(starts - 1, cut)  # a line break at a document's end
    tail_doc = np.searchsorted(offsets, starts[last_break] - 1, "right") - 1
    starts, doc = starts[keep], doc[keep]
    all_docs = np.concatenate([doc, empty, tail_doc])
    all_starts = np.concatenate([starts, offsets[empty], offsets[tail_doc + 1]])
    order = np.lexsort((all_starts, all_docs))
    doc, starts = all_docs[order], all_starts[order]
    ends = np.empty(len(starts), np.int64)
    if len(starts):
        same = np.append(doc[1:] == doc[:-1], False)
        ends[:-1] = starts[1:] - 1
        ends[~same] = offsets[doc[~same] + 1]
    size = np.maximum(ends - starts, 0)
    per = np.zeros((len(starts), OWN))
    kind = _CLASS[data]
    for k in range(len(_CLASSES)):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        per[:, k] = (total[ends] - total[starts]) / np.maximum(size, 1)
    ws, we, _ = word_spans(data, np.array([0, len(data)]), NOT_SPACE)
    line = np.searchsorted(starts, ws, "right") - 1
    n = np.bincount(line, minlength=len(starts)) if len(ws) else np.zeros(len(starts))
    pre = prefix_hash(LOWER[data])
    if len(ws):
        h = span_hash(pre, ws, we)
        o = np.lexsort((h, line))
        fresh = np.ones(len(o), bool)
        fresh[1:] = (h[o][1:] != h[o][:-1]) | (line[o][1:] != line[o][:-1])
        distinct = np.bincount(line[o][fresh], minlength=len(starts))
        odd = _CLASS[data[we - 1]]
        symbol_end = np.bincount(line[(odd == 7) | (odd == 5)], minlength=len(starts))
    else:
        distinct = symbol_end = np.zeros(len(starts))
    whole = span_hash(pre, starts, np.maximum(ends, starts))
    o = np.lexsort((whole, doc))
    twice = np.zeros(len(o), bool)
    if len(o) > 1:
        eq = (whole[o][1:] == whole[o][:-1]) & (doc[o][1:] == doc[o][:-1])
        twice[o[1:][eq]] = True
        twice[o[:-1][eq]] = True
    m = len(_CLASSES)
    per[:, m] = np.log1p(size) / 8
    per[:, m + 1] = np.log1p(n) / 6
    per[:, m + 2] = size / np.maximum(n, 1) / 20
    per[:, m + 3] = distinct / np.maximum(n, 1)
    per[:, m + 4] = symbol_end / np.maximum(n, 1)
    per[:, m + 5] = twice & (size > 0)
    per[:, m + 6] = size == 0
    x = np.zeros((len(starts), FEATURES))
    x[:, :OWN] = per
    before = np.append(False, doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
    after = np.append(doc[1:] == doc[:-1], False) if len(doc) else np.zeros(0, bool)
    x[before, OWN : 2 * OWN] = per[np.flatnonzero(before) - 1]
    x[after, 2 * OWN : 3 * OWN] = per[np.flatnonzero(after) + 1]
    x[:, -3], x[:, -2], x[:, -1] = before, after, 1
    return x, doc, np.maximum(size, 1)


@dataclass
class LineCRF:
    """State 1 is good. ``unary``: weights of state 1 against 0; ``step``: weights of staying and of changing."""

    unary: np.ndarray
    step: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray, doc: np.ndarray, pairs: bool = False):
        """P(good) of each line, and the expected number of changes, by forward-backward over all documents at once."""
        return forward_backward(x @ self.unary, self.step, doc, pairs)


def forward_backward(score: np.ndarray, step: np.ndarray, doc: np.ndarray, pairs: bool):
    """Lines of all documents in order; the documents move along their lines together, the longest first."""
    if not len(score):
        return score, 0.0
    _, first, size = np.unique(doc, return_index=True, return_counts=True)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    move = np.exp(step)  # [2, 2]
    emit = np.stack([sigmoid(-score), sigmoid(score)], axis=1)
    alpha, beta = np.empty((len(score), 2)), np.ones((len(score), 2))
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # documents of at least t lines
    for t in range(size[0]):
        at = first[: live[t]] + t
        now = emit[at] if t == 0 else emit[at] * (alpha[at - 1] @ move)
        alpha[at] = now / now.sum(axis=1, keepdims=True)
    for t in range(size[0] - 2, -1, -1):
        at = first[: live[t + 1]] + t
        back = (emit[at + 1] * beta[at + 1]) @ move.T
        beta[at] = back / back.sum(axis=1, keepdims=True)
    both = alpha * beta
    good = both[:, 1] / both.sum(axis=1)
    if not pairs:
        return good, None
    at = np.flatnonzero(doc[1:] == doc[:-1])
    joint = alpha[at][:, :, None] * move[None] * (emit[at + 1] * beta[at + 1])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return good, joint.sum(axis=0)


def document_scores(good: np.ndarray, doc: np.ndarray, size: np.ndarray, rows: int) -> np.ndarray:
    """Log-odds of the length-weighted mean of the marginals."""
    mean = np.bincount(doc, weights=good * size, minlength=rows) / np.maximum(np.bincount(doc, weights=size, minlength=rows), 1)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def train_crf(x: np.ndarray, doc: np.ndarray, size: np.ndarray, y: np.ndarray, steps: int = 120, ridge: float = 1e-3) -> LineCRF:
    """Adam on the conditional log-likelihood of the lines; documents of either label weigh alike in sum."""
    model = LineCRF(np.zeros(x.shape[1]), np.zeros((2, 2)))
    line_y = y[doc].astype(float)
    same = doc[1:] == doc[:-1]
    seen = np.zeros((2, 2))
    a, b = line_y[:-1][same].astype(int), line_y[1:][same].astype(int)
    np.add.at(seen, (a, b), 1)
    theta = np.zeros(x.shape[1] + 4)
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    n = max(len(x), 1)
    for t in range(1, steps + 1):
        model.unary, model.step = theta[:-4], theta[-4:].reshape(2, 2)
        good, joint = model.marginals(x, doc, pairs=True)
        g = np.concatenate([x.T @ (good - line_y), (joint - seen).ravel()]) / n + ridge * theta
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        theta = theta - 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-9)
    model.unary, model.step = theta[:-4], theta[-4:].reshape(2, 2)
    good, _ = model.marginals(x, doc)
    model.slope, model.shift = fit_scale(document_scores(good, doc, size, len(y)), y.astype(float))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label_rows: int = 3000) -> LineCRF | None:
    """Line features are made in tasks; only those of the bounded labelled rows come here."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                x, doc, size = line_features(data, offsets)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))]).astype(np.int32)
                flat = np.concatenate([x, size[:, None]], axis=1).astype(np.float32).ravel()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends * (FEATURES + 1)), pa.array(flat))], ["y", "x"])

    rows = labelled_texts(docs, labels, "quality", label_rows).select(F.col("y").cast("long").alias("y"), "text")
    got = rows.mapInArrow(make, "y long, x array<float>").toArrow().combine_chunks()
    y = got.column("y").to_numpy() if got.num_rows else np.zeros(0)
    if len(np.unique(y)) < 2:
        return None
    lists = got.column("x").chunk(0)
    flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES + 1).astype(float)
    doc = np.repeat(np.arange(got.num_rows), np.diff(lists.offsets.to_numpy()) // (FEATURES + 1))
    return train_crf(flat[:, :-1], doc, flat[:, -1], y)


def score_quality(docs: DataFrame, model: LineCRF | None) -> DataFrame:
    """``docs`` with ``quality`` from 0 to 1."""
    names = [c for c in docs.columns if c != "quality"]
    at = names.index("text")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(at)):
                value = np.full(b - a, 0.5)
                if model is not None:
                    x, doc, size = line_features(data, offsets)
                    good, _ = model.marginals(x, doc)
                    value = sigmoid(model.slope * document_scores(good, doc, size, b - a) + model.shift)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(value)], [*names, "quality"])

    return docs.select(*names).mapInArrow(score, docs.select(*names).schema.add("quality", "double"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``quality`` and ``held_out``."""
    return score_quality(docs, fit_quality(docs, labels)).withColumn("held_out", held_out(F.col("doc_id")))
