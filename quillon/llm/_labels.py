"""Which rows a model may learn labels from, and what the two text models share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    """Rows never learned from: crc32 of doc_id as text (null: empty text) modulo ``parts`` is ``part``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def hashed_share(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` of the rows (all, if fewer), chosen by a hash of ``key``: nothing is sorted or sent anywhere."""
    n = rows.count()
    if n <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("share")), F.lit(10**9)) < int(10**9 * bound / n))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """``doc_id, text, y``: about ``bound`` labelled rows to learn from. The labels' side is bounded and so broadcast."""
    some = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = hashed_share(some.select("doc_id", F.col(label).cast("int").alias("y")), "doc_id", bound)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_scale(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b) of the logistic curve sigmoid(a x + b) through labels y, by Newton's method with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * x + b)
        g = np.array([((p - y) * x).sum() + 0.1 * (a - 1), (p - y).sum() + 1e-2 * b])
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = float(np.clip(a - move[0], 0.05, 20)), float(np.clip(b - move[1], -40, 40))
    return float(a), float(b)
