"""Labelled samples of bounded size, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import crc_rest

#: Texts of more bytes are scored like others but not learnt from.
LONGEST = 1 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str = "text", doc_id: str = "doc_id", longest: int = LONGEST) -> DataFrame:
    """(id, text, y) of at most ``rows`` labelled documents of at most ``longest`` bytes that are not held out.

    The labels are those with the least hash of the id, so they are spread evenly and the same
    whatever the order of rows; with their fixed number they are small enough to broadcast.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & (crc_rest(F.col("id"), 5) != 0))
    some = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).filter(F.octet_length("t") <= longest)
    return texts.join(F.broadcast(some), "id")


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by Newton's method."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        p = sigmoid(x1 @ w)
        g = x1.T @ (p - y) / len(y) + l2 * w
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 / len(y) + (l2 + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def rated(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(k, t): the id and the text, all that a score may look at."""
    return df.select(F.col(doc_id).alias("k"), F.col(text).cast("string").alias("t"))
