"""Logistic regression on sparse rows, trained by follow-the-regularised-leader updates (FTRL-proximal)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut


def held_out(parts: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) modulo `parts` is `fold`; a null doc_id is held out, so never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == fold, F.lit(True))


def sample(labels: DataFrame, label: str, parts: int, fold: int, rows: int) -> DataFrame:
    """At most `rows` labelled rows (doc_id, label) outside the held-out fold: those of the least hash of their doc_id. A doc_id with
    several labels counts once, with its highest; null labels do not count."""
    return cut(labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & ~held_out(parts, fold))
               .groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(first: np.ndarray, index: np.ndarray, value: np.ndarray, label: np.ndarray, size: int, alpha: float = 0.1, beta: float = 1.0,
          l1: float = 0.0, l2: float = 1.0, epochs: int = 3) -> np.ndarray:
    """Weights of `size` features, the last one the bias. Row i has the features index[first[i]:first[i + 1]], each at most once."""
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    if len(label):
        share = np.clip(label.mean(), 1e-3, 1 - 1e-3)
        start = np.log(share / (1 - share))
    else:
        start = 0.0
    offset = start  # the prior odds stay outside the penalty
    for _ in range(epochs):
        for i in range(len(label)):
            at = np.append(index[first[i]:first[i + 1]], size - 1)
            x = np.append(value[first[i]:first[i + 1]], 1.0)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (sigmoid(offset + wi @ x) - label[i]) * x
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[at] += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    w[-1] += offset
    return w
