"""Quality classifier: hashed n-gram logistic regression with follow-the-regularised-leader updates, scored as sparse dot products.

Tokens are runs of letters and digits and runs of other signs; features are hashed tokens (lower case), pairs of neighbouring
tokens, a token that follows itself, and shapes (all capitals, length). Each text is a unit vector of log counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import held_out, sample, sigmoid, train
from .tables import cut, documents, read
from .text import LOWER, Chunk, lists, map_texts, mix, rolling_bytes

#: labelled rows that the classifier is fitted on at most; bits of a feature's hash
SAMPLE, BITS = 12_000, 18
THRESHOLD = 0.5

_B = np.arange(256)
_KIND = np.where((_B == 32) | ((_B >= 9) & (_B <= 13)), 0, 2)
_KIND[((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)] = 1
_KIND = _KIND.astype(np.int8)
_UPPER = ((_B >= 65) & (_B <= 90)).astype(np.int64)
_SEEDS = [np.uint64(s) for s in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x6A09E667F3BCC908, 0xBB67AE8584CAA73B)]


def features(chunk: Chunk, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse unit vectors: text, feature and value of every entry, by text and feature."""
    kind = _KIND[chunk.data]
    edge = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)]))
    dark = kind[edge[:-1]] > 0
    begin, end = edge[:-1][dark], edge[1:][dark]
    text = np.searchsorted(chunk.begin, begin, side="right") - 1
    token = rolling_bytes(LOWER[chunk.data]).hash(begin, end)
    capitals = np.concatenate(([0], np.cumsum(_UPPER[chunk.data])))
    loud = (capitals[end] - capitals[begin] == end - begin) & (end - begin > 1)
    shape = np.minimum(end - begin, 30).astype(np.uint64) * np.uint64(8) + kind[begin].astype(np.uint64) * np.uint64(2) + loud
    next_to = np.flatnonzero(text[1:] == text[:-1])
    a, b = token[next_to], token[next_to + 1]
    pair = mix(a * np.uint64(3) + b ^ _SEEDS[1])
    again = np.where(a == b, _SEEDS[2], mix(shape[next_to] * np.uint64(4096) + shape[next_to + 1] ^ _SEEDS[3]))
    h = np.concatenate([token, mix(shape ^ _SEEDS[0]), pair, again]) >> np.uint64(64 - bits)
    owner = np.concatenate([text, text, text[next_to], text[next_to]])
    code, count = np.unique(owner.astype(np.int64) << bits | h.astype(np.int64), return_counts=True)
    owner, feature, value = code >> bits, code & ((1 << bits) - 1), np.log1p(count)
    norm = np.sqrt(np.bincount(owner, weights=value * value, minlength=chunk.n))
    return owner, feature, value / norm[owner]


def fit(docs: DataFrame, chosen: DataFrame, bits: int = BITS) -> np.ndarray:
    """Weights, the bias last, from the labelled texts `chosen` (doc_id, label), a bounded sample."""

    def sparse(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        owner, feature, value = features(chunk, bits)
        each = np.bincount(owner, minlength=chunk.n)
        return {"doc_id": rows.column("doc_id"), "label": rows.column("label"), "index": lists(feature.astype(np.int32), each),
                "value": lists(value.astype(np.float32), each)}

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # as many rows as the sample's bound
    rows = cut(map_texts(texts, sparse, "doc_id long, label int, index array<int>, value array<float>"))
    order = ["_h", "doc_id", "_n"]
    size = (1 << bits) + 1

    def learn(batches):
        """All rows of the sample, in the order of their hash."""
        parts = [b for b in batches if b.num_rows]
        if parts:
            data = pa.Table.from_batches(parts).combine_chunks()
            index, value = data["index"].combine_chunks(), data["value"].combine_chunks()
            first = index.offsets.to_numpy()
            w = train(first - first[0], index.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(float),
                      data["label"].to_numpy().astype(float), size, alpha=1.0, l1=0.0, l2=0.05, epochs=4)
        else:
            w = np.zeros(size)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["feature", "weight"])

    ordered = rows.withColumn("_h", F.xxhash64("doc_id")).withColumn("_n", F.size("index")).repartition(1).sortWithinPartitions(*order)
    weights = np.zeros(size)
    for feature, weight in ordered.select("label", "index", "value").mapInArrow(learn, "feature long, weight double").collect():
        weights[feature] = weight
    return weights


def quality(docs: DataFrame, labels: DataFrame, parts: int = 3, fold: int = 1, threshold: float = THRESHOLD, rows: int = SAMPLE) -> DataFrame:
    """One row per document row: doc_id, held_out, score (0 to 1, higher: likelier good) and predicted (1 from `threshold` on).

    Fitted on at most `rows` labelled rows outside the held-out fold. Null and empty texts have no feature and get the score of the bias.
    A null doc_id is held out. Repeated rows are scored alike; other columns are left out. Without any label the score is 1/2 everywhere.
    """
    docs = docs.select("doc_id", "text")
    weights = fit(docs, sample(labels, "quality", parts, fold, rows)).astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS + 1 numbers

    def score(chunk: Chunk, batch: pa.RecordBatch) -> dict:
        owner, feature, value = features(chunk)
        w = sent.value
        total = np.bincount(owner, weights=w[feature] * value, minlength=chunk.n) + w[-1]
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": sigmoid(total)}

    found = map_texts(docs.withColumn("held_out", held_out(parts, fold)), score, "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), read(spark, sf_dir, "labels"))
