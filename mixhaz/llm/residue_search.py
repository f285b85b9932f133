"""Exact integer scores through residues, and hard negatives chosen by windows of them.

Vectors of integers are split into residues modulo a few small primes, centred on zero. For each prime one float32 matrix product gives the
scores' residues: its partial sums stay below 2**24, where float32 counts exactly. The Chinese remainder theorem puts the residues of a score
together. As many primes are taken as the longest vectors of the table need (|a.b| <= |a| |b|), so every score is exact.

Anchors come in blocks of at most ANCHORS, whose vectors are sent to all tasks; rows never shuffle. A task keeps its best few rows for each
anchor, those are ranked once more over all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import cut, read

#: anchors whose vectors are sent to all tasks at a time
ANCHORS = 16_384
#: rows and anchors of one matrix product
TILE_ROWS, TILE_ANCHORS = 1024, 1024
#: squared lengths stay below; vectors beyond take no part
LONGEST = 1 << 52
#: the largest prime: 260 products of centred residues stay below 2**24
LARGEST_PRIME = 509
NONE = np.iinfo(np.int64).min


def primes_for(bound: int) -> list[int]:
    """The largest small primes whose product exceeds 2 * bound + 1."""
    found, product, p = [], 1, LARGEST_PRIME
    while product <= 2 * bound + 1:
        if all(p % q for q in range(2, int(p ** 0.5) + 1)):
            found.append(p)
            product *= p
        p -= 1
    return found


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of integers modulo p, from -(p - 1) / 2 to (p - 1) / 2, as float32."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """(a @ b.T) modulo p, from 0 to p - 1. a, b: centred residues as float32."""
    step = ((1 << 24) - 1) // (p // 2) ** 2
    out = None
    for lo in range(0, max(a.shape[1], 1), step):
        part = (a[:, lo:lo + step] @ b[:, lo:lo + step].T).astype(np.int32) % p
        out = part if out is None else (out + part) % p
    return out


def reconstruct(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The integers, least in size, with these residues (mixed radix digits, one prime after the other)."""
    total, weight = parts[0].astype(np.int64), primes[0]
    for r, p in zip(parts[1:], primes[1:]):
        digit = (r - total % p) * pow(weight, -1, p) % p
        total += digit * weight
        weight *= p
    return np.where(total > weight // 2, total - weight, total)


class Scorer:
    """Exact inner products of rows with fixed anchors."""

    def __init__(self, anchors: np.ndarray, bound: int):
        self.primes = primes_for(bound)
        self.anchors = [residues(anchors, p) for p in self.primes]

    def scores(self, rows: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """rows x anchors lo..hi"""
        return reconstruct([residue_product(residues(rows, p), a[lo:hi], p) for p, a in zip(self.primes, self.anchors)], self.primes)


def prepared(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, q, length2): rows that take part, their components as floor(scale * x) and the squared length of q. Rows with a null id,
    label, vector or component, a component that is not finite, or squared lengths from 2**52 on take no part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = (vectors.select("vec_id", "label", "embedding").filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(~bad)
            .withColumn("scaled", F.transform(v, lambda x: x * float(scale)))
            .withColumn("length2", F.aggregate("scaled", F.lit(0.0), lambda s, x: s + (F.abs(x) + 1) * (F.abs(x) + 1)))
            .filter(F.col("length2") < float(LONGEST)))
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"),
                       F.transform("scaled", lambda x: F.floor(x).cast("long")).alias("q"), "length2")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as a matrix; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Best:
    """For each slot the best `most` of what has been offered: higher scores first, then smaller ids."""

    def __init__(self, slots: int, most: int):
        self.score = np.full((slots, most), NONE, dtype=np.int64)
        self.row = np.zeros((slots, most), dtype=np.int64)
        self.most = most

    def offer(self, slots: slice, score: np.ndarray, ids: np.ndarray) -> None:
        """score: slots x rows, NONE for what does not count; ids ascend. Only slots with something better than their last are sorted."""
        mine = self.score[slots]
        better = np.flatnonzero((score.max(axis=1, initial=NONE) >= mine[:, -1]) & (score.max(axis=1, initial=NONE) > NONE))
        if not len(better):
            return
        score = score[better]
        if score.shape[1] > self.most:
            # the least score among the best; every row that reaches it stays in the choice, so that ties are decided by id
            least = np.partition(score, -self.most, axis=1)[:, -self.most]
            slot, col = np.nonzero((score >= np.maximum(least, mine[better, -1])[:, None]) & (score > NONE))
        else:
            slot, col = np.nonzero(score > NONE)
        s, i = score[slot, col], ids[col]
        old, place = np.nonzero(mine[better] > NONE)
        slot, s, i = (np.concatenate(x) for x in ((slot, old), (s, mine[better][old, place]), (i, self.row[slots][better][old, place])))
        order = np.lexsort((i, -s, slot))
        slot, s, i = slot[order], s[order], i[order]
        first = np.searchsorted(slot, np.arange(len(better)))
        rank = np.arange(len(slot)) - first[slot]
        keep = rank < self.most
        at = better[slot[keep]] + (slots.start or 0)
        self.score[at, rank[keep]], self.row[at, rank[keep]] = s[keep], i[keep]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.score > NONE)
        return slot, self.row[slot, place], self.score[slot, place]


def _batches(batches, width: int):
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        label, q = batch.column("label").to_numpy()[order], matrix(batch.column("q"), width)[order]
        ids = ids[order]
        for lo in range(0, len(ids), TILE_ROWS):
            part = slice(lo, lo + TILE_ROWS)
            yield ids[part], label[part], q[part]


def _positives(rows: DataFrame, block, bound: int, most: int) -> DataFrame:
    """(anchor, positive_id, positive_score): each task's best rows of the anchor's label, itself left out."""

    def run(batches):
        anchor_ids, labels, q = block.value
        scorer, best = Scorer(q, bound), Best(len(anchor_ids), most)
        for ids, label, x in _batches(batches, q.shape[1]):
            for lo in range(0, len(anchor_ids), TILE_ANCHORS):
                part = slice(lo, min(lo + TILE_ANCHORS, len(anchor_ids)))
                same = (labels[part, None] == label) & (anchor_ids[part, None] != ids)
                if same.any():
                    best.offer(part, np.where(same, scorer.scores(x, part.start, part.stop).T, NONE), ids)
        anchor, row, score = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(row), pa.array(score)], names=["anchor", "positive_id", "positive_score"])

    made = rows.select("vec_id", "label", "q").mapInArrow(run, "anchor long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    return made.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def _negatives(rows: DataFrame, block, chosen, bound: int, most: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """(slot, negative_id, negative_score): each task's best rows of other labels in the window of each (anchor, positive)."""

    def run(batches):
        anchor_ids, labels, q = block.value
        anchor, floor, ceiling = chosen.value  # one entry a slot, ascending by anchor
        scorer, best = Scorer(q, bound), Best(len(anchor), most)
        for ids, label, x in _batches(batches, q.shape[1]):
            for lo in range(0, len(anchor_ids), TILE_ANCHORS):
                hi = min(lo + TILE_ANCHORS, len(anchor_ids))
                a, b = np.searchsorted(anchor, (lo, hi))
                if a == b:
                    continue
                score = np.where(labels[lo:hi, None] != label, scorer.scores(x, lo, hi).T, NONE)
                nth = np.arange(a, b) - np.searchsorted(anchor, anchor[a:b])
                for n in np.unique(nth):  # each anchor's first positive, its second, ...
                    slots = np.flatnonzero(nth == n) + a
                    s = score[anchor[slots] - lo]
                    inside = (s >= floor[slots, None]) & (s <= ceiling[slots, None])
                    if inside.any():
                        mine = Best(0, most)
                        mine.score, mine.row = best.score[slots], best.row[slots]
                        mine.offer(slice(0, len(slots)), np.where(inside, s, NONE), ids)
                        best.score[slots], best.row[slots] = mine.score, mine.row
        slot, row, score = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(row), pa.array(score)], names=["slot", "negative_id", "negative_score"])

    made = rows.select("vec_id", "label", "q").mapInArrow(run, "slot long, negative_id long, negative_score long")
    order = Window.partitionBy("slot").orderBy(F.desc("negative_score"), "negative_id")
    return made.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 3, low: tuple[int, int] = (50, 100),
                   high: tuple[int, int] = (95, 100), block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor its first `n_positives` other rows of the same
    label, and for each of them the first `n_negatives` rows of other labels with low * positive_score <= negative_score <= high * positive_score
    (fractions). First: by score, then by smaller vec_id. rows, anchors: as from `prepared`; anchors are some of the rows.

    Rows with the anchor's vec_id are never its positives. Repeated rows count each; anchors that agree in vec_id, label and vector are one.
    A shorter vector ends in zeros. Anchors go in blocks of at most `block`: vectors and positives of a block pass through the driver, as every
    broadcast does; what is collected at a time is bounded by `block` whatever the table's size. One pass over the rows finds a block's positives,
    one its negatives. Empty tables give no rows.
    """
    spark = rows.sparkSession
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    top, width = rows.agg(F.max("length2"), F.max(F.size("q"))).first()
    anchors = cut(anchors.select("vec_id", "label", "q").distinct())
    cuts = _cuts(anchors, block)
    parts = []
    for lo, hi in cuts:
        some = anchors.filter((F.col("vec_id") >= lo) & (F.col("vec_id") < hi)) if hi is not None else anchors.filter(F.col("vec_id") >= lo)
        table = some.sort("vec_id", "label", "q").toArrow()
        if not table.num_rows:
            continue
        q = matrix(table["q"].combine_chunks(), width)
        sent = spark.sparkContext.broadcast((table["vec_id"].to_numpy(), table["label"].to_numpy(), q))
        bound = int(top)
        positive = _positives(rows, sent, bound, n_positives).sort("anchor", "place").toArrow()
        anchor, ids, score = (positive[c].to_numpy() for c in ("anchor", "positive_id", "positive_score"))
        # exact bounds of the window in whole numbers: ceiling of low * score, floor of high * score
        floor = -(-score * low[0] // low[1])
        ceiling = score * high[0] // high[1]
        chosen = spark.sparkContext.broadcast((anchor, floor, ceiling))
        slots = spark.createDataFrame(pa.table({"slot": np.arange(len(anchor)), "anchor_id": table["vec_id"].to_numpy()[anchor], "positive_id": ids,
                                                "positive_score": score}))
        found = _negatives(rows, sent, chosen, bound, n_negatives, low, high).join(F.broadcast(slots), "slot")
        parts.append(cut(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")))
        sent.destroy()
        chosen.destroy()
    out = spark.createDataFrame([], empty)
    for part in parts:
        out = out.unionByName(part)
    return out


def _cuts(anchors: DataFrame, block: int) -> list[tuple[int, int | None]]:
    """Ranges of vec_id with at most `block` anchors each (an id that has more is a range of its own)."""
    total = anchors.count()
    if total <= block:
        return [(-(1 << 63), None)] if total else []
    # range partitions, then counted: some numbers for each block come to the driver
    n = -(-total * 2 // block)
    counts = (anchors.select("vec_id").repartitionByRange(n, "vec_id").groupBy(F.spark_partition_id().alias("p"))
              .agg(F.min("vec_id").alias("lo"), F.count("*").alias("n")).sort("lo").collect())
    cuts, held = [], 0
    for r in counts:
        if not cuts or held + r["n"] > block:
            cuts.append(r["lo"])
            held = 0
        held += r["n"]
    return [(a, b) for a, b in zip([-(1 << 63), *cuts[1:]], [*cuts[1:], None])]


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor (vec_id divisible by 50) against all rows. Rows with a null id, label, vector or component, or one that is
    not finite, take no part; labels of ids divisible by 7 are changed first."""
    rows = prepared(read(spark, sf_dir, "embeddings"))
    rows = cut(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
    return hard_negatives(rows, rows.filter(F.col("vec_id") % 50 == 0))
