"""Benchmark decontamination by winnowing.

Every text keeps the minimum word-gram hash of each sliding window of grams; two texts that share `window` words keep
a common hash. Fingerprints of documents and benchmark items are joined; around each hit the document's windows
are compared with the item windows themselves, so a hit is extended exactly as far as the texts agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import attach, attach_few, carried, cut, documents, keyed, read, small
from .text import ALNUM, Chunk, Rolling, as_long, map_texts, sliding_minimum_places

WINDOW, GRAM = 10, 5


def _within(places: np.ndarray, size: int, words) -> np.ndarray:
    """Those places from which `size` words stay inside their text."""
    ends = words.first[1:]
    owner = np.searchsorted(words.first, places, side="right") - 1
    return places[places + size <= ends[owner]]


def winnow(words, values: np.ndarray, size: int, gram: int) -> np.ndarray:
    """Places of the grams kept so that any `size` consecutive words of a text hold one."""
    grams = Rolling(values).grams(gram)
    return _within(sliding_minimum_places(grams, size - gram + 1), gram, words)


def _shapes(sizes: list[int], gram: int) -> list[tuple[int, int]]:
    return [(s, min(s, gram)) for s in sizes]


def fingerprints(docs: DataFrame, sizes: list[int], gram: int = GRAM, window: int = WINDOW, owner: str = "item_id") -> DataFrame:
    """(owner, size, h): the winnowed grams of each text for its own window size (fewer words: all of them)."""

    def make(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        words = chunk.words(ALNUM)
        values = words.hashes()
        out = []
        for size, g in _shapes(sizes, gram):
            at = winnow(words, values, size, g)
            text = np.searchsorted(words.first, at, side="right") - 1
            mine = np.minimum(words.count, window)[text] == size
            at, text = at[mine], text[mine]
            out.append((rows.column(owner).take(pa.array(text)), np.full(len(at), size, np.int32),
                        Rolling(values).hash(at, at + g)))
        return {owner: pa.concat_arrays([x[0] for x in out]), "size": np.concatenate([x[1] for x in out]),
                "h": as_long(np.concatenate([x[2] for x in out]))}

    return map_texts(docs, make, f"{owner} long, size int, h long")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, size, w1, w2): every window of every item, named by 128 bits of its words."""

    def make(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        words = chunk.words(ALNUM)
        size = np.minimum(words.count, window)
        n = np.where(size > 0, words.count - size + 1, 0)
        text = np.repeat(np.arange(chunk.n), n)
        start = words.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        both = [Rolling(words.hashes(seed), seed).hash(start, start + size[text]) for seed in (0, 1)]
        return {"item_id": rows.column("item_id").take(pa.array(text)), "size": size[text].astype(np.int32),
                "w1": as_long(both[0]), "w2": as_long(both[1])}

    return map_texts(items, make, "item_id long, size int, w1 long, w2 long").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document row: doc_id, key, n_words, n_hit (words inside an occurrence of an item window) and item_ids
    (sorted strings of the items with such a window). docs: doc_id, text; items: item_id, text.

    Null and empty texts have no words and no hits; items without words match nothing; an item shorter than `window` words
    is one window. Repeated document rows get the same result each; a null item_id hits words but is not listed. Texts of any
    length are read whole. Windows are compared by 128-bit hashes.
    """
    pairs = cut(item_windows(items.select("item_id", "text"), window))
    sizes = sorted(r["size"] for r in pairs.select("size").distinct().collect())  # at most `window` numbers
    targets = small(cut(fingerprints(items.select("item_id", "text"), sizes, gram, window)
                        .select("size", "h", F.lit(True).alias("hit")).distinct()))
    base = keyed(docs)

    def sketch(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        words = chunk.words(ALNUM)
        values = words.hashes()
        roll = Rolling(values)
        text, size, at, h = [], [], [], []
        for s, g in _shapes(sizes, gram):
            places = winnow(words, values, s, g)
            t = np.searchsorted(words.first, places, side="right") - 1
            text.append(t)
            size.append(np.full(len(t), s, np.int32))
            at.append((places - words.first[t]).astype(np.int32))
            h.append(roll.hash(places, places + g))
        n = sum(map(len, text))
        text = np.concatenate([np.arange(chunk.n), *text])
        counted = pa.array(np.concatenate([words.count, np.zeros(n, np.int64)]))
        none = pa.nulls(chunk.n, pa.int32())
        return {"doc_id": rows.column("doc_id").take(pa.array(text)), "key": rows.column("key").take(pa.array(text)),
                "n_words": counted, "head": np.arange(len(text)) < chunk.n,
                "size": pa.concat_arrays([none, *map(pa.array, size)]), "at": pa.concat_arrays([none, *map(pa.array, at)]),
                "h": pa.concat_arrays([pa.nulls(chunk.n, pa.int64()), *map(as_long, h)])}

    kept = map_texts(base, sketch, "doc_id long, key long, n_words long, head boolean, size int, at int, h long")
    found = cut(kept.join(targets, ["size", "h"], "left").filter("head or hit").groupBy("doc_id", "key")
                .agg(F.sum(F.col("head").cast("long")).alias("copies"), F.max("n_words").alias("n_words"),
                     F.collect_set(F.when(F.col("hit"), F.struct("size", "at"))).alias("places")))
    near = found.filter("size(places) > 0").select("doc_id", "key", "places")

    def extend(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        words = chunk.words(ALNUM)
        roll = [Rolling(words.hashes(seed), seed) for seed in (0, 1)]
        owner, start, size = [], [], []
        for i, places in enumerate(rows.column("places").to_pylist()):
            for s in {p["size"] for p in places}:
                at = np.unique(np.concatenate([np.arange(p["at"] - (s - min(s, gram)), p["at"] + 1) for p in places if p["size"] == s]))
                at = at[(at >= 0) & (at + s <= words.count[i])]
                owner.append(np.full(len(at), i))
                start.append(at)
                size.append(np.full(len(at), s, np.int32))
        owner, start, size = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (owner, start, size))
        begin = words.first[owner] + start
        return {"doc_id": rows.column("doc_id").take(pa.array(owner)), "key": rows.column("key").take(pa.array(owner)),
                "start": start.astype(np.int32), "size": size.astype(np.int32), "w1": as_long(roll[0].hash(begin, begin + size)),
                "w2": as_long(roll[1].hash(begin, begin + size))}

    around = map_texts(attach_few(base, near),
                       extend, "doc_id long, key long, start int, size int, w1 long, w2 long")
    names = ["size", "w1", "w2"]
    same = cut(around.join(small(pairs.select(*names).distinct()), names, "left_semi").distinct())
    order = Window.partitionBy("doc_id", "key").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("start") + F.col("size")
    covered = (same.withColumn("before", F.coalesce(F.max(stop).over(order), F.lit(0)))
               .groupBy("doc_id", "key").agg(F.sum(F.greatest(F.lit(0), stop - F.greatest("start", "before"))).alias("n_hit")))
    listed = (same.select("doc_id", "key", *names).distinct().join(small(pairs), names).select("doc_id", "key", "item_id").distinct()
              .groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids")))
    rows = found.select("doc_id", "key", "n_words", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return (attach(rows, attach(covered, listed))
            .select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of `docs`, all columns, that hold no window of any item."""
    hit = contamination(docs, items, window, gram).filter("n_hit > 0").select("doc_id", "key").distinct()
    rows = attach(keyed(docs, carry=True), small(cut(hit)), "left_anti")
    return rows.select(carried(docs.columns))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
