"""Removal of repeated word passages by recompression.

Each round first names runs of one symbol, then pairs of neighbours of which a hash puts the left one into one half of the
alphabet and the right one into the other. A name is a hash of what it stands for, so names agree in all tasks without a table. Symbols stand for a
bounded number of words; so at most EDGE words at either end of a passage are named differently in another place, and all inner symbols
are the same wherever the passage stands. Each window of words points to the inner symbol of the least name; a symbol with the words around it that occurs in
several documents reveals candidates. Windows that point to one symbol form a block: equal blocks are settled as one,
the windows of unequal blocks around one shared symbol are compared one by one. Contents are compared by 128-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import attach_few, cut, documents, keyed, small
from .text import DARK, Chunk, Rolling, Words, as_long, flat_lists, lists, map_texts, mix, sliding_argmin, spread, take

WINDOW = 50
#: words that a symbol may stand for at most, round by round
CAPS = (2, 2, 4, 4)


def edge(caps: tuple[int, ...] = CAPS) -> int:
    """Words at an end of a passage whose names may depend on what is outside: in each round a run and a pair, less a word each."""
    return sum(2 * (c - 1) for c in caps)


def recompress(names: np.ndarray, owner: np.ndarray, caps: tuple[int, ...] = CAPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of words and name of every symbol after all rounds; symbols do not cross texts."""
    name, owner, span, start = names.copy(), owner, np.ones(len(names), np.int64), np.arange(len(names))
    for turn, cap in enumerate(caps):
        if len(name) < 2:
            break
        same = (name[1:] == name[:-1]) & (owner[1:] == owner[:-1])
        first = np.flatnonzero(np.append(True, ~same))
        length = np.diff(np.append(first, len(name)))
        joined = (length > 1) & (span[first] * length <= cap)
        keep = np.append(True, ~same) | ~np.repeat(joined, length)
        at = first[joined]
        name[at] = mix(name[at] * np.uint64(0x9E3779B97F4A7C15) + length[joined].astype(np.uint64))
        span[at] *= length[joined]
        name, owner, span, start = name[keep], owner[keep], span[keep], start[keep]
        side = mix(name ^ np.uint64(0xD1B54A32D192ED03 * (turn + 1) % (1 << 64))) >> np.uint64(63)
        pair = (side[:-1] == 0) & (side[1:] == 1) & (owner[1:] == owner[:-1]) & (span[:-1] + span[1:] <= cap)
        left = np.flatnonzero(pair)
        name[left] = mix(name[left] * np.uint64(0xA0761D6478BD642F) + name[left + 1] * np.uint64(0xE7037ED1A0B428DB))
        span[left] += span[left + 1]
        keep = np.append(True, ~pair)
        name, owner, span, start = name[keep], owner[keep], span[keep], start[keep]
    return start, span, name


class Blocks:
    """Runs of windows that point to one symbol: windows lo..hi (words of the chunk) of text `text`; `gram` names the symbol and its surroundings."""

    def __init__(self, words: Words, window: int, caps: tuple[int, ...] = CAPS):
        self.roll = Rolling(words.hashes())
        e, top = edge(caps), max(caps)
        width = window - 2 * e - top + 1
        if width < top:
            raise ValueError(f"a window of {window} words is too short for symbols of {top} words in {len(caps)} rounds")
        start, _, name = recompress(words.hashes(), words.owner(), caps)
        key = np.full(len(words.begin), np.iinfo(np.uint64).max, dtype=np.uint64)
        key[start] = name
        least = sliding_argmin(key, width)  # by its first word
        begin, n = words.first[:-1], words.count
        long = n >= window
        edges = np.empty(0, np.int64)
        if long.any():
            change = np.flatnonzero(least[1:] != least[:-1]) + 1 - e
            edges = np.unique(np.concatenate([change, begin[long], begin[long] + n[long] - window + 1]))
        lo = edges[:-1]
        text = np.searchsorted(words.first, lo, side="right") - 1
        fits = (lo >= 0) & (lo + window <= words.first[np.clip(text, 0, None) + 1])
        self.lo, self.hi, self.text = lo[fits], edges[1:][fits] - 1, text[fits]
        at = least[self.lo + e]
        self.gram = self.roll.hash(at - e, at + e + top)
        self.first = np.searchsorted(self.text, np.arange(len(n) + 1))
        self.number = np.arange(len(self.text)) - self.first[self.text]


def earlier_windows(docs: DataFrame, window: int = WINDOW, caps: tuple[int, ...] = CAPS) -> tuple[DataFrame, DataFrame]:
    """For keyed documents: (doc_id, key, los, his), window starts whose words also start in a document of a smaller doc_id, as ranges in words
    (complete, may overlap, several rows for a document); and (doc_id, key) of documents whose whole text has a smaller doc_id, too."""
    names = docs.filter("doc_id is not null").select("doc_id", "key", F.md5(F.coalesce("text", F.lit(""))).alias("name"), F.length("text").alias("n"))
    firsts = names.groupBy("name", "n").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    copies = cut(names.join(firsts, ["name", "n"]).filter("doc_id > first").select("doc_id", "key").distinct())
    texts = docs.filter("doc_id is not null").join(small(copies.select("key").distinct()), "key", "left_anti")

    def grams(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        b = Blocks(chunk.words(DARK, False), window, caps)
        doc = rows.column("doc_id").to_numpy()[b.text]
        order = np.lexsort((doc, b.gram))
        h, doc = b.gram[order], doc[order]
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
        last = np.append(new[1:], len(h)) - 1
        return {"h": as_long(h[new]), "low": doc[new], "high": doc[last] if len(new) else doc[new]}

    shared = cut(map_texts(texts, grams, "h long, low long, high long").groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"))
                 .filter("low < high").select("h"))

    def places(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        b = Blocks(chunk.words(DARK, False), window, caps)
        return take(rows, b.text) | {"number": b.number.astype(np.int32), "h": as_long(b.gram)}

    wanted = cut(map_texts(texts, places, "doc_id long, key long, number int, h long").join(small(shared), "h", "left_semi")
                 .groupBy("doc_id", "key").agg(F.collect_set("number").alias("numbers")))

    def contents(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        words = chunk.words(DARK, False)
        b = Blocks(words, window, caps)
        number, text = flat_lists(rows.column("numbers"))
        at = np.sort(b.first[text] + number)
        lo, hi, text = b.lo[at], b.hi[at], b.text[at]
        name = [r.hash(lo, hi + window) for r in (b.roll, Rolling(words.hashes(1), 1))]
        order = np.lexsort((lo, name[1], name[0], text))
        lo, hi, text, gram, one, two = lo[order], hi[order], text[order], b.gram[at][order], name[0][order], name[1][order]
        new = np.append(True, (np.diff(text) != 0) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])) if len(lo) else np.empty(0, bool)
        new = np.flatnonzero(new)
        each = np.diff(np.append(new, len(lo)))
        first = words.first[text]
        return take(rows, text[new]) | {"h": as_long(gram[new]), "b1": as_long(one[new]), "b2": as_long(two[new]),
                                        "los": lists((lo - first).astype(np.int32), each), "his": lists((hi - first).astype(np.int32), each)}

    blocks = cut(map_texts(attach_few(texts, wanted), contents, "doc_id long, key long, h long, b1 long, b2 long, los array<int>, his array<int>"))
    content = cut(blocks.groupBy("h", "b1", "b2").agg(F.min("doc_id").alias("first")))
    rims = content.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", F.lit(True).alias("rim"))
    judged = cut(blocks.join(content, ["h", "b1", "b2"]).join(rims, "h", "left").select(
        "doc_id", "key", "los", "his", (F.col("doc_id") > F.col("first")).alias("settled"), F.coalesce("rim", F.lit(False)).alias("rim")))
    ends = (judged.filter("rim and not settled").groupBy("doc_id", "key")
            .agg(F.flatten(F.collect_list("los")).alias("los"), F.flatten(F.collect_list("his")).alias("his")))

    def single(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        words = chunk.words(DARK, False)
        lo, text = flat_lists(rows.column("los"))
        hi, _ = flat_lists(rows.column("his"))
        place, owner = spread(lo, hi)
        text = text[owner]
        at = words.first[text] + place
        name = [Rolling(words.hashes(seed), seed).hash(at, at + window) for seed in (0, 1)]
        return take(rows, text) | {"place": place.astype(np.int32), "w1": as_long(name[0]), "w2": as_long(name[1])}

    windows = map_texts(attach_few(texts, cut(ends)), single, "doc_id long, key long, place int, w1 long, w2 long")
    lowest = cut(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("w1", "w2", "low"))
    one = (windows.join(small(lowest), ["w1", "w2"]).filter("doc_id > low").groupBy("doc_id", "key")
           .agg(F.collect_set("place").alias("los")).select("doc_id", "key", "los", F.col("los").alias("his")))
    return judged.filter("settled").select("doc_id", "key", "los", "his").unionByName(one), copies


def passage_dedup(docs: DataFrame, window: int = WINDOW, caps: tuple[int, ...] = CAPS) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed and kept (the words that are left, joined by one blank).

    Removed is each word covered by a window of `window` consecutive words whose words also start in a document with a smaller doc_id;
    windows are judged on the input. Null and empty texts have no words, shorter texts stay whole. A row without doc_id is neither
    compared nor changed. Rows that share a doc_id do not remove each other's words and are judged each by its own text. Other columns are left out.
    """
    base = keyed(docs)
    ranges, copies = earlier_windows(base, window, caps)
    none = F.lit(None).cast("array<int>")
    gone = (ranges.withColumn("whole", F.lit(False)).unionByName(copies.select("doc_id", "key", none.alias("los"), none.alias("his"), F.lit(True).alias("whole")))
            .groupBy("doc_id", "key").agg(F.flatten(F.collect_list("los")).alias("los"), F.flatten(F.collect_list("his")).alias("his"),
                                          F.max("whole").alias("whole")))

    def apply(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        words = chunk.words(DARK, False)
        step = np.zeros(len(words.begin) + 1, dtype=np.int64)
        lo, text = flat_lists(rows.column("los"))
        hi, _ = flat_lists(rows.column("his"))
        np.add.at(step, words.first[text] + lo, 1)
        np.add.at(step, words.first[text] + hi + window, -1)
        whole = rows.column("whole").fill_null(False).to_numpy(zero_copy_only=False) & (words.count >= window)
        removed = (np.cumsum(step[:-1]) > 0) | whole[words.owner()]
        count = np.bincount(words.owner(), weights=removed, minlength=chunk.n).astype(np.int64)
        data = chunk.data.tobytes()
        kept = []
        for i in range(chunk.n):
            a, b = words.first[i], words.first[i + 1]
            stay = np.flatnonzero(~removed[a:b]) + a
            kept.append(b" ".join([data[s:e] for s, e in zip(words.begin[stay].tolist(), words.end[stay].tolist())]).decode("utf-8", "replace"))
        return {"doc_id": rows.column("doc_id"), "n_words": words.count, "n_removed": count, "kept": pa.array(kept, pa.string())}

    return map_texts(attach_few(base, cut(gone), "left"), apply, "doc_id long, n_words long, n_removed long, kept string")


def op6_recompression(spark, sf_dir: str) -> DataFrame:
    return passage_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
