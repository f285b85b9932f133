"""Removal of long repeated byte strings by a distributed difference-cover suffix array.

Sorting a suffix for each byte of a corpus is not affordable, and most bytes repeat nowhere. So the cover is chosen by
content: each window of `length` bytes points to its least `gram`-byte hash, the same one in every copy of the window.
Windows that point to one place form a block; blocks whose gram occurs nowhere else cannot repeat. The other blocks of a
document are the symbols of a string, and the strings are suffix-sorted by difference-cover sampling (`suffix_array`). Neighbours
in that order with the same leading symbol share more than `length` bytes: all windows of these blocks repeat. What is left are
the rims of repeats: there the remaining suffixes, one for each window of an unequal block, are compared by their `length`-byte
prefixes with each other and with one block of each content that shares the gram. Contents are compared by 128-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .suffix_array import suffix_ranks
from .tables import attach_few, carried, cut, documents, keyed, small
from .text import Chunk, as_long, chunks, flat_lists, map_texts, rolling_bytes, sliding_argmin, spread, take

LENGTH, GRAM = 200, 100
#: bytes of a chunk: a task holds about twenty numbers for each of them at once
CHUNK = 1 << 18
#: symbols that the suffix order goes by; the first one alone covers `length` bytes
PREFIX = 4


class Blocks:
    """Runs of windows, one for each place that they point to: windows lo..hi (starts in the chunk) of text `text`."""

    def __init__(self, chunk: Chunk, length: int, gram: int):
        self.roll = rolling_bytes(chunk.data)
        least = sliding_argmin(self.roll.grams(gram), length - gram + 1)
        long = chunk.end - chunk.begin >= length
        edges = [np.flatnonzero(least[1:] != least[:-1]) + 1, chunk.begin[long], chunk.end[long] - length + 1]
        edges = np.unique(np.concatenate(edges)) if long.any() else np.empty(0, np.int64)
        lo = edges[:-1]
        text = np.searchsorted(chunk.begin, lo, side="right") - 1
        fits = (lo >= chunk.begin[text]) & (lo + length <= chunk.end[text])
        self.lo, self.hi, self.text = lo[fits], edges[1:][fits] - 1, text[fits]
        self.at = least[self.lo]
        self.gram = self.roll.hash(self.at, self.at + gram)
        self.first = np.searchsorted(self.text, np.arange(chunk.n + 1))
        self.number = np.arange(len(self.text)) - self.first[self.text]


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """For keyed documents: (doc_id, key, lo, hi), runs of window starts whose bytes also start anywhere else (complete, may overlap),
    and (doc_id, key) of documents of which there are several copies, whose windows all repeat. A copied text counts once in the first table."""
    sizes = docs.select("doc_id", "key", F.md5(F.coalesce("text", F.lit(""))).alias("name"), F.octet_length("text").alias("bytes"))
    sizes = sizes.filter(F.col("bytes") >= length)
    groups = (sizes.groupBy("name", "bytes").agg(F.count("*").alias("n"), F.min(F.struct("key", "doc_id")).alias("rep"))
              .filter("n > 1"))
    copies = cut(sizes.join(groups, ["name", "bytes"]).select("doc_id", "key", (F.col("key") != F.col("rep.key")).alias("spare")).distinct())
    spare = small(cut(copies.filter("spare").select("key").distinct()))
    texts = docs.filter(F.octet_length("text") >= length).join(spare, "key", "left_anti")

    def grams(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        h, n = np.unique(Blocks(chunk, length, gram).gram, return_counts=True)
        return {"h": as_long(h), "n": n}

    shared = cut(map_texts(texts, grams, "h long, n long", size=CHUNK).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"))

    def places(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        b = Blocks(chunk, length, gram)
        return take(rows, b.text) | {"number": b.number.astype(np.int32), "h": as_long(b.gram)}

    wanted = cut(map_texts(texts, places, "doc_id long, key long, number int, h long", size=CHUNK).join(small(shared), "h", "left_semi")
                 .groupBy("doc_id", "key").agg(F.collect_set("number").alias("numbers")))

    def contents(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        b = Blocks(chunk, length, gram)
        number, text = flat_lists(rows.column("numbers"))
        at = np.sort(b.first[text] + number)
        lo, hi, text = b.lo[at], b.hi[at], b.text[at]
        names = [r.hash(lo, hi + length) for r in (b.roll, rolling_bytes(chunk.data, 1))]
        order = np.lexsort((lo, names[1], names[0], text))
        same = (np.diff(text[order]) == 0) & (np.diff(names[0][order]) == 0) & (np.diff(names[1][order]) == 0)
        again, twice = np.zeros(len(at), bool), np.zeros(len(at), bool)
        again[order[1:]] = same
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        return take(rows, text) | {"lo": (lo - chunk.begin[text]).astype(np.int32), "hi": (hi - chunk.begin[text]).astype(np.int32),
                                    "h": as_long(b.gram[at]), "b1": as_long(names[0]), "b2": as_long(names[1]), "again": again, "twice": twice}

    blocks = cut(map_texts(attach_few(texts, wanted), contents, "doc_id long, key long, lo int, hi int, h long, b1 long, b2 long, "
                           "again boolean, twice boolean", size=CHUNK).dropDuplicates(["key", "lo"]))
    # a text's second block of the same content repeats within it, and adds nothing to the order
    symbols = cut(blocks.filter("not again").withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("lo")) - 1))
    ranks = suffix_ranks(symbols.select(F.col("key").alias("sid"), "i", F.col("b1").alias("x")), PREFIX).withColumnRenamed("i", "j")
    ranked = cut(symbols.join(ranks, (F.col("key") == F.col("sid")) & (F.col("i") == F.col("j"))).drop("sid", "j"))
    after = ranked.select((F.col("rank") + 1).alias("rank"), F.col("b1").alias("c1"), F.col("b2").alias("c2"))
    equal = cut(ranked.select("rank", "b1", "b2").join(after, "rank").filter("b1 = c1 and b2 = c2").select("rank"))
    seen = equal.select("rank", F.lit(True).alias("copy"), F.lit(True).alias("like")).unionByName(
        equal.select((F.col("rank") - 1).alias("rank"), F.lit(False).alias("copy"), F.lit(True).alias("like"))
    ).groupBy("rank").agg(F.max("copy").alias("copy"), F.max("like").alias("like"))
    judged = cut(ranked.join(seen, "rank", "left").select("doc_id", "key", "lo", "hi", "h", (F.coalesce("like", F.lit(False)) | F.col("twice")).alias("like"),
                                                          F.coalesce("copy", F.lit(False)).alias("copy")))
    rims = judged.filter("not like").select("h").distinct()
    open_blocks = judged.filter("not like").unionByName(judged.filter("like and not copy").join(rims, "h", "left_semi"))
    ends = cut(open_blocks.groupBy("doc_id", "key").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his")))

    def prefixes(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        lo, text = flat_lists(rows.column("los"))
        hi, _ = flat_lists(rows.column("his"))
        place, owner = spread(lo, hi)
        text = text[owner]
        at = chunk.begin[text] + place
        names = [rolling_bytes(chunk.data, seed).hash(at, at + length) for seed in (0, 1)]
        return take(rows, text) | {"place": place.astype(np.int32), "w1": as_long(names[0]), "w2": as_long(names[1])}

    windows = map_texts(attach_few(texts, ends), prefixes,
                        "doc_id long, key long, place int, w1 long, w2 long", size=CHUNK)
    many = cut(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1").select("w1", "w2"))
    single = windows.join(small(many), ["w1", "w2"], "left_semi").select("doc_id", "key", F.col("place").alias("lo"), F.col("place").alias("hi"))
    runs = blocks.filter("again").select("doc_id", "key", "lo", "hi").unionByName(judged.filter("like").select("doc_id", "key", "lo", "hi")).unionByName(single)
    return runs, copies.select("doc_id", "key").distinct()


def _spans(base: DataFrame, length: int, gram: int) -> DataFrame:
    """`base` with the window ranges (los, his) that repeat, and `whole` where all do."""
    runs, copies = repeated_windows(base.select("doc_id", "key", "text"), length, gram)
    found = runs.groupBy("doc_id", "key").agg(F.collect_list("lo").alias("los"), F.collect_list("hi").alias("his"))
    none = F.lit(None).cast("array<int>")
    spans = cut(found.withColumn("whole", F.lit(False)).unionByName(copies.select("doc_id", "key", none.alias("los"), none.alias("his"), F.lit(True).alias("whole")))
                .groupBy("doc_id", "key").agg(F.first("los", True).alias("los"), F.first("his", True).alias("his"), F.max("whole").alias("whole")))
    return attach_few(base, spans, "left")


def _gone(chunk: Chunk, rows: pa.RecordBatch, length: int) -> np.ndarray:
    """Which bytes of the chunk are inside a repeated string."""
    step = np.zeros(len(chunk.data) + 1, dtype=np.int32)
    lo, text = flat_lists(rows.column("los"))
    hi, _ = flat_lists(rows.column("his"))
    np.add.at(step, chunk.begin[text] + lo, 1)
    np.add.at(step, chunk.begin[text] + hi + length, -1)
    gone = np.cumsum(step[:-1]) > 0
    for i in np.flatnonzero(rows.column("whole").fill_null(False).to_numpy(zero_copy_only=False)):
        gone[chunk.begin[i]:chunk.end[i]] = True
    return gone


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document row: doc_id, key, n_bytes, n_removed, n_spans and kept (binary: the bytes that are left).

    Removed is each byte inside a `length`-byte string of its UTF-8 text that also starts anywhere else in the table, same document and repeated
    rows included; strings do not cross documents and are judged on the input. n_spans counts the maximal removed runs. A null text is
    empty; texts of fewer than `length` bytes stay whole. Rows that repeat a doc_id count as documents of their own; other columns are left out.
    """

    def clean(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        gone = _gone(chunk, rows, length)
        out = {"n_bytes": chunk.end - chunk.begin, "n_removed": np.zeros(chunk.n, np.int64), "n_spans": np.zeros(chunk.n, np.int64)}
        kept = []
        for i in range(chunk.n):
            lo, hi = chunk.begin[i], chunk.end[i]
            g = gone[lo:hi]
            n = np.count_nonzero(g)
            if n:
                out["n_removed"][i], out["n_spans"][i] = n, np.count_nonzero(g[1:] & ~g[:-1]) + int(g[0])
            kept.append((chunk.data[lo:hi][~g] if n else chunk.data[lo:hi]).tobytes())
        return {"doc_id": rows.column("doc_id"), "key": rows.column("key")} | out | {"kept": pa.array(kept, pa.binary())}

    return map_texts(_spans(keyed(docs), length, gram), clean, "doc_id long, key long, n_bytes long, n_removed long, n_spans long, kept binary", size=CHUNK)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The rows of `docs`, all columns, with repeated strings cut out of `text` (a character goes if all its bytes go) and n_chars, if
    there is such a column, counted anew. A null text stays null."""
    rows = keyed(docs, carry=True)

    def clean(chunk: Chunk, batch: pa.RecordBatch) -> dict:
        gone = _gone(chunk, batch, length)
        head = np.flatnonzero((chunk.data & 0xC0) != 0x80)
        gone = np.repeat(np.minimum.reduceat(gone, head), np.diff(np.append(head, len(gone))))
        kept = [(chunk.data[a:b][~gone[a:b]]).tobytes().decode("utf-8", "replace") for a, b in zip(chunk.begin, chunk.end)]
        return {"row": batch.column("row"), "text": pa.array(kept, pa.string(), mask=batch.column("text").is_null().to_numpy(zero_copy_only=False))}

    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    done = map_texts(_spans(rows, length, gram), clean, schema, size=CHUNK)
    change = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return done.select(carried(docs.columns, change))


def op10_suffix_array(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
