"""Document fingerprints: bottom-k sketches of word shingles, by DataFrame functions only.

A sketch is the sorted array of the k least distinct shingle hashes. Sketches of parts merge to the sketch of the whole; two of them
estimate resemblance and containment, one the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .suffix_array import numbered
from .tables import attach, cut, documents, keyed, small

SIZE, K = 5, 128
#: consecutive documents that are brought together to find each one's successor
BUCKET = 200


def words_of(text: Column) -> Column:
    """Lower-case words between blanks; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(words: Column, size: int = SIZE) -> Column:
    """Hashes of all runs of `size` words; fewer words are one run, no words none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(F.size(words) >= size, runs).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def sketch(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return sketch(F.concat(a, b), k)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the share of the hash range that k of them take."""
    span = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: of the k least hashes of both, the share that is in each. Two empty sketches are alike (1)."""
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    common = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def text_form(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def sketches(docs: DataFrame, size: int = SIZE, k: int = K) -> DataFrame:
    """doc_id and sketch of every row. Null and empty texts have an empty sketch."""
    return docs.select("doc_id", words_of(F.col("text")).alias("w")).select("doc_id", sketch(shingle_hashes(F.col("w"), size), k).alias("sketch"))


def _with_successor(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and n, number in the order of doc_id, of every row, in buckets of consecutive rows; a bucket ends
    with the first row of the next one (`extra`), the last with the first row of all. Rows that tie are ordered by a hash of their text."""
    base = keyed(docs)
    rows = cut(base.groupBy("doc_id", "key").agg(F.count("*").cast("int").alias("copies")))
    twice = rows.filter("copies > 1").select("doc_id", "key")
    if not twice.isEmpty():  # one text stands for all rows that repeat it, which then meet their numbers once each
        twice = small(cut(twice))
        base = attach(base, twice, "left_anti").unionByName(attach(base, twice, "left_semi").dropDuplicates(["doc_id", "key"]))
    each = rows.select("doc_id", "key", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    order = cut(numbered(each, ["doc_id", "key", "copy"], "n").select("doc_id", "key", "n").withColumnsRenamed({"doc_id": "_id", "key": "_key"}))
    total = order.count()
    found = base.join(small(order), (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    here = F.floor(F.col("n") / BUCKET).cast("long")
    before = F.when(F.col("n") == 0, F.struct(F.lit((max(total, 1) - 1) // BUCKET).cast("long").alias("bucket"), F.lit(total).cast("long").alias("n"), F.lit(True).alias("extra")))
    before = before.otherwise(F.struct((here - 1).alias("bucket"), F.col("n"), F.lit(True).alias("extra")))
    own = F.struct(here.alias("bucket"), F.col("n"), F.lit(False).alias("extra"))
    places = F.when(F.col("n") % BUCKET == 0, F.array(own, before)).otherwise(F.array(own))
    return found.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(places).alias("p")).select("doc_id", "text", "p.*")


def fingerprints(docs: DataFrame, size: int = SIZE, k: int = K) -> DataFrame:
    """One row per document row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles (estimated).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document in the order of
    doc_id, after the last the first one. A null text is empty; its sketch and those of other texts without words are empty and like each
    other. Null ids come first, rows that tie by a hash of their text, and a repeated row is a document of its own.
    """
    line = Window.partitionBy("bucket").orderBy("n")
    rows = _with_successor(docs).withColumn("after", F.lead("text").over(line)).withColumn("n_chars", F.length("text"))
    edited = F.concat(F.expr("substring(text, 1, n_chars - int(floor(n_chars / 2)))"), F.expr("substring(coalesce(after, ''), 1, int(floor(n_chars / 2)))"))
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("edited", edited)
    rows = rows.select("doc_id", "bucket", "n", "extra", "n_chars", "edited", sketch(shingle_hashes(F.col("words"), size), k).alias("own"))
    rows = rows.withColumn("next_own", F.lead("own").over(line)).filter("not extra").withColumn("words", words_of(F.col("edited")))
    rows = rows.select("doc_id", "n_chars", "own", "next_own", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       sketch(shingle_hashes(F.col("words"), size), k).alias("other"))
    return rows.select("doc_id", F.col("n_chars").cast("long"), "edited_sha256", text_form(F.col("own")).alias("fingerprint"),
                       text_form(F.col("other")).alias("edited_fingerprint"), resemblance(F.col("own"), F.col("other"), k).alias("near_edited"),
                       resemblance(F.col("own"), F.col("next_own"), k).alias("near_next"), distinct_shingles(F.col("own"), k).alias("n_shingles"))


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
