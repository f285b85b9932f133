"""Near duplicates by circulant MinHash.

One permutation scatters the shingles over a circle of 2**32 places, the second, shifted by 0, 1, 2, ... places, gives
every further coordinate of the signature. Documents with equal shingle sets are one class; classes that share a band are
candidates, and a link holds only after the exact Jaccard similarity of the full sets.

Only connectivity is asked for, so a bucket of many classes is not expanded into pairs: its members are first compared
with a leader, then with the best of those that are still apart, then with members drawn by hash, as long as rounds find links.
Members of different components after that meet through the beginnings of their shingle sets, an exact filter: no candidate
between different components is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import attach, carried, cut, documents, keyed, small
from .text import DARK, Chunk, Rolling, as_long, lists, map_texts, mix

ROWS, BANDS, LEADER_ROUNDS = 4, 20, 3


def shingles(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, text after text and sorted, and how many each text has. A text of fewer than `size` words
    has its whole sequence as the one shingle; one without words has none."""
    words = chunk.words(DARK)
    n = np.where(words.count > 0, np.maximum(words.count - size + 1, 1), 0)
    text = np.repeat(np.arange(chunk.n), n)
    begin = words.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    h = Rolling(words.hashes()).hash(begin, begin + np.minimum(words.count, size)[text])
    edges = np.concatenate(([0], np.cumsum(n)))
    parts = []
    for i in range(chunk.n):
        s = np.sort(h[edges[i]:edges[i + 1]])
        parts.append(s[np.append(True, s[1:] != s[:-1])] if len(s) > 1 else s)
    return np.concatenate(parts), np.fromiter(map(len, parts), dtype=np.int64, count=chunk.n)


def _circle(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit places, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(h: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: a row for each coordinate, a column for each (non-empty) set."""
    place = (mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    return np.stack([np.minimum.reduceat(_circle(place + np.uint32(k)), starts) for k in range(coordinates)])


def sketches(docs: DataFrame, size: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, key, n_shingles, the 128-bit name (s1, s2) of the shingle set, and its band keys (none for an empty set)."""

    def make(chunk: Chunk, batch: pa.RecordBatch) -> dict:
        h, n = shingles(chunk, size)
        full = n > 0
        starts = (np.cumsum(n) - n)[full]
        names = np.zeros((2, chunk.n), dtype=np.uint64)
        keys = np.empty((0, bands), dtype=np.uint64)
        if len(starts):
            for i, seed in enumerate((0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)):
                names[i, full] = np.add.reduceat(mix(h ^ np.uint64(seed)), starts)
            signed = signatures(h, starts, rows * bands).astype(np.uint64)
            keys = np.empty((len(starts), bands), dtype=np.uint64)
            for b in range(bands):
                key = np.full(len(starts), b, dtype=np.uint64)
                for r in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signed[b * rows + r])
                keys[:, b] = key
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "n_shingles": n, "s1": as_long(names[0]), "s2": as_long(names[1]),
                "bands": lists(as_long(keys.ravel()), np.where(full, bands, 0))}

    return map_texts(keyed(docs), make, "doc_id long, key long, n_shingles long, s1 long, s2 long, bands array<long>")


def sets(docs: DataFrame, size: int) -> DataFrame:
    """(rep, shingles): the distinct shingle hashes of texts named by `rep`, (doc_id, key)."""

    def make(chunk: Chunk, batch: pa.RecordBatch) -> dict:
        h, n = shingles(chunk, size)
        return {"rep": batch.column("rep"), "shingles": lists(as_long(h), n)}

    return map_texts(docs.select("rep", "text"), make, "rep struct<doc_id: long, key: long>, shingles array<long>")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the links (a, b) reaches. Every round takes the smallest label
    around and then the label of the label, until nothing changes."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        around = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low")))
        lower = labels.join(around, "node").select("node", F.least("component", "low").alias("low"), F.col("component").alias("was"))
        above = labels.select(F.col("node").alias("low"), F.col("component").alias("top"))
        new = cut(lower.join(above, "low", "left").select("node", F.least("low", F.coalesce("top", "low")).alias("component"),
                                                         "was"))
        if new.filter("component <> was").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    one = full.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    two = full.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return (pairs.join(one, "a").join(two, "b").select("a", "b", shared.alias("i"), (F.size("x") + F.size("y")).cast("long").alias("n"))
            .filter(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b"))


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that still hold different components."""
    apart = members.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    return cut(members.join(apart, "bucket", "left_semi"))


def _prefix_pairs(members: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may still be linked. members: bucket, rep, n, component, degree.

    One of a pair is apart from the leading component of a bucket. Shingles are put in one order, the rarest among these documents first. The first
    shingle that a linked pair shares has at most the threshold's share of both sets before it; so only the beginnings of the
    sets are joined, and only where what follows could still be enough. A text with too many words of its own meets nobody.
    """
    lead = members.groupBy("bucket").agg(F.max(F.struct("degree", "rep", "component")).alias("lead"), F.min("component").alias("low"),
                                         F.max("component").alias("high")).filter("low <> high").select("bucket", "lead")
    apart = F.max(F.col("component") != F.col("lead.component")).alias("apart")
    nodes = cut(members.join(lead, "bucket").groupBy("rep").agg(F.first("n").alias("n"), F.first("component").alias("component"), apart))
    words = full.join(nodes.select("rep"), "rep").select("rep", F.explode("shingles").alias("h"))
    seen = words.groupBy("h").agg(F.count("*").alias("times"))
    begin = F.floor(F.size("order") * (100 - percent) / 100).cast("int") + 1
    order = (words.join(seen, "h").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("times", "h"))).alias("order"))
             .select("rep", F.posexplode(F.slice("order", F.lit(1), begin)).alias("i", "s")).select("rep", "i", "s.h"))
    order = cut(order.join(nodes, "rep").select("h", "rep", "i", "n", "component", "apart"))
    one = order.filter("apart").select("h", F.col("rep").alias("a"), "i", "n", "component")
    two = order.select("h", F.col("rep").alias("b"), F.col("i").alias("j"), F.col("n").alias("m"), F.col("component").alias("other"),
                       F.col("apart").alias("also"))
    rest = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    # two of them that are both apart meet once
    on = ((one.h == two.h) & (F.col("component") != F.col("other")) & (~F.col("also") | (F.col("a") < F.col("b"))) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
          & ((100 + percent) * rest >= percent * (F.col("n") + F.col("m"))))
    return one.join(two, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS, keys: bool = False) -> DataFrame:
    """One row per document row: doc_id, key (if `keys`: of the row's id and text), n_shingles, component_id (the smallest doc_id that links reach), kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct `size`-word shingles (lower case;
    blanks divide words). Null and empty texts have no shingle, link with nothing and are kept. A null doc_id is linked with nothing either:
    component_id is null, kept is true. Rows that repeat a doc_id are judged each by its own text. A link of the least similarity is missed with
    probability (1 - (percent/100)**rows)**bands: 4e-7 at 85, 3e-5 at 80 per pair.
    """
    base = cut(sketches(docs, size, rows, bands))
    classes = cut(base.filter("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2")
                  .agg(F.min(F.struct("doc_id", "key")).alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    banded = classes.select(F.explode("bands").alias("bucket"), "rep", "n")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1").select("bucket")
    buckets = cut(banded.join(shared, "bucket").distinct())
    texts = keyed(docs).withColumn("rep", F.struct("doc_id", "key")).join(small(cut(buckets.select("rep").distinct())), "rep", "left_semi")
    # of rows that agree in id and text one is enough; only those few are looked for by a shuffle
    twice = cut(base.groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter("n > 1").select(F.struct("doc_id", "key").alias("rep")))
    if not twice.isEmpty():
        texts = texts.join(small(twice), "rep", "left_anti").unionByName(texts.join(small(twice), "rep", "left_semi").dropDuplicates(["rep"]))
    full = cut(sets(texts, size))

    near = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.col("a") != F.col("b"))
    degrees = buckets.groupBy("rep").agg(F.count("*").alias("degree"))
    now = cut(buckets.join(degrees, "rep").withColumn("component", F.col("rep")))
    best = F.struct("degree", F.xxhash64("rep").alias("_"), "rep", "n", "component")
    links = None
    for turn in range(LEADER_ROUNDS):
        # the first leader is the best member, the second the best outside the first one's component; from then on the leader changes from round to round
        rank = best if turn < 2 else F.struct(F.xxhash64("rep", "bucket", F.lit(turn)).alias("_"), "rep", "n", "component")
        lead = now.groupBy("bucket").agg(F.max(rank).alias("lead"), F.min("component").alias("low"), F.max("component").alias("high"))
        lead = lead.filter("low <> high").select("bucket", "lead")
        if turn == 1:
            lead = (now.join(lead, "bucket").filter("component <> lead.component").groupBy("bucket").agg(F.max(best).alias("lead")))
        first = lead.select("bucket", "lead.component", F.col("lead.rep").alias("a"), F.col("lead.n").alias("n"))
        members = now.select("bucket", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"))
        pairs = (first.join(members, "bucket").filter((F.col("component") != F.col("other")) & near)
                 .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = cut(_verified(pairs, full, percent))
        if turn > 1 and found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        # buckets of one component are closed
        now = _open(now.drop("component").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
                    .withColumn("component", F.coalesce("component", "rep")))
    found = cut(_verified(_prefix_pairs(now, full, percent), full, percent))
    if not found.isEmpty():
        labels = components(links.unionByName(found))

    named = classes.select("s1", "s2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.coalesce("component", "rep")["doc_id"].alias("found"))
    return (base.join(named, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("n_shingles") > 0)
                      & F.col("doc_id").isNotNull(), "left")
            .select("doc_id", *(["key"] if keys else []), "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, of which one of each group stays: the one of the smallest doc_id.

    Rows are judged by their own texts: where a doc_id has several texts, each goes or stays with its own group, and of several texts of the
    group's smallest doc_id one stays. Of rows with equal doc_id and text any one stays. Null and empty texts and rows of a null doc_id all stay.
    """
    found = cut(near_duplicates(docs, size, percent, keys=True).filter("n_shingles > 0 and doc_id is not null"))
    stay = found.filter("kept").groupBy("component_id").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    several = cut(stay.filter("n > 1").select("component_id", "first"))  # groups whose smallest doc_id has several rows
    if several.isEmpty():
        gone = found.filter("not kept").select("doc_id", "key")
        again = None
    else:
        spare = found.filter("kept").join(small(several), "component_id").filter("key <> first")
        gone = found.filter("not kept").select("doc_id", "key").unionByName(spare.select("doc_id", "key"))
        again = small(several.select(F.col("component_id").alias("doc_id"), F.col("first").alias("key")))
    rows = attach(keyed(docs, carry=True), small(cut(gone.distinct())), "left_anti")
    if again is not None:
        rows = attach(rows, again, "left_anti").unionByName(attach(rows, again, "left_semi").dropDuplicates(["doc_id", "key"]))
    return rows.select(carried(docs.columns))


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=3, percent=85)
