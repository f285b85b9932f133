"""License scan by diagonal voting.

All rolling word pairs of all documents are joined to the positions where they stand in license templates. A hit votes for a
diagonal, the difference of both positions; neighbouring diagonals of one template, as small edits make them, are merged, and a span holds if enough
of its template stands in it.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut, documents, keyed
from .text import ALNUM, Chunk, Rolling, as_long, lists, map_texts

GRAM = 2
#: diagonals this near are merged, over gaps of at most so many words; share of a template's word pairs that a span must hold
SHIFT, GAP, SHARE = 4, 12, 0.6

# Phrases that name a license, and openings of public license notices.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
               "License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
#: word pairs that tell a notice from its relatives: a span must hold one of each group
NEEDED = {"lgpl": [("gnu lesser", "lesser general")], "cc-by": [("attribution 4",)], "cc-by-nc": [("by nc",), ("nc 4",)]}
#: versions that count as 4.0 in the notices of NEEDED
VERSIONS = ["1.0", "2.0", "2.5", "3.0"]


def templates(phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> list[tuple]:
    """(template, label, exact, grams, h, at, need, needs): one row for each word pair of each template, and for those of further versions; the
    number of the pair's group in NEEDED (0 for none), and of groups."""

    def pairs(text: str) -> list[int]:
        words = Chunk([text.encode()], slice(0, 1)).words(ALNUM)
        return Rolling(words.hashes()).grams(GRAM).view(np.int64).tolist()

    rows = []
    for number, (label, text, exact) in enumerate([(*p, True) for p in phrases] + [(*n, False) for n in notices]):
        grams = pairs(text)
        groups = [] if exact else NEEDED.get(label, [])
        need = {h: i + 1 for i, group in enumerate(groups) for pair in group for h in pairs(pair)}
        needs = len(set(need.values()) & {need.get(h) for h in grams})  # of other texts of this label, only what they hold themselves
        same = [grams, *(pairs(text.replace("4.0", v)) for v in VERSIONS if groups)]
        rows += sorted({(number, label, exact, len(grams), h, at, need.get(grams[at], 0), needs) for g in same for at, h in enumerate(g)})
    return rows


def license_spans(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, copies, n_words) of every text, and its spans: doc_id, key, label, exact, start, stop (words), share of the template,
    needs (how many groups of distinguishing pairs the template has) and met (whether the span holds them).

    Phrases (two words at least) count only where all their words stand in a row. Null and empty texts have no words.
    """
    known = docs.sparkSession.createDataFrame(templates(phrases, notices), "template int, label string, exact boolean, grams int, t long, at int, "
                                             "need int, needs int")

    def pairs(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        words = chunk.words(ALNUM)
        grams = Rolling(words.hashes()).grams(GRAM)
        n = np.maximum(words.count - GRAM + 1, 0)
        text = np.repeat(np.arange(chunk.n), n + 1)
        offset = np.arange(len(text)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)  # a list starts with a mark of the row itself
        h = np.zeros(len(text), dtype=np.uint64)
        inner = offset > 0
        h[inner] = grams[words.first[text[inner]] + offset[inner] - 1]
        return {"doc_id": rows.column("doc_id"), "key": rows.column("key"), "n_words": words.count, "grams_of": lists(as_long(h), n + 1)}

    rolled = map_texts(docs, pairs, "doc_id long, key long, n_words long, grams_of array<long>")
    joined = rolled.select("doc_id", "key", "n_words", F.posexplode("grams_of").alias("place", "h")).join(
        F.broadcast(known), F.col("h") == F.col("t"), "left").filter("place = 0 or template is not null")  # a fixed list of templates
    found = cut(joined.drop("h", "t"))
    heads = found.filter("place = 0").groupBy("doc_id", "key").agg(F.count("*").alias("copies"), F.max("n_words").alias("n_words"))
    votes = (found.filter("place > 0").withColumn("diagonal", F.col("place") - 1 - F.col("at"))
             .groupBy("doc_id", "key", "template", "label", "exact", "grams", "needs", "diagonal")
             .agg(F.collect_set("at").alias("ats"), F.collect_set(F.when(F.col("need") > 0, F.col("need"))).alias("told"),
                  F.min("place").alias("begin"), F.max("place").alias("end")))
    whole = votes.filter("exact and size(ats) = grams").select("doc_id", "key", "label", "exact", F.col("diagonal").alias("start"),
                                                               (F.col("diagonal") + F.col("grams") + 1).alias("stop"), F.lit(1.0).alias("share"),
                                                               "needs", F.lit(True).alias("met"))
    line = Window.partitionBy("doc_id", "key", "template").orderBy("begin", "diagonal")
    near = (F.abs(F.col("diagonal") - F.lag("diagonal").over(line)) <= SHIFT) & (F.col("begin") - F.lag("end").over(line) <= GAP)
    merged = (votes.filter("not exact").withColumn("new", F.when(near, 0).otherwise(1)).withColumn("run", F.sum("new").over(line))
              .groupBy("doc_id", "key", "template", "label", "exact", "grams", "needs", "run")
              .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("held"), F.min("begin").alias("begin"), F.max("end").alias("end"),
                   (F.size(F.array_distinct(F.flatten(F.collect_list("told")))) == F.col("needs")).alias("met"))
              .select("doc_id", "key", "label", "exact", (F.col("begin") - 1).alias("start"), (F.col("end") + 1).alias("stop"),
                      (F.col("held") / F.col("grams")).alias("share"), "needs", "met"))
    return heads, whole.unionByName(merged)


def _winners(spans):
    """Of the structs (rank, loss, start, stop, label), best first, those that no better one of another label covers half of (or is covered by)."""

    def half(x, y):
        shared = F.least(x["stop"], y["stop"]) - F.greatest(x["start"], y["start"])
        return (x["label"] != y["label"]) & (2 * shared >= F.least(x["stop"] - x["start"], y["stop"] - y["start"]))

    add = lambda kept, x: F.when(F.exists(kept, lambda y: half(x, y)), kept).otherwise(F.concat(kept, F.array(x)))
    return F.aggregate(F.sort_array(spans), F.filter(spans, lambda x: F.lit(False)), add)


def license_scan(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base places are exact phrases. Labels also has those of notices of which a span holds at least `share` and the distinguishing pairs; of
    overlapping spans of different notices the one with such pairs wins, then the one with the greater share. The score is the largest share of
    any template in any span, 1 for an exact phrase. Null and empty texts have no words, score 0 and empty labels. Repeated rows
    get the same result each; other columns are left out.
    """
    heads, spans = license_spans(keyed(docs))
    notice = ~F.col("exact") & F.col("met") & (F.col("share") >= share)
    rank = F.when(F.col("needs") > 0, F.lit(0)).otherwise(F.lit(1))
    each = spans.groupBy("doc_id", "key").agg(
        F.sum(F.col("exact").cast("long")).alias("n_base"), F.min(F.when(F.col("exact"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("start"))).alias("last_word"),
        F.collect_set(F.when(F.col("exact"), F.col("label"))).alias("base"), F.max("share").alias("score"),
        F.collect_list(F.when(notice, F.struct(rank.alias("rank"), (-F.col("share")).alias("loss"), "start", "stop", "label"))).alias("notices"))
    found = F.array_union("base", F.transform(_winners(F.col("notices")), lambda x: x["label"]))
    each = each.withColumn("base_labels", F.concat_ws(",", F.sort_array("base"))).withColumn("labels", F.concat_ws(",", F.sort_array(found)))
    each = each.drop("base", "notices").withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    rows = heads.select("doc_id", "key", "n_words", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.join(each, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"),
        F.col("last_word").cast("long"), F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
