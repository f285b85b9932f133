"""Toxicity by noisy-channel deobfuscation.

A character language model (trigrams of letter classes) is counted over all documents. Stretches that look disguised, with
digits or signs among letters, letters repeated three times and more, or letters set apart, become lattices of the characters
that they may stand for; Viterbi finds the likeliest reading. The restored words and their beginnings are the features of a logistic regression.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import held_out, sample, sigmoid, train
from .tables import cut, documents, read
from .text import ALNUM, Chunk, as_long, chunks, map_texts, rolling_bytes, short_batches

#: labelled rows that the classifier is fitted on at most; features that it has at most; texts that must hold a feature at least
SAMPLE, FEATURES, SUPPORT = 16_000, 3_000, 4
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.3

# What a sign may stand for besides itself.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
              "!": "i", "|": "li", "+": "t", "(": "c", "*": "aeiou"}
_SIGNS = r"0-9@$!|+(*"
SUSPECT = re.compile((rf"(?<![a-z0-9\x80-\xff])(?:[a-z{_SIGNS}][ ._*\-]){{2,}}[a-z{_SIGNS}](?![a-z0-9\x80-\xff])"
                      rf"|(?<![a-z{_SIGNS}])[a-z]+[{_SIGNS}]+[a-z][a-z{_SIGNS}]*|(?<![a-z{_SIGNS}])[{_SIGNS}]+[a-z][a-z{_SIGNS}]*"
                      r"|(?<![a-z])[a-z]*?([a-z])\1\1[a-z]*").encode())
APART = re.compile(rf"^[a-z{_SIGNS}](?:[ ._*\-][a-z{_SIGNS}])+$".encode())

# Channel log-probabilities.
AS_IT_IS, STANDS, ONCE, TWICE, LONGER, BREAK = 0.0, -0.7, -0.5, -1.0, -3.0, (-1.5, -3.0)
SMOOTH = 4.0  # weight of the shorter context
CLASSES = 29  # 0 outside words, a-z, other letters, digits
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27
_CLASS[48:58] = 28


def letter_model(docs: DataFrame) -> np.ndarray:
    """log P(class | two classes before) from the trigrams of all texts; CLASSES ** 3 numbers at most come to the driver."""

    def count(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        c = _CLASS[chunk.data]
        n = np.bincount(c[:-2] * CLASSES * CLASSES + c[1:-1] * CLASSES + c[2:], minlength=1) if len(c) > 2 else np.zeros(1, np.int64)
        at = np.flatnonzero(n)
        return {"gram": at, "n": n[at]}

    table = np.zeros(CLASSES ** 3)
    for gram, n in map_texts(docs.select("text"), count, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        table[gram] += n
    three = table.reshape(CLASSES, CLASSES, CLASSES)
    three[:, 0] = three[:, 0].sum(axis=0)  # a word begins alike after anything
    one = (three.sum(axis=(0, 1)) + 1) / (three.sum() + CLASSES)
    two = three.sum(axis=0)
    two = (two + SMOOTH * one) / (two.sum(axis=1, keepdims=True) + SMOOTH)
    return np.log((three + SMOOTH * two) / (three.sum(axis=2, keepdims=True) + SMOOTH))


def _readings(sign: str, length: int) -> list[tuple[str, float]]:
    """What a run of one sign may stand for, with the channel's log-probability."""
    found = []
    for letter, cost in [(sign, AS_IT_IS), *((x, STANDS) for x in STANDS_FOR.get(sign, ""))]:
        if length == 1:
            found.append((letter, cost))
        elif not letter.isalpha():
            found.append((letter * length, cost))
        elif length == 2:
            found += [(letter * 2, cost), (letter, cost + ONCE)]
        else:
            found += [(letter, cost + ONCE), (letter * 2, cost + TWICE), (letter * length, cost + LONGER * (length - 2))]
    return found


def restore(span: bytes, model: np.ndarray) -> bytes:
    """The likeliest reading of a suspect stretch. Letters set apart are joined, or left apart where a word ends; how dear
    that is can't be told from so few letters, so readings for both values of BREAK are kept if they differ."""
    if not APART.match(span):
        return _viterbi(span.decode("latin-1"), model, None)
    return b" ".join(dict.fromkeys(_viterbi(span[0::2].decode("latin-1"), model, cost) for cost in BREAK))


def _viterbi(text: str, model: np.ndarray, cost_of_break: float | None) -> bytes:
    """Best path through the lattice of the text's runs; the state is the last two classes."""
    best = {(0, 0): (0.0, "")}
    for run in re.finditer(r"(.)\1*", text, re.S):
        ahead: dict = {}
        for reading, cost in _readings(run[1], len(run[0])):
            classes = [int(_CLASS[ord(ch) & 255]) for ch in reading]
            for (a, b), (score, so_far) in best.items():
                s = score + cost
                for c in classes:
                    s += model[a, b, c]
                    a, b = b, c
                if (a, b) not in ahead or s > ahead[a, b][0]:
                    ahead[a, b] = (s, so_far + reading)
        if cost_of_break is not None:
            for (a, b), (score, so_far) in list(ahead.items()):
                s = score + cost_of_break + model[a, b, 0]
                if b and ((b, 0) not in ahead or s > ahead[b, 0][0]):
                    ahead[b, 0] = (s, so_far + " ")
        best = ahead
    return max((s + model[a, b, 0], t) for (a, b), (s, t) in best.items())[1].encode("latin-1")


class Restorer:
    """Restores whole texts; remembers readings of short stretches, up to a bound."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def _one(self, match) -> bytes:
        span = match[0]
        got = self.known.get(span)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = restore(span, self.model)
            if len(span) <= 40:
                self.known[span] = got
        return got

    def text(self, raw: bytes) -> bytes:
        return SUSPECT.sub(self._one, raw.lower())

    def chunk(self, chunk: Chunk) -> Chunk:
        return Chunk([self.text(t) for t in chunk.texts], chunk.rows)


def restored_texts(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id and the restored lower-case text of every row, empty for null."""
    reader = Restorer(model)

    def make(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        return {"doc_id": rows.column("doc_id"), "restored": pa.array([reader.text(t).decode("utf-8", "replace") for t in chunk.texts], pa.string())}

    return map_texts(docs.select("doc_id", "text"), make, "doc_id long, restored string")


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and of their beginnings, repeated letters taken once; and the text of each."""
    data = chunk.data
    keep = np.append(True, (data[1:] != data[:-1]) | ~ALNUM[data[1:]])
    edges = np.concatenate(([0], np.cumsum(keep)))
    short = Chunk.__new__(Chunk)
    short.data, short.n, short.rows = data[keep], chunk.n, chunk.rows
    short.begin, short.end = edges[chunk.begin], edges[chunk.end]
    words = short.words(ALNUM)
    roll, owner, size = rolling_bytes(words.data), words.owner(), words.end - words.begin
    found, text = [roll.hash(words.begin, words.end)], [owner]
    for n in PREFIXES:
        at = words.begin[size > n]
        found.append(roll.hash(at, at + n) ^ np.uint64(1))
        text.append(owner[size > n])
    return np.concatenate(found), np.concatenate(text)


def _pairs(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, hash)."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.empty(0, bool)
    return h[new], text[new]


class Lookup:
    """Places of hashes in a sorted table; most hashes are turned away by a bitmap."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(table >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are in the table, and where."""
        near = np.flatnonzero(self.bits[(h >> np.uint64(48)).astype(np.int64)])
        if not len(self.table):
            return near[:0], near[:0]
        place = np.minimum(np.searchsorted(self.table, h[near]), len(self.table) - 1)
        hit = self.table[place] == h[near]
        return near[hit], place[hit]


def fit(docs: DataFrame, chosen: DataFrame, model: np.ndarray, most: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature hashes and their weights (the bias last), from the labelled texts `chosen` (doc_id, label), a bounded sample."""
    texts = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    reader = Restorer(model)

    def count(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        h, text = _pairs(*features(reader.chunk(chunk)))
        label = rows.column("label").to_numpy()[text].astype(np.int64)
        h, at = np.unique(h, return_inverse=True)
        n, toxic = np.bincount(at, minlength=len(h)), np.bincount(at, weights=label, minlength=len(h)).astype(np.int64)
        return {"h": as_long(h), "n": n, "toxic": toxic}

    total, bad = texts.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    rate = (bad + 0.5) / (total + 1)
    counted = map_texts(texts, count, "h long, n long, toxic long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    gain = (F.col("toxic") - rate * F.col("n")) / F.sqrt(rate * (1 - rate) * F.col("n"))
    top = counted.filter((F.col("n") >= SUPPORT) & (gain > 3)).orderBy(gain.desc(), "h").limit(most).select("h").collect()
    table = np.sort(np.array([r[0] for r in top], dtype=np.int64).view(np.uint64))
    look = Lookup(table)

    def sparse(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        h, text = features(reader.chunk(chunk))
        hit, place = look(h)
        place, text = _pairs(place.astype(np.int64), text[hit])
        each = np.bincount(text, minlength=chunk.n)
        parts = np.split(place.astype(np.int32), np.cumsum(each)[:-1])
        return {"doc_id": rows.column("doc_id"), "label": rows.column("label"), "index": pa.array([p.tolist() for p in parts], pa.list_(pa.int32()))}

    data = map_texts(texts, sparse, "doc_id long, label int, index array<int>").orderBy(F.xxhash64("doc_id"), F.size("index")).collect()
    first = np.concatenate(([0], np.cumsum([len(r["index"]) for r in data]))).astype(np.int64)
    index = np.array([i for r in data for i in r["index"]], dtype=np.int64)
    label = np.array([r["label"] for r in data], dtype=float)
    return table, train(first, index, np.ones(len(index)), label, len(table) + 1, alpha=0.3, l2=0.5)


class Scorer:
    """A fitted model: score of every text of a chunk."""

    def __init__(self, model: np.ndarray, table: np.ndarray, weights: np.ndarray):
        self.reader, self.look, self.weights = Restorer(model), Lookup(table), weights

    def __call__(self, chunk: Chunk) -> np.ndarray:
        h, text = features(self.reader.chunk(chunk))
        hit, place = self.look(h)
        place, text = _pairs(place.astype(np.int64), text[hit])
        return sigmoid(np.bincount(text, weights=self.weights[:-1][place], minlength=chunk.n) + self.weights[-1])


def fitted(docs: DataFrame, labels: DataFrame, parts: int = 4, fold: int = 2, rows: int = SAMPLE) -> Scorer:
    """The letter model is counted over all texts, the classifier fitted on at most `rows` labelled rows outside the held-out fold."""
    docs = docs.select("doc_id", "text")
    model = letter_model(docs)
    return Scorer(model, *fit(docs, sample(labels, "toxic", parts, fold, rows), model))


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 4, fold: int = 2, threshold: float = THRESHOLD, rows: int = SAMPLE) -> DataFrame:
    """One row per document row: doc_id, held_out, score (0 to 1, higher: likelier toxic) and predicted (1 from `threshold` on).

    Null and empty texts have no feature and get the score of the bias. A null doc_id is held out. Repeated rows are scored alike; other columns
    are left out. Without any label the score is 1/2 everywhere.
    """
    scorer = fitted(docs, labels, parts, fold, rows)

    def score(chunk: Chunk, batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": scorer(chunk)}

    found = map_texts(docs.select("doc_id", "text", held_out(parts, fold).alias("held_out")), score, "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = SAMPLE) -> DataFrame:
    """The rows of `docs`, all columns, that score below `threshold`. With no label to learn from all rows stay."""
    scorer = fitted(docs, labels, rows=rows)
    if not len(scorer.look.table):
        return docs

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = np.concatenate([scorer(c) for c in chunks(batch.column("text"))])
                yield batch.filter(pa.array(score < threshold))

    return short_batches(docs).mapInArrow(run, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), read(spark, sf_dir, "labels"))
