"""Personal data in texts, and terms that give it away.

Four kinds are found by form: e-mail and IP addresses, payment cards, telephone numbers. Each value found is a protected entity. Terms (words)
and forms of terms (letters and digits as classes) that stand near an entity are counted with it; how much a term t tells of an entity e is

    disclosure(t, e) = PMI(e; t) / IC(e) = 1 - ln(df(t) / df(t, e)) / ln(N / df(e))

over documents: 1 if e stands near t in every document that has t, 0 if t is as common elsewhere. A term that reaches ALPHA for some entity, seen
with it in SUPPORT different texts, gives it away wherever it stands. Sanitising replaces it by its form, if that keeps below ALPHA itself, else it
is removed. Everything is counted over all documents; only words near an entity are ever paired with it, so pairs grow with the entities found.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import attach_few, carried, cut, documents, keyed, small
from .text import ALNUM, Chunk, Words, as_long, chunks, map_texts, rolling_bytes, short_batches

KINDS = ("email", "ip", "card", "phone", "term")
TERM = 4
#: words on each side of an entity that are counted with it
NEAR = 8
ALPHA = 0.9
#: different texts in which a term has to stand near an entity
SUPPORT = 3
#: leading bits of hashes by which words are sorted out before the join
BITS = 22

# fixed patterns of the four kinds; a number that starts inside a run of digits could only match where the run's start does
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = np.zeros(256, bool)
_LOCAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True
_IP = re.compile(rb"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(rb"[^0-9]+")

#: bytes of a word's form: one for letters, one for digits
_FORM = np.full(256, ord("x"), dtype=np.uint8)
_FORM[48:58] = ord("0")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: bytes):
    """Leftmost addresses. An address holds one @, so its local part is the run before it, back to the last address's end."""
    done, at = 0, text.find(b"@")
    while at >= 0:
        begin = at
        while begin > done and _LOCAL[text[begin - 1]]:
            begin -= 1
        match = _DOMAIN.match(text, at + 1) if begin < at else None
        if match:
            done = match.end()
            yield begin, done
        at = text.find(b"@", max(at + 1, done))


def base_spans(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, kind, end, value) in bytes, by start and kind; values are compared without case, blanks and signs."""
    found = [(a, 0, b, text[a:b].lower()) for a, b in _emails(text)]
    for match in _IP.finditer(text):
        parts = [p.lstrip(b"0") or b"0" for p in match.group().split(b".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append((match.start(), 1, match.end(), b".".join(parts)))
    for kind, pattern in ((2, _CARD), (3, _PHONE)):
        for match in pattern.finditer(text):
            digits = _DIGITS.sub(b"", match.group())
            if (14 <= len(digits) <= 19 and luhn(digits)) if kind == 2 else 10 <= len(digits) <= 15:
                found.append((match.start(), kind, match.end(), digits))
    return sorted(found)


class _Found:
    """Base spans of a chunk in bytes of its data, with the text that each is in."""

    def __init__(self, chunk: Chunk):
        spans = [(i, *s) for i, t in enumerate(chunk.texts) for s in base_spans(t)]
        self.text = np.array([s[0] for s in spans], dtype=np.int64)
        self.kind = np.array([s[2] for s in spans], dtype=np.int64)
        begin = chunk.begin[self.text]
        self.start = begin + np.array([s[1] for s in spans], dtype=np.int64)
        self.end = begin + np.array([s[3] for s in spans], dtype=np.int64)
        self.values = [bytes([s[2]]) + s[4] for s in spans]

    def free(self, words: Words, chunk: Chunk) -> np.ndarray:
        """Words that no base span touches."""
        covered = np.zeros(len(chunk.data) + 1, dtype=np.int32)
        np.add.at(covered, self.start, 1)
        np.add.at(covered, self.end, -1)
        inside = np.append(0, np.cumsum(np.cumsum(covered) > 0))
        return inside[words.end] == inside[words.begin]


def hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, and of each word's form."""
    return words.hashes(), rolling_bytes(_FORM[words.data], 1).hash(words.begin, words.end)


def neighbours(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """(entity, term, what, body): once for each document row, what stands near an entity: words (what = 0) and forms (1); the entity itself (2).
    body is a hash of the whole text."""

    def make(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        found = _Found(chunk)
        out = [np.empty((0, 4), dtype=np.uint64)]
        if len(found.text):
            values = Chunk(found.values, slice(0, len(found.values)))
            entity = rolling_bytes(values.data).hash(values.begin, values.end)
            body = rolling_bytes(chunk.data).hash(chunk.begin, chunk.end)[found.text]
            words = chunk.words(ALNUM)
            free = np.flatnonzero(found.free(words, chunk))
            h, g = hashes(words)
            h, g, owner, begin = h[free], g[free], words.owner()[free], words.begin[free]
            left, right = np.searchsorted(begin, found.start), np.searchsorted(begin, found.end)
            first, stop = np.searchsorted(owner, found.text), np.searchsorted(owner, found.text, side="right")
            lo, hi = np.maximum(left - near, first), np.minimum(right + near, stop)
            n = hi - lo
            span = np.repeat(np.arange(len(n)), n)
            place = lo[span] + np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
            text = found.text.astype(np.uint64)
            for what, term in ((0, h), (1, g)):
                out.append(np.stack([text[span], entity[span], term[place], np.full(len(span), what, np.uint64)], axis=1))
            out.append(np.stack([text, entity, np.zeros(len(text), np.uint64), np.full(len(text), 2, np.uint64)], axis=1))
            every = np.unique(np.concatenate(out), axis=0)
            whole = dict(zip(found.text.tolist(), body.tolist()))
            body = np.array([whole[t] for t in every[:, 0].tolist()], dtype=np.uint64)
        else:
            every, body = out[0], np.empty(0, np.uint64)
        return {"entity": as_long(every[:, 1]), "term": as_long(every[:, 2]), "what": every[:, 3].astype(np.int8), "body": as_long(body)}

    return map_texts(docs, make, "entity long, term long, what byte, body long")


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, what, n): partial counts of the document rows that have a word (0) or a form (1)."""

    def make(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        words = chunk.words(ALNUM)
        owner = words.owner()
        term, n, what = [], [], []
        for k, h in enumerate(hashes(words)):
            order = np.lexsort((owner, h))
            h, who = h[order], owner[order]
            new = np.append(True, h[1:] != h[:-1]) if len(h) else np.empty(0, bool)
            once = new | np.append(True, who[1:] != who[:-1]) if len(h) else new
            first = np.flatnonzero(new)
            term.append(h[first])
            n.append(np.add.reduceat(once.astype(np.int64), first) if len(first) else np.empty(0, np.int64))
            what.append(np.full(len(first), k, np.int8))
        return {"term": as_long(np.concatenate(term)), "what": np.concatenate(what), "n": np.concatenate(n)}

    return map_texts(docs, make, "term long, what byte, n long")


def disclosing(docs: DataFrame, near: int = NEAR, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(term, what, disclosure): hashes of the words (what = 0) and forms (1) that give some entity away, with their greatest disclosure."""
    seen = cut(neighbours(docs, near))
    total = docs.count()
    entities = seen.filter("what = 2").groupBy("entity").agg(F.count("*").alias("df_entity"))
    pairs = (seen.filter("what < 2").groupBy("entity", "term", "what").agg(F.count("*").alias("together"), F.countDistinct("body").alias("texts"))
             .filter(F.col("texts") >= support).drop("texts"))
    pairs = cut(pairs.join(entities, "entity"))
    wanted = small(cut(pairs.select("term", "what").distinct()))
    counts = term_counts(docs).join(wanted, ["term", "what"], "left_semi").groupBy("term", "what").agg(F.sum("n").alias("df_term"))
    told = F.when(F.col("df_entity") < total, 1 - F.log(F.col("df_term") / F.col("together")) / F.log(F.lit(float(total)) / F.col("df_entity")))
    return (pairs.join(counts, ["term", "what"]).withColumn("disclosure", told).filter(F.col("disclosure") >= alpha)
            .groupBy("term", "what").agg(F.max("disclosure").alias("disclosure")))


def _terms_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, key, terms): the disclosing words of each document that has any, as (term, form given away, too)."""
    words, forms = terms.filter("what = 0").select("term"), terms.filter("what = 1").select(F.col("term").alias("form"), F.lit(True).alias("known"))
    # at most 2 ** BITS numbers, however many terms: words without a bit here are no terms
    bits = [r[0] for r in words.select(F.shiftrightunsigned("term", 64 - BITS).alias("b")).distinct().collect()]
    filled = np.zeros(1 << BITS, dtype=bool)
    filled[bits] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(filled))

    def make(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        bits = np.unpackbits(sent.value).view(bool)
        words = chunk.words(ALNUM)
        h, g = hashes(words)
        near = np.flatnonzero(bits[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        every = np.unique(np.stack([words.owner()[near].astype(np.uint64), h[near], g[near]], axis=1), axis=0)
        text = pa.array(every[:, 0].astype(np.int64))
        return {"doc_id": rows.column("doc_id").take(text), "key": rows.column("key").take(text), "term": as_long(every[:, 1]), "form": as_long(every[:, 2])}

    rows = map_texts(docs, make, "doc_id long, key long, term long, form long")
    hits = rows.join(small(words), "term", "left_semi").join(small(forms), "form", "left")
    return (hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct("term", F.coalesce("known", F.lit(False)).alias("gone"))).alias("terms")))


_SPANS = [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.ByteType()),
                                                            T.StructField("stop", T.LongType()), T.StructField("by", T.StringType())])))]


def private_spans(docs: DataFrame, near: int = NEAR, alpha: float = ALPHA, support: int = SUPPORT, carry: bool = False) -> DataFrame:
    """One row per document row: doc_id, key, spans, an array of (start, kind, stop, by) by start and kind: code points, stop exclusive; kind is a
    place in KINDS; `by` is what replaces the span in a sanitised text. carry: the text and a struct `row` of the other columns, too (see `keyed`).

    Null and empty texts have no spans. Repeated rows count, and are marked, each; so do rows of one doc_id with different texts. A word that a
    base span touches is no term. Words and entities are compared by 64-bit hashes. If every document has an entity, nothing gives it away.
    """
    base = keyed(docs, carry)
    plain = base.select("doc_id", "key", "text")
    terms = cut(disclosing(plain, near, alpha, support))
    marks = cut(_terms_of(plain, terms))
    rows = attach_few(base, marks, "left")

    def make(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")) if batch.num_rows else ():
                part = batch.slice(chunk.rows.start, chunk.n)
                found = _Found(chunk)
                text, kind, start, stop = found.text, found.kind, found.start, found.end
                by = np.array([f"[{KINDS[k]}]" for k in kind], dtype=object)
                marked = part.column("terms")
                sizes = np.diff(marked.offsets.to_numpy())
                if sizes.sum():
                    flat = marked.flatten()
                    who = np.repeat(np.arange(chunk.n), sizes)
                    term, gone = flat.field("term").to_numpy().view(np.uint64), flat.field("gone").to_numpy(zero_copy_only=False)
                    words = chunk.words(ALNUM)
                    owner, h = words.owner(), words.hashes()
                    order = np.lexsort((term, who))
                    who, term, gone = who[order], term[order], gone[order]
                    # place of each word's (text, hash) among the marks of its text
                    pair = np.empty(len(who) + len(h), dtype=[("t", np.int64), ("h", np.uint64)])
                    pair["t"], pair["h"] = np.append(who, owner), np.append(term, h)
                    _, number = np.unique(pair, return_inverse=True)
                    first = np.full(number.max() + 1, -1)
                    first[number[:len(who)]] = np.arange(len(who))
                    place = first[number[len(who):]]
                    hit = np.flatnonzero((place >= 0) & found.free(words, chunk))
                    forms = [_FORM[words.data[a:b]].tobytes().decode() for a, b in zip(words.begin[hit], words.end[hit])]
                    replaced = ["[removed]" if gone[p] else f for p, f in zip(place[hit], forms)]
                    text, kind = np.append(text, owner[hit]), np.append(kind, np.full(len(hit), TERM))
                    start, stop = np.append(start, words.begin[hit]), np.append(stop, words.end[hit])
                    by = np.append(by, np.array(replaced, dtype=object))
                order = np.lexsort((kind, start, text))
                text, kind, start, stop, by = text[order], kind[order], start[order], stop[order], by[order]
                signs = np.append(0, np.cumsum((chunk.data & 0xC0) != 0x80))  # code points before each byte
                offset = signs[chunk.begin[text]]
                spans = pa.StructArray.from_arrays([pa.array(signs[start] - offset), pa.array(kind.astype(np.int8)), pa.array(signs[stop] - offset),
                                                    pa.array(by.tolist(), pa.string())], names=["start", "kind", "stop", "by"])
                ends = np.searchsorted(text, np.arange(chunk.n + 1)).astype(np.int32)
                names = ["doc_id", "key", *(["text", "row"] if carry else [])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.ListArray.from_arrays(pa.array(ends), spans)], names=[*names, "spans"])

    fields = [base.schema[c] for c in ("doc_id", "key", *(("text", "row") if carry else ()))]
    return short_batches(rows).mapInArrow(make, T.StructType([*fields, *_SPANS]))


def sanitised(docs: DataFrame, near: int = NEAR, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """The rows of `docs`, all columns, their texts without personal data: base spans become [kind], disclosing terms their form or [removed].
    Where spans overlap, the one that starts first is replaced and the others up to its end with it. Null texts stay null."""
    found = private_spans(docs, near, alpha, support, carry=True)

    @F.pandas_udf("string")
    def without(texts, spans):
        import pandas as pd

        def one(text, spans):
            if text is None or spans is None or not len(spans):
                return text
            out, at = [], 0
            for s in spans:
                if s["start"] >= at:
                    out += [text[at:s["start"]], s["by"]]
                at = max(at, s["stop"])
            return "".join(out) + text[at:]

        return pd.Series([one(t, s) for t, s in zip(texts, spans)])

    return found.select(carried(docs.columns, {"text": without("text", "spans")}))


def _listed(spans, only_base: bool):
    kinds = F.array(*map(F.lit, KINDS))
    chosen = F.filter(spans, lambda s: s["kind"] < TERM) if only_base else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.get(kinds, s["kind"].cast("int")), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _number(kind: int):
    """Spans of a kind. The kind is no argument of the inner function: a second one would be given the place in the array."""
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op12_private_data(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data and of terms that give it away, of every document. Null texts have none."""
    found = private_spans(documents(spark, sf_dir))
    count = [_number(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)]
    return found.select("doc_id", *count[:TERM], F.sha2(_listed(F.col("spans"), True), 256).alias("base_sha256"), _listed(F.col("spans"), False).alias("spans"),
                        count[TERM])
