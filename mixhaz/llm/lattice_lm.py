"""Language-model score of texts: a subword lattice under existing vocabulary scores, with the corpus's own words on top.

A word's lattice holds every way to cut it into pieces of a given vocabulary; the forward recursion in log space sums over all of them.
With pieces weighted by the vocabulary's scores this is a distribution over words. Training counts come first, the lattice gets the share of
words seen for the first time (Witten-Bell): P(word) = (c + V * lattice(word)) / (N + V + 1), P(end) = (c + 1) / (N + V + 1).
Words do not share pieces, so a text's marginal probability is the product over its words, and each distinct word is summed once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import held_out
from .tables import cut, documents, keyed
from .text import DARK, Chunk, _byte_values, _powers, as_long, map_texts, mix, rolling_bytes

#: distinct words, the most frequent ones, whose values are sent to every task at most; all other words are joined
FREQUENT = 500_000
#: rank that is added to a piece's before it is inverted to a weight
SHIFT = 2.7
DP_WORDS, DP_BYTES = 50_000, 1 << 20
#: rounds in which the pieces' weights are fitted to the distinct training words; 0 takes the vocabulary's scores alone
ROUNDS = 1


def piece_weights(model_path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (a blank for the mark of a word's start) and their log-probabilities.

    The vocabulary's scores are minus ranks; a piece weighs 1 / (rank + SHIFT). Pieces that cannot stand in a lower-case word are
    left out, single bytes are the fall-back for all else, as in the vocabulary itself.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    weight: dict[bytes, float] = {}
    worst = max((-model.get_score(i) for i in range(model.vocab_size())), default=0.0)
    for i in range(model.vocab_size()):
        piece, rank = model.id_to_piece(i), -model.get_score(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        if model.is_byte(i):
            raw, rank = bytes([int(piece[1:-1], 16)]), worst + 1
        else:
            raw = piece.replace("▁", " ").encode()
            if b" " in raw[1:] or any(65 <= b <= 90 for b in raw):
                continue
        weight[raw] = weight.get(raw, 0.0) + 1 / (max(rank, 0.0) + SHIFT)
    weight.setdefault(b" ", 1 / (worst + SHIFT))
    pieces = sorted(weight)
    p = np.array([weight[x] for x in pieces])
    return pieces, np.log(p / p.sum())


class Lattice:
    """Forward sums over all segmentations of words, many words of one length at a time."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.longest = max(map(len, pieces))
        values, (up, down) = _byte_values(0), _powers(self.longest + 1, 0)
        h = np.array([self._hash(np.sum(values[np.frombuffer(p, np.uint8)] * up[:len(p)], dtype=np.uint64), len(p)) for p in pieces], dtype=np.uint64)
        order = np.argsort(h)
        self.table, self.log_p, self.order = h[order], log_p[order], order
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.table >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def _hash(x, size: int):
        return mix(np.atleast_1d(np.asarray(x, dtype=np.uint64) + np.uint64(size * 0xA24BAED4963EE407 % (1 << 64))))[0 if np.ndim(x) == 0 else slice(None)]

    def _arcs(self, words: np.ndarray):
        """Forward sums and all arcs (begin, stop, words, pieces) of words of one length: bytes, a row for each, with the leading blank."""
        n, size = words.shape
        up, down = _powers(size + 1, 0)
        total = np.zeros((n, size + 1), dtype=np.uint64)
        np.cumsum(_byte_values(0)[words] * up[:size], axis=1, out=total[:, 1:])
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = 0.0
        arcs = []
        for stop in range(1, size + 1):
            for begin in range(max(0, stop - self.longest), stop):
                h = self._hash((total[:, stop] - total[:, begin]) * down[begin], stop - begin)
                near = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
                if len(near):
                    place = np.minimum(np.searchsorted(self.table, h[near]), len(self.table) - 1)
                    hit = self.table[place] == h[near]
                    near, place = near[hit], place[hit]
                    alpha[stop, near] = np.logaddexp(alpha[stop, near], alpha[begin, near] + self.log_p[place])
                    arcs.append((begin, stop, near, place))
        return alpha, arcs

    def _by_length(self, words: list[bytes]):
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            yield at, np.frombuffer(b"".join([b" " + words[i] for i in at]), dtype=np.uint8).reshape(len(at), n + 1)

    def log_sums(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words))
        for at, rows in self._by_length(words):
            out[at] = self._arcs(rows)[0][-1]
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected number of times that each piece stands in the words, over all segmentations."""
        count = np.zeros(len(self.table))
        for _, rows in self._by_length(words):
            alpha, arcs = self._arcs(rows)
            beta = np.full(alpha.shape, -np.inf)
            beta[-1] = -alpha[-1]
            for begin, stop, near, place in reversed(arcs):
                step = self.log_p[place] + beta[stop, near]
                beta[begin, near] = np.logaddexp(beta[begin, near], step)
                count += np.bincount(place, weights=np.exp(alpha[begin, near] + step), minlength=len(count))
        out = np.empty(len(count))
        out[self.order] = count
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): every distinct word, its count in training rows (`held_out` false) and in all."""

    def count(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        words = chunk.words(DARK)
        _, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        train = ~rows.column("held_out").to_numpy(zero_copy_only=False)[words.owner()]
        data = words.data.tobytes()
        text = [data[a:b] for a, b in zip(words.begin[first].tolist(), words.end[first].tolist())]
        return {"word": pa.array(text, pa.binary()), "c": np.bincount(which, weights=train, minlength=len(first)).astype(np.int64),
                "n": np.bincount(which, minlength=len(first))}

    return map_texts(docs, count, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _batched(batches, work):
    """`work` on tables of about DP_WORDS rows or DP_BYTES bytes of words, so that words of one length come together."""
    held, rows, size = [], 0, 0
    for whole in batches:
        ends = np.cumsum(pc.binary_length(whole.column("word")).to_numpy()) if whole.num_rows else np.empty(0)
        lo = 0
        while lo < whole.num_rows:
            done = ends[lo - 1] if lo else 0
            if rows and size + ends[lo] - done > DP_BYTES:  # a long word begins a batch of its own
                yield work(pa.Table.from_batches(held))
                held, rows, size = [], 0, 0
            hi = min(max(lo + 1, int(np.searchsorted(ends, done + DP_BYTES - size, side="right"))), lo + DP_WORDS - rows, whole.num_rows)
            held.append(whole.slice(lo, hi - lo))
            rows, size, lo = rows + hi - lo, size + int(ends[hi - 1] - done), hi
            if rows >= DP_WORDS or size >= DP_BYTES or lo < whole.num_rows:
                yield work(pa.Table.from_batches(held))
                held, rows, size = [], 0, 0
    if rows:
        yield work(pa.Table.from_batches(held))


def fitted_weights(counts: DataFrame, pieces: list[bytes], log_p: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log-probabilities after `rounds` of expectation and maximisation over the distinct training words, each once; the vocabulary's own weights
    stay in as one count for each piece on average. A sum for each piece comes to the driver."""
    first = np.exp(log_p)
    for _ in range(rounds):
        now = log_p

        def run(batches):
            lattice = Lattice(pieces, now)

            def work(part: pa.Table) -> pa.RecordBatch:
                count = lattice.expected(part["word"].to_pylist())
                at = np.flatnonzero(count)
                return pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["piece", "times"])

            yield from _batched(batches, work)

        times = first * len(pieces)
        for piece, n in counts.filter("c > 0").select("word").mapInArrow(run, "piece long, times double").groupBy("piece").agg(F.sum("times")).collect():
            times[piece] += n
        log_p = np.log(times / times.sum())
    return log_p


def word_values(counts: DataFrame, model_path: str, rounds: int = ROUNDS) -> DataFrame:
    """(h, c, n, lattice): the words' hashes and the natural logarithms of their lattice sums."""
    pieces, log_p = piece_weights(model_path)
    log_p = fitted_weights(counts, pieces, log_p, rounds)

    def run(batches):
        lattice = Lattice(pieces, log_p)

        def work(part: pa.Table) -> pa.RecordBatch:
            words = part["word"].to_pylist()
            chunk = Chunk(words, slice(0, len(words)))
            h = rolling_bytes(chunk.data).hash(chunk.begin, chunk.end)
            return pa.RecordBatch.from_arrays([as_long(h), part["c"].combine_chunks(), part["n"].combine_chunks(), pa.array(lattice.log_sums(words))],
                                              names=["h", "c", "n", "lattice"])

        yield from _batched(batches, work)

    return counts.mapInArrow(run, "h long, c long, n long, lattice double")


def _frequent(values: DataFrame, most: int) -> int:
    """The least count from which on there are at most `most` words (a power of 2 ** (1/8), rounded up)."""
    step = F.floor(F.log2("n") * 8).cast("int")
    total, limit = 0, None
    for s, n in sorted(((r[0], r[1]) for r in values.groupBy(step.alias("s")).count().collect()), reverse=True):  # some hundred rows
        total += n
        if total > most:
            break
        limit = s
    return 1 << 62 if limit is None else int(np.ceil(2 ** (limit / 8) - 1e-9))


def lattice_scores(docs: DataFrame, model_path: str, parts: int = 5, fold: int = 1, most: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    Tokens are the text's words (A-Z lower-cased, divided by blanks) and one end. Counts come from all rows outside the held-out fold; a null
    doc_id is held out. base_score sums log10((c + 0.5) / (N + 0.5 * (V + 1))). Null and empty texts have the end only. Repeated rows count, and
    are scored, each; other columns are left out.
    """
    docs = keyed(docs).withColumn("held_out", held_out(parts, fold))
    values = cut(word_values(cut(word_counts(docs)), model_path, rounds))
    ends = docs.filter("not held_out").count()
    words, kinds = values.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.expr("int(c > 0)")), F.lit(0))).first()
    total, distinct = words + ends, kinds + (ends > 0)
    rest = max(distinct, 1)
    base_all, score_all = np.log10(total + 0.5 * (distinct + 1)), np.log10(total + rest + 1)
    # a long word's lattice sum is below the least double; an unseen word's value stays a logarithm
    unseen = lambda lattice: lattice / float(np.log(10)) + float(np.log10(rest))
    limit = _frequent(values, most)
    top = values.filter(F.col("n") >= limit).select("h", "c", "lattice").toArrow()  # at most `most` rows
    order = np.argsort(top["h"].to_numpy().view(np.uint64), kind="stable")

    def logs(c, lattice):
        seen = np.log10(np.maximum(c, 1) + rest * np.exp(lattice))
        return np.log10(c + 0.5) - base_all, np.where(c > 0, seen, unseen(lattice)) - score_all

    c = top["c"].to_numpy()[order]
    sent = docs.sparkSession.sparkContext.broadcast((top["h"].to_numpy().view(np.uint64)[order], c > 0, *logs(c, top["lattice"].to_numpy()[order])))
    end_base, end_score = np.log10(ends + 0.5) - base_all, np.log10(ends + 1) - score_all

    def sums(chunk: Chunk, rows: pa.RecordBatch) -> dict:
        table, known, base, score = sent.value
        words = chunk.words(DARK)
        h, owner = words.hashes(), words.owner()
        if len(table):
            place = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = table[place] == h
        else:
            place, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        seen, place = owner[hit], place[hit]
        add = lambda v: np.bincount(seen, weights=v, minlength=chunk.n)
        rare, who = h[~hit], owner[~hit]
        order = np.lexsort((rare, who))
        rare, who = rare[order], who[order]
        new = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (who[1:] != who[:-1]))) if len(rare) else np.empty(0, np.int64)
        times = np.diff(np.append(new, len(rare)))
        rare, who = rare[new], who[new]
        text = pa.array(np.concatenate([np.arange(chunk.n), who]))
        fill = lambda head, tail: np.concatenate([head, tail])
        nil = np.zeros(len(who))
        key = rows.column("key")
        return {"doc_id": rows.column("doc_id").take(text), "key": key.take(text), "head": np.arange(len(text)) < chunk.n,
                "times": fill(words.count + 1, times), "known": fill(add(known[place]).astype(np.int64) + (ends > 0), nil.astype(np.int64)),
                "base": fill(add(base[place]) + end_base, nil), "score": fill(add(score[place]) + end_score, nil),
                "h": as_long(fill(key.to_numpy().view(np.uint64), rare))}

    made = map_texts(docs, sums, "doc_id long, key long, head boolean, times long, known long, base double, score double, h long")
    found = values.filter(F.col("n") < limit).select(F.col("h").alias("g"), "c", "lattice")
    joined = made.join(found, (F.col("h") == F.col("g")) & ~F.col("head"), "left")
    plain = F.log10(F.col("c") + 0.5) - float(base_all)
    full = F.when(F.col("c") > 0, F.log10(F.col("c") + float(rest) * F.exp("lattice"))).otherwise(unseen(F.col("lattice"))) - float(score_all)
    tail = F.when(F.col("head"), F.lit(0.0))
    each = joined.groupBy("doc_id", "key").agg(
        F.sum(F.col("head").cast("long")).alias("copies"), F.sum(F.when(F.col("head"), F.col("times"))).alias("n_tokens"),
        F.sum(F.when(F.col("head"), F.col("known")).otherwise(F.when(F.col("c") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        F.sum(F.col("base") + tail.otherwise(plain * F.col("times"))).alias("base_score"),
        F.sum(F.col("score") + tail.otherwise(full * F.col("times"))).alias("score"))
    share = lambda name: F.col(name) / F.col("copies")  # noqa: E731  repeated rows were summed
    return each.select("doc_id", held_out(parts, fold).alias("held_out"), share("n_tokens").cast("long").alias("n_tokens"),
                       share("n_known").cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
                       share("base_score").alias("base_score"), share("score").alias("score"),
                       F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def op7_lattice(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return lattice_scores(documents(spark, sf_dir), public.path("piece_bpe_32k.model"))
