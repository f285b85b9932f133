"""Byte-level BPE with a given vocabulary, encoded and decoded by recursive DuckDB queries inside each partition.

A partition's new words become rows (word, place, token), one for each byte. Each step of the recursion joins neighbouring tokens with
the merge table and contracts, in every word, the leftmost pair of the least rank, until no word has a pair left. A word's ids and bytes
are put together by ordered aggregation. Words are encoded once per task, as far as a bounded cache remembers them.
"""

from __future__ import annotations

import base64
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import documents
from .text import short_batches

#: words that a task remembers; new words that one query takes
CACHE_WORDS, QUERY_WORDS = 500_000, 40_000

# A token's place is its word's number times 2**32 plus its first byte's, so one sort brings neighbours together.
_ENCODE = """
with recursive step(place, token, live) as (
  select place, token, true from letters
  union all
  select s.place, case when s.place = b.place then b.merged else s.token end, b.word is not null
  from step s left join (
    select word, min(rank) >> 32 as merged, (word << 32) + (min(rank) & 4294967295) as place, arg_min(other, rank) as other
    from (select n.place >> 32 as word, n.other, (m.merged << 32) + (n.place & 4294967295) as rank
          from (select place, token, lead(token) over w as following, lead(place) over w as other
                from step where live window w as (order by place)) n
          join merges m on m.pair = (n.token << 32) + n.following where n.other >> 32 = n.place >> 32)
    group by word) b on s.place >> 32 = b.word
  where s.live and (b.word is null or s.place <> b.other))
select s.place >> 32 as word, string_agg(s.token::varchar, ' ' order by s.place) as ids, string_agg(v.hex, '' order by s.place) as bytes, count(*) as n
from step s join vocabulary v on v.token = s.token where not s.live group by s.place >> 32
"""


class Coder:
    """Encodes words by the ranks of a tiktoken file; ids, decoded bytes and number of tokens of each."""

    def __init__(self, ranks_path: str, pattern: str):
        """Tokens below 2**31: pairs are packed into one number."""
        import duckdb
        import regex

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        if max(ranks.values()) >= 1 << 31:
            raise ValueError("ranks have to be below 2**31")
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pattern = regex.compile(pattern)
        self.letters = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        first, second, merged = np.array(pairs, dtype=np.int64).T
        merges = pa.table([pa.array((first << 32) + second), pa.array(merged)], names=["pair", "merged"])  # noqa: F841
        vocabulary = pa.table([pa.array(ranks.values(), pa.int64()), pa.array([t.hex() for t in ranks])], names=["token", "hex"])  # noqa: F841
        self.db.execute("create table merges as from merges").execute("create table vocabulary as from vocabulary")
        self.known: dict[str, tuple[str, bytes, int]] = {}

    def words(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _parts(self, words: list[str]) -> Iterator[list[str]]:
        """At most QUERY_WORDS words and 1 MB together, a longer word alone."""
        part, size = [], 0
        for w in words:
            if part and (len(part) == QUERY_WORDS or size + len(w) > 1 << 20):
                yield part
                part, size = [], 0
            part.append(w)
            size += len(w)
        if part:
            yield part

    def learn(self, words: Collection[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list(words)
        for part in self._parts(new):
            raw = [w.encode() for w in part]
            size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
            word = np.repeat(np.arange(len(raw)), size)
            place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
            letters = pa.table([pa.array((word << 32) + place), pa.array(self.letters[np.frombuffer(b"".join(raw), np.uint8)])],  # noqa: F841
                               names=["place", "token"])
            for w, ids, got, n in self.db.execute(_ENCODE).fetchall():
                self.known[part[w]] = (ids, bytes.fromhex(got), n)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids (decimal, joined by one blank), decoded (binary, the bytes that the ids stand for).

    Every match of `pattern` in the text is encoded by itself with the ranks of the tiktoken file `ranks_path`, without special tokens.
    Null and empty texts have no tokens. Rows are judged one by one, so repeated rows and ids change nothing; other columns are left
    out. A text is held whole in its task; time grows with the square of the length of its longest match.
    """

    def run(batches):
        coder = None
        for batch in batches:
            if coder is None and batch.num_rows:
                coder = Coder(ranks_path, pattern)
            texts = batch.column("text").to_pylist()
            part: list[list[str]] = []
            one: dict[str, str] = {}  # the words of a part, each held once
            out = {"n_tokens": [], "ids": [], "decoded": []}

            def emit():
                coder.learn(one)
                for words in part:
                    found = [coder.known[w] for w in words]
                    out["n_tokens"].append(sum(f[2] for f in found))
                    out["ids"].append(" ".join([f[0] for f in found]))
                    out["decoded"].append(b"".join([f[1] for f in found]))
                part.clear()
                one.clear()

            size = lo = 0
            for i, text in enumerate(texts):
                part.append([one.setdefault(w, w) for w in coder.words(text or "")])
                size += len(text or "")
                if size > 4 << 20 or i + 1 == len(texts):
                    emit()
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, i + 1 - lo), pa.array(out["n_tokens"], pa.int64()),
                                                      pa.array(out["ids"], pa.string()), pa.array(out["decoded"], pa.binary())],
                                                     names=["doc_id", *out])
                    out, size, lo = {c: [] for c in out}, 0, i + 1

    return short_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded binary")


def public_vocabulary() -> tuple[str, str]:
    """Ranks file and pattern of the public byte-level vocabulary."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def op9_byte_pairs(spark, sf_dir: str) -> DataFrame:
    found = encode_decode(documents(spark, sf_dir), *public_vocabulary())
    return found.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
