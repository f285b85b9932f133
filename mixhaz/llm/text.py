"""Whole Arrow batches of texts as flat numpy arrays: words, rolling hashes, sliding minima.

A batch is cut into chunks of about a megabyte (a longer text is a chunk of its own), so that the arrays a task
holds are bounded by that and by its longest text. Hashes are polynomials modulo 2**64 over random byte values,
mixed at the end; two seeds give 128 bits where equality of hashes stands for equality of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 20

_BYTES = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, all other bytes unchanged
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: bytes of words of letters and digits, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
#: bytes of words between blanks, `[^\x20\x09-\x0D]+`
DARK = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))

_STATE: dict = {}
_ODD = {0: 0x9E3779B97F4A7C15, 1: 0xD6E8FEB86659FD93}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit; works in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, from the zeroth. As many as the longest usual chunk so far needs stay in
    memory; a longer text makes its own."""
    key, usual = ("powers", seed), CHUNK_BYTES + (1 << 16)
    if n <= usual and key in _STATE and n <= len(_STATE[key][0]):
        return _STATE[key]
    size = min(max(1 << (n - 1).bit_length(), 1 << 12), usual) if n <= usual else n
    both = []
    for value in (_ODD[seed], pow(_ODD[seed], -1, 1 << 64)):
        steps = np.full(size, value, dtype=np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps, out=steps))
    if n <= usual:
        _STATE[key] = tuple(both)
    return both[0], both[1]


def _byte_values(seed: int) -> np.ndarray:
    key = ("bytes", seed)
    if key not in _STATE:
        _STATE[key] = np.random.default_rng(seed + 1).integers(1, 1 << 64, 256, dtype=np.uint64)
    return _STATE[key]


class Rolling:
    """Hashes of any stretches of a sequence of 64-bit values, from one running sum."""

    def __init__(self, values: np.ndarray, seed: int = 0):
        n = len(values)
        up, self.down = _powers(n + 1, seed)
        self.total = np.empty(n + 1, dtype=np.uint64)
        self.total[0] = 0
        np.cumsum(values * up[:n], out=self.total[1:])

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.total[end] - self.total[begin]) * self.down[begin]
        h += (end - begin).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        return mix(h)

    def grams(self, size: int) -> np.ndarray:
        """Hash of every stretch of `size` values, by its start; empty if there is none."""
        n = len(self.total) - 1
        if n < size:
            return np.empty(0, dtype=np.uint64)
        h = (self.total[size:] - self.total[:n + 1 - size]) * self.down[:n + 1 - size]
        h += np.uint64(size * 0xA24BAED4963EE407 % (1 << 64))
        return mix(h)


def rolling_bytes(data: np.ndarray, seed: int = 0) -> Rolling:
    return Rolling(_byte_values(seed)[data], seed)


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For every `width` consecutive hashes the place of the least (by its upper half; leftmost of equals). Below 2**32 hashes."""
    if len(h) < width or not len(h):
        return np.empty(0, dtype=np.int64)
    low = np.uint64((1 << 32) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[:len(m) - (width - span)], m[width - span:])
    return (m & low).astype(np.int64)


def sliding_minimum_places(h: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the minimum of some `width` consecutive hashes, ascending."""
    at = sliding_argmin(h, width)
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


class Chunk:
    """Some texts of a batch, joined by blanks: `data` holds the bytes, text i is data[begin[i]:end[i]]."""

    def __init__(self, texts: list[bytes], rows: slice):
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self._lay(np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8), size, rows)

    def _lay(self, data: np.ndarray, size: np.ndarray, rows: slice) -> None:
        self.data, self.rows, self.n = data, rows, len(size)
        self.end = np.cumsum(size + 1) - 1
        self.begin = self.end - size

    @classmethod
    def of(cls, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, rows: slice) -> Chunk:
        """The texts at flat[begin:begin + size], copied once out of a column's buffer."""
        self = cls.__new__(cls)
        self._lay(np.full(int(size.sum()) + len(size), 32, dtype=np.uint8), size, rows)
        for to, at, n in zip(self.begin.tolist(), begin.tolist(), size.tolist()):
            self.data[to:to + n] = flat[at:at + n]
        return self

    @property
    def texts(self) -> list[bytes]:
        whole = self.data.tobytes()
        return [whole[a:b] for a, b in zip(self.begin.tolist(), self.end.tolist())]

    def words(self, kind: np.ndarray, lower: bool = True) -> Words:
        return Words(self, kind, lower)


class Words:
    """The words of a chunk: bytes [begin, end); those of text i are words first[i] to first[i + 1]."""

    def __init__(self, chunk: Chunk, kind: np.ndarray, lower: bool):
        self.data = LOWER[chunk.data] if lower else chunk.data
        inside = kind[self.data].view(np.int8)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        self.begin, self.end = edge[0::2], edge[1::2]  # the last byte is a blank, so every word ends
        self.first = np.searchsorted(self.begin, np.append(chunk.begin, len(chunk.data)))
        self.count = np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return rolling_bytes(self.data, seed).hash(self.begin, self.end)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a column, null as empty, in chunks of about `size` bytes. One chunk at a time is copied out of the column's buffer."""
    if not len(column):
        return
    column = column.cast(pa.binary())
    _, offsets, buffer = column.buffers()
    edges = np.frombuffer(offsets, dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, np.uint8)
    length = np.diff(edges)
    if column.null_count:
        length[column.is_null().to_numpy(zero_copy_only=False)] = 0
    upto = np.cumsum(length + 1)
    lo = 0
    while lo < len(length):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + size, side="right")))
        yield Chunk.of(flat, edges[lo:hi], length[lo:hi], slice(lo, hi))
        lo = hi


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lists(values: pa.Array | np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A list column from its flat values and the length of each list."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    flat = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def take(rows: pa.RecordBatch, text: np.ndarray) -> dict:
    """doc_id and key of the texts of some results."""
    pick = pa.array(text)
    return {"doc_id": rows.column("doc_id").take(pick), "key": rows.column("key").take(pick)}


def flat_lists(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat numbers of a list column (null: none), and the row of each."""
    sizes = np.diff(values.offsets.to_numpy())
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(values)), sizes)


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo..hi, and the range of each."""
    n = hi - lo + 1
    owner = np.repeat(np.arange(len(lo)), n)
    return lo[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), owner


#: rows of an Arrow batch: whole texts come in batches, so short ones bound a task's memory
BATCH_ROWS = 1000


def short_batches(df: DataFrame) -> DataFrame:
    """`df`, after lowering the session's rows per Arrow batch, unless somebody has set it."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, BATCH_ROWS)
    return df


def made(batches: Iterator[pa.RecordBatch], make: Callable[[Chunk, pa.RecordBatch], dict], column: str = "text",
         size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """What `make(chunk, rows of the batch that the chunk holds)` returns as columns, a batch for each chunk of about `size` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        for chunk in chunks(batch.column(column), size):
            part = batch.slice(chunk.rows.start, chunk.n)
            columns = make(chunk, part)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()],
                                             names=list(columns))


def map_texts(df: DataFrame, make: Callable[[Chunk, pa.RecordBatch], dict], schema: str, column: str = "text",
              size: int = CHUNK_BYTES) -> DataFrame:
    """Rows that `make(chunk, rows of the batch that the chunk holds)` returns as columns; chunks are of about `size` bytes."""
    return short_batches(df).mapInArrow(lambda batches: made(batches, make, column, size), schema)
