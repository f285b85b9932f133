"""Prefix trie of conversations: every beginning that conversations share is a node.

A turn becomes an id of 16 bytes (a digest of role and text), a conversation the ids of its turns in a row. These keys are dealt by their
order, so each task reads one stretch of them, ascending, and fills an adaptive radix tree (`radix_tree`) from which finished branches are
taken out every BATCH keys. Only depths of whole turns become nodes. Nodes on the way to a task's first and last key may go on in the
neighbouring tasks: their parts (two paths a task) are added up by node and closed in one small task. A conversation repeated many times is
one key whose rows spread over tasks, as the order goes on by conv_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .radix_tree import Node, RadixTree
from .tables import cut, read, small

#: bytes of a turn's id
WIDTH = 16
#: keys after which finished branches leave a task's tree
BATCH = 50_000
#: conversation ids in one piece of a list to be hashed
PIECE = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()

_FIELDS = [("kind", pa.int8()), ("id", pa.binary()), ("parent_id", pa.binary()), ("turn_id", pa.binary()), ("depth", pa.int64()), ("length", pa.int64()),
           ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
           ("saved_tokens", pa.int64()), ("ends", pa.string()), ("spine", pa.bool_())]
SCHEMA = pa.schema(_FIELDS)
_DDL = ("kind byte, id binary, parent_id binary, turn_id binary, depth long, length long, conv_id long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, ends string, spine boolean")
CLOSED, SEAM, PIECES = 0, 1, 2


def turn_id():
    """Hexadecimal id of a turn from the columns role and text (null: empty)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def packed(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (id, code points of the text). Turns go by number, null first; equal numbers by id.
    Rows without a conv_id take no part; repeated rows are repeated turns. All turns of one conversation meet in one task, by id and length only."""
    one = F.struct("turn", turn_id().alias("id"), F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("length"))
    rows = conversations.select("conv_id", "turn", "role", "text").filter("conv_id IS NOT NULL")
    return (rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
            .select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["length"].alias("length"))).alias("turns")))


def with_shared_heads(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Packed conversations in which conversation c starts like conversation c - c % every: the first h turns of that one (all if fewer, none if
    it is absent), then c's own after its first h; h = crc32(decimal c) % most. `conversations` is packed."""
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = conversations.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    empty = F.slice("turns", 1, 0)
    return (conversations.withColumn("base", base).join(heads, "base", "left")
            .select("conv_id", F.concat(F.slice(F.coalesce("head", empty), F.lit(1), h),
                                        F.slice("turns", h + 1, F.size("turns"))).alias("turns")))


class _Rows:
    """Output columns of a task, handed on as batches."""

    def __init__(self):
        self.columns = [[] for _ in _FIELDS]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)

    def batch(self):
        made = pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(self.columns, _FIELDS)], schema=SCHEMA)
        self.columns = [[] for _ in _FIELDS]
        return made


class _Builder:
    """The nodes of one ascending stretch of keys."""

    def __init__(self, batch: int):
        self.most, self.tree, self.rows = batch, RadixTree(), _Rows()
        self.open: set[bytes] = set()   # nodes on the way to the first (at the end also the last) key
        self.spine: set[bytes] = set()  # nodes that stayed when branches below them were closed

    @staticmethod
    def path(key: bytes) -> list[tuple[int, bytes, bytes | None]]:
        """(depth, node id, turn id) from the root to a key."""
        state, out = hashlib.md5(), [(0, hashlib.md5().digest(), None)]
        for at in range(0, len(key), WIDTH):
            state.update(key[at:at + WIDTH])
            out.append((at // WIDTH + 1, state.copy().digest(), key[at:at + WIDTH]))
        return out

    def close(self, top: Node, parent: Node | None, state, tail: bytes, depth: int, above: bytes | None) -> None:
        """Emit every node of the branch `top` and add what it amounts to to `parent`. state, tail: digest up to the last whole turn above and the
        bytes since; `above`: that turn's node."""
        order = [(top, parent, state, tail, depth, above, None)]
        frames = []
        while order:  # parents before children
            node, over, state, tail, depth, above, low = order.pop()
            bytes_, levels = tail + node.label, []
            if over is None:
                levels.append((0, state.copy().digest(), None))
                above = levels[0][1]
            else:
                state = state.copy()
            at = 0
            while at + WIDTH <= len(bytes_):
                turn = bytes_[at:at + WIDTH]
                state.update(turn)
                depth += 1
                levels.append((depth, state.copy().digest(), turn))
                at += WIDTH
            frames.append((node, over, levels, above, low))
            below = levels[-1][1] if levels else above
            known = (None if below in self.open else node.low) if levels else low
            order.extend((x, node, state, bytes_[at:], depth, below, known) for x in node.children())
        for node, over, levels, above, low in reversed(frames):
            kids, leaves, saved, value = node.kids, node.leaves, node.saved, node.value
            for i in range(len(levels) - 1, -1, -1):
                depth, here, turn = levels[i]
                parent_id = levels[i - 1][1] if i else (above if depth else None)
                length = int(node.lens[depth - 1]) if depth else 0
                if here in self.open:
                    self.rows.add(SEAM, here, parent_id, turn, depth, length, node.low, None, node.n, kids, leaves, saved, value, True)
                    kids = leaves = saved = 0
                else:
                    leaves = leaves or 1
                    saved += (node.n - 1) * length
                    parent_low = (None if parent_id in self.open else node.low) if i else low
                    self.rows.add(CLOSED, here, parent_id, turn, depth, length, node.low, parent_low, node.n, kids, leaves, saved, value or NO_ENDS, here in self.spine)
                    self.spine.discard(here)
                    kids = 1
                value = None
            if over is not None:
                over.kids, over.leaves, over.saved = over.kids + kids, over.leaves + leaves, over.saved + saved

    def sweep(self, last: bytes) -> None:
        """Close all branches beside the way to `last`, the greatest key so far."""
        self.spine.update(x[1] for x in self.path(last))
        node, at, state, tail, depth, above = self.tree.root, 0, hashlib.md5(), b"", 0, hashlib.md5().digest()
        while True:
            step = node.child(last[at]) if at < len(last) else None
            for x in node.children():
                if x is not step:
                    node.drop(x)
                    self.close(x, node, state, tail, depth, above)
            if step is None:
                return
            tail += step.label
            at += len(step.label)
            while len(tail) >= WIDTH:
                state.update(tail[:WIDTH])
                tail, depth = tail[WIDTH:], depth + 1
                above = state.copy().digest()
            node = step

    def pieces(self, key: bytes, lists: list[tuple[int, str]]) -> None:
        here = hashlib.md5(key).digest()
        for first, text in lists:
            self.rows.add(PIECES, here, None, None, None, None, first, None, None, None, None, None, text, None)

    def run(self, batches):
        key = lens = None
        first = True
        n, low, digest, lists, held = 0, None, None, [], []

        def flush() -> None:
            """Put away conversation ids of the key that is being read; they ascend."""
            nonlocal held
            text = ",".join(map(str, held))
            digest.update(("," + text if n > len(held) else text).encode())
            lists.append((held[0], text))
            held = []

        def end(final: bool) -> None:
            nonlocal first
            if held:
                flush()
            if first:
                self.open.update(x[1] for x in self.path(key))
            edge = first or final
            if edge:
                self.pieces(key, lists)
            self.tree.insert(key, n, low, lens, None if edge else digest.hexdigest())
            first = False

        inserted = 0
        for batch in batches:
            keys = batch.column("key").to_pylist()
            ids = batch.column("conv_id").to_pylist()
            sizes = batch.column("lengths")
            for i, k in enumerate(keys):
                if k != key:
                    if key is not None:
                        end(False)
                        inserted += 1
                        if inserted % self.most == 0:
                            self.sweep(key)
                            yield self.rows.batch()
                    key, lens = k, np.asarray(sizes[i].as_py(), dtype=np.int64)
                    n, low, digest, lists, held = 0, ids[i], hashlib.sha256(), [], []
                n += 1
                held.append(ids[i])
                if len(held) >= PIECE:
                    flush()
        if key is None:
            return
        end(True)
        self.open.update(x[1] for x in self.path(key))
        self.close(self.tree.root, None, hashlib.md5(), b"", 0, None)
        yield self.rows.batch()


def _digests(batches):
    """SHA-256 of each node's pieces, which come in order."""
    now, digest, out = None, None, ([], [])
    for batch in batches:
        for here, text in zip(batch.column("id").to_pylist(), batch.column("ends").to_pylist()):
            if here != now:
                if now is not None:
                    out[0].append(now)
                    out[1].append(digest.hexdigest())
                now, digest = here, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
    if now is not None:
        out[0].append(now)
        out[1].append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], names=["id", "ends"])


def _resolve(batches):
    """The seam's nodes, deepest first, with what their children amount to; then each with its parent's least member."""
    rows, more, low = [], {}, {}
    for batch in batches:
        for r in batch.to_pylist():
            kids, leaves, saved = more.pop(r["id"], (0, 0, 0))
            r["n_children"] += kids
            r["n_leaves"] = r["n_leaves"] + leaves or 1
            r["saved_tokens"] += saved + (r["n_convs"] - 1) * r["length"]
            if r["parent_id"] is not None:
                a, b, c = more.get(r["parent_id"], (0, 0, 0))
                more[r["parent_id"]] = a + 1, b + r["n_leaves"], c + r["saved_tokens"]
            low[r["id"]] = r["conv_id"]
            rows.append(r)
    for r in rows:
        r |= {"kind": CLOSED, "parent_conv_id": low.get(r["parent_id"]), "ends": r["ends"] or NO_ENDS, "spine": True}
    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


def prefix_trie(conversations: DataFrame, batch: int = BATCH) -> DataFrame:
    """One row per node of the trie of packed conversations: id and parent_id (digests of the path), turn_id (its last turn), depth, length (code
    points of its last text), conv_id (its least member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (summed over its subtree:
    (n_convs - 1) * length) and ends (SHA-256 of the ids, ascending and joined by commas, of the conversations that end here).

    Conversations without turns end at the root. No conversation, no node. Equality of turns is equality of 128-bit ids. The seam between tasks,
    two paths for each, is closed in one task; a key and its lengths (20 bytes a turn) have to fit into a task.
    """
    keys = cut(conversations.select("conv_id", F.unhex(F.array_join(F.col("turns.id"), "")).alias("key"), F.col("turns.length").alias("lengths")))
    order = ["key", "conv_id"]

    def run(batches):
        yield from _Builder(batch).run(batches)

    made = cut(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _DDL))
    lists = (made.filter(F.col("kind") == PIECES).select("id", "conv_id", "ends").repartition("id").sortWithinPartitions("id", "conv_id")
             .mapInArrow(_digests, "id binary, ends string"))
    same = ["id", "parent_id", "turn_id", "depth", "length"]
    seam = (made.filter(F.col("kind") == SEAM).groupBy(*same)
            .agg(F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
            .join(lists.withColumnRenamed("ends", "joined"), "id", "left").withColumn("ends", F.coalesce("joined", "ends")).drop("joined").repartition(1).sortWithinPartitions(F.desc("depth")))
    seam = cut(seam.mapInArrow(_resolve, _DDL))
    closed = made.filter(F.col("kind") == CLOSED)
    alone = (F.col("parent_conv_id").isNull()) & F.col("parent_id").isNotNull()
    above = closed.filter("spine").unionByName(seam).select(F.col("id").alias("parent_id"), F.col("conv_id").alias("found"))
    waiting = closed.filter(alone).join(small(above), "parent_id", "left").withColumn("parent_conv_id", F.col("found")).drop("found")
    names = ["id", "parent_id", "turn_id", "depth", "length", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    return closed.filter(~alone).select(*names).unionByName(waiting.select(*names)).unionByName(seam.select(*names))


def with_texts(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """`nodes` with the role and text of each node's last turn (null at the root); `conversations`: conv_id, turn, role, text."""
    words = (conversations.select(F.unhex(turn_id()).alias("turn_id"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
             .dropDuplicates(["turn_id"]))
    return nodes.join(words, "turn_id", "left")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations. A null turn comes first, null roles and texts are empty; rows without a conv_id take no part;
    turns of one number go by their digest; an empty table has no nodes."""
    turns = cut(packed(read(spark, sf_dir, "conversations")))
    return prefix_trie(with_shared_heads(turns)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                                        F.col("ends").alias("ends_sha256"))
