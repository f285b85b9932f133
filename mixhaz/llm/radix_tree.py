"""Adaptive radix tree over byte strings, filled in ascending order, whose finished branches can be taken out again.

Inner nodes come in four layouts by their number of children: up to 4 and up to 16 (sorted bytes beside a list), up to 48 (an index of 256
places into a list) and up to 256 (a list by byte). A node grows and shrinks between them. Stretches without a branch are one node's label.
"""

from __future__ import annotations

from bisect import bisect_left, insort

#: children that each layout holds at most
SIZES = (4, 16, 48, 256)


class _Sorted:
    """Bytes in order beside their children: for 4 and for 16."""

    __slots__ = ("room", "bytes", "nodes")

    def __init__(self, room: int):
        self.room, self.bytes, self.nodes = room, [], []

    def get(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node) -> None:
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
        else:
            insort(self.bytes, byte)
            self.nodes.insert(at, node)

    def drop(self, byte: int) -> None:
        at = bisect_left(self.bytes, byte)
        del self.bytes[at], self.nodes[at]

    def items(self):
        return list(zip(self.bytes, self.nodes))

    def __len__(self):
        return len(self.bytes)


class _Indexed:
    """An index of 256 places into a list of at most 48 children."""

    __slots__ = ("room", "index", "nodes", "free")

    def __init__(self, room: int):
        self.room, self.index, self.nodes, self.free = room, bytearray(256), [], []

    def get(self, byte: int):
        at = self.index[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node) -> None:
        at = self.index[byte]
        if at:
            self.nodes[at - 1] = node
        elif self.free:
            at = self.free.pop()
            self.nodes[at - 1], self.index[byte] = node, at
        else:
            self.nodes.append(node)
            self.index[byte] = len(self.nodes)

    def drop(self, byte: int) -> None:
        at = self.index[byte]
        self.index[byte], self.nodes[at - 1] = 0, None
        self.free.append(at)

    def items(self):
        return [(b, self.nodes[at - 1]) for b, at in enumerate(self.index) if at]

    def __len__(self):
        return len(self.nodes) - len(self.free)


class _Direct:
    """A child for each byte."""

    __slots__ = ("room", "nodes", "n")

    def __init__(self, room: int):
        self.room, self.nodes, self.n = room, [None] * 256, 0

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> None:
        self.n += self.nodes[byte] is None
        self.nodes[byte] = node

    def drop(self, byte: int) -> None:
        self.nodes[byte] = None
        self.n -= 1

    def items(self):
        return [(b, x) for b, x in enumerate(self.nodes) if x is not None]

    def __len__(self):
        return self.n


_LAYOUTS = ((_Sorted, 4), (_Sorted, 16), (_Indexed, 48), (_Direct, 256))


class Node:
    """The bytes from the parent's end to here, the children, a value if a key ends here; `n` and `low` of all keys below, and what has been
    folded in from branches taken out: `kids`, `leaves` and `saved` of the parts of its last aligned depth."""

    __slots__ = ("label", "branch", "level", "value", "n", "low", "lens", "kids", "leaves", "saved")

    def __init__(self, label: bytes, lens):
        self.label, self.lens = label, lens
        self.branch, self.level, self.value = None, -1, None
        self.n, self.low = 0, None
        self.kids = self.leaves = self.saved = 0

    def child(self, byte: int):
        return self.branch.get(byte) if self.branch is not None else None

    def put(self, node: Node) -> None:
        byte = node.label[0]
        if self.branch is None:
            self._fit(0)
        elif len(self.branch) == self.branch.room and self.branch.get(byte) is None:
            self._fit(self.level + 1)
        self.branch.put(byte, node)

    def drop(self, node: Node) -> None:
        self.branch.drop(node.label[0])
        if not len(self.branch):
            self.branch, self.level = None, -1
        elif self.level and len(self.branch) <= SIZES[self.level - 1] // 2:
            self._fit(self.level - 1)

    def _fit(self, level: int) -> None:
        kind, room = _LAYOUTS[level]
        fresh = kind(room)
        for byte, node in self.branch.items() if self.branch is not None else ():
            fresh.put(byte, node)
        self.branch, self.level = fresh, level

    def children(self) -> list[Node]:
        return [x for _, x in self.branch.items()] if self.branch is not None else []


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of what `a` and `b` from place `at` have in common at their beginnings."""
    stop = min(len(a), len(b) - at)
    if a[:stop] == b[at:at + stop]:
        return stop
    lo, hi = 0, stop  # halving: whole slices are compared, not bytes
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[at + lo:at + mid]:
            lo = mid
        else:
            hi = mid
    return lo


class RadixTree:
    def __init__(self):
        self.root = Node(b"", ())
        self.size = 0

    def insert(self, key: bytes, n: int, low: int, lens, value) -> None:
        """Add a key that stands `n` times, with `low` as its least member and a `value` for its end. A key is added once."""
        at, node = 0, self.root
        self.size += 1
        while True:
            node.n += n
            node.low = low if node.low is None else min(node.low, low)
            if at == len(key):
                node.value = value
                node.lens = lens
                return
            below = node.child(key[at])
            if below is None:
                leaf = Node(key[at:], lens)
                leaf.n, leaf.low, leaf.value = n, low, value
                node.put(leaf)
                return
            same = common(below.label, key, at)
            if same < len(below.label):  # the label is cut in two
                middle = Node(below.label[:same], below.lens)
                middle.n, middle.low = below.n, below.low
                below.label = below.label[same:]
                middle.put(below)
                node.put(middle)
                below = middle
            at += same
            node = below
