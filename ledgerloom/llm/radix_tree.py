"""An adaptive radix tree over byte strings: four node layouts that grow with their children, and compressed paths."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Few:
    """Sorted branching bytes beside their children; room for 4, then for 16."""

    __slots__ = ("room", "bytes", "kids")

    def __init__(self, room: int = 4):
        self.room, self.bytes, self.kids = room, bytearray(), []

    def find(self, b: int) -> Node | None:
        i = self.bytes.find(b)
        return self.kids[i] if i >= 0 else None

    def put(self, b: int, kid: Node) -> Few | Indexed:
        i = bisect_left(self.bytes, b)
        if i < len(self.bytes) and self.bytes[i] == b:
            self.kids[i] = kid
            return self
        if len(self.kids) == self.room:
            wider = Few(16) if self.room == 4 else Indexed()
            for x, y in self.items():
                wider.put(x, y)
            return wider.put(b, kid)
        self.bytes.insert(i, b)
        self.kids.insert(i, kid)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.kids)


class Indexed:
    """A slot number for each of the 256 bytes, and up to 48 children."""

    __slots__ = ("slot", "kids")

    def __init__(self):
        self.slot, self.kids = bytearray(256), []

    def find(self, b: int) -> Node | None:
        i = self.slot[b]
        return self.kids[i - 1] if i else None

    def put(self, b: int, kid: Node) -> Indexed | Direct:
        if self.slot[b]:
            self.kids[self.slot[b] - 1] = kid
            return self
        if len(self.kids) == 48:
            wider = Direct()
            for x, y in self.items():
                wider.put(x, y)
            return wider.put(b, kid)
        self.kids.append(kid)
        self.slot[b] = len(self.kids)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.kids[i - 1]) for b, i in enumerate(self.slot) if i)


class Direct:
    """One place for each of the 256 bytes."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids: list[Node | None] = [None] * 256

    def find(self, b: int) -> Node | None:
        return self.kids[b]

    def put(self, b: int, kid: Node) -> Direct:
        self.kids[b] = kid
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, k) for b, k in enumerate(self.kids) if k is not None)


class Node:
    """``path``: the bytes from the parent's end to this node's end, branching byte first. ``value``: of the key ending here."""

    __slots__ = ("path", "kids", "value")

    def __init__(self, path: bytes, value: object = None):
        self.path, self.kids, self.value = path, None, value

    def add(self, kid: Node) -> None:
        self.kids = (self.kids or Few()).put(kid.path[0], kid)

    def items(self) -> Iterator[tuple[int, Node]]:
        return self.kids.items() if self.kids else iter(())


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the longest prefix that ``a`` shares with ``b[at:]``."""
    if b.startswith(a, at):
        return len(a)
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if b.startswith(a[lo:mid], at + lo):
            lo = mid
        else:
            hi = mid - 1
    return lo


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value: object) -> None:
        node, at, above = self.root, 0, None
        while True:
            n = common(node.path, key, at)
            if n < len(node.path):  # the compressed path is cut where the key leaves it
                upper = Node(node.path[:n])
                node.path = node.path[n:]
                upper.add(node)
                above.add(upper)
                node = upper
            at += n
            if at == len(key):
                node.value = value
                return
            kid = node.kids.find(key[at]) if node.kids else None
            if kid is None:
                node.add(Node(key[at:], value))
                return
            above, node = node, kid

    def find(self, key: bytes) -> object:
        node, at = self.root, 0
        while node is not None and key.startswith(node.path, at):
            at += len(node.path)
            if at == len(key):
                return node.value
            node = node.kids.find(key[at]) if node.kids else None
        return None
