"""Conversation prefix trie: adaptive radix trees over fixed-width big-endian turn ids.

1. A turn's id has 20 bytes: 16 of a SHA-256 over its role and text, then the number of its words, big-endian. Texts stay
   where they are; only ids travel. A conversation is the concatenation of its turns' ids, 20 bytes a turn.
2. Conversations are range-partitioned and sorted by (ids, conv_id), so that copies of one conversation spread over as many
   partitions as they fill, and cut into parts of at most ``block`` conversations or 16 MB of ids.
3. Each part grows one radix tree (``radix_tree``) and walks it once. Only byte depths that are whole turns give nodes. In
   the sorted order a subtree is a run of conversations: all of a node's figures are sums over the parts that the run
   touches, given how many turns a part's first ids share with the part before and its last with the part after.
   Nodes inside a part are final; those on the open edges, at most two a turn and part, are added up by name.
4. The conversations that end at a node are hashed as they pass, in ascending order. A run of copies that crosses parts gives
   pieces of text of 8 KB, hashed one after the other in a stream: SHA-256 cannot be split, its memory is constant.

Defined results: a null role or text is empty; rows without conv_id take no part; turns of one number are ordered by
their ids, so that repeated rows are repeated turns; a conversation without turns ends at the root; very long texts are
hashed whole, and a conversation is held in memory at 20 bytes a turn; an empty table gives no node, not even the root; other
columns are ignored. A turn of more than 4,294,967,295 words is beyond what a text can hold.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions
from .radix_tree import Node, RadixTree, common

WIDTH = 20
NOTHING = hashlib.sha256(b"").hexdigest()
PIECE = 8192


def turn_id() -> F.Column:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.concat(F.substring(F.unhex(digest), 1, 16), F.unhex(F.lpad(F.hex(words.cast("long")), 8, "0")))


_KEYS = pa.schema([("conv_id", pa.int64()), ("key", pa.binary())])


def _batch(schema: pa.Schema, *columns: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _rebuild(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (base, others than the base, conv_id, turn): the head of the base comes before those who take it."""
    base = conv = None
    head: list[bytes] = []
    own: list[bytes] = []
    ids: list[int] = []
    keys: list[bytes] = []
    size = 0

    def close() -> None:
        nonlocal head, size
        if conv is None:
            return
        if conv == base:
            head = own[: most - 1]
        h = zlib.crc32(str(conv).encode()) % most
        ids.append(conv)
        keys.append(b"".join(head[:h] + own[h:]))
        size += len(keys[-1])

    for b in batches:
        for g, c, t in zip(*(b.column(i).to_pylist() for i in range(3))):
            if c != conv:
                close()
                if g != base:
                    base, head = g, []
                conv, own = c, []
                if len(ids) >= 8192 or size > 8 << 20:
                    yield _batch(_KEYS, ids, keys)
                    ids, keys, size = [], [], 0
            own.append(t)
    close()
    yield _batch(_KEYS, ids, keys)


def conversation_keys(convs: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """conv_id and key of every rebuilt conversation."""
    conv = F.col("conv_id").cast("long")
    turns = convs.where(conv.isNotNull()).select((conv - conv % group).alias("base"), conv.alias("conv_id"), turn_id().alias("id"), F.col("turn").alias("turn"))
    turns = turns.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "id")
    return turns.select("base", "conv_id", "id").mapInArrow(lambda it: _rebuild(it, most), "conv_id long, key binary")


def _parts(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """The number of its part on each row: this partition's, then which cut of it."""
    first = TaskContext.get().partitionId() << 32
    part, n, size = 0, 0, 0
    for b in batches:
        numbers = []
        for width in pa.compute.binary_length(b.column(1)).to_pylist():
            if n == block or size > 16 << 20:
                part, n, size = part + 1, 0, 0
            n, size = n + 1, size + width
            numbers.append(first + part)
        yield pa.record_batch([pa.array(numbers, pa.int64()), b.column(0), b.column(1)], names=["part", "conv_id", "key"])


_EDGES = pa.schema([("part", pa.int64()), ("left", pa.int32()), ("right", pa.int32()), ("same_left", pa.bool_()), ("same_right", pa.bool_())])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns that a part's first key shares with the key before it (left), its last with the key after it (right); -1: there
    is none. One row a part."""
    rows: list[list] = []
    last = None
    for b in batches:
        for part, first, end in zip(*(b.column(i).to_pylist() for i in range(3))):
            if rows:
                shared, same = common(last, first) // WIDTH, last == first
                rows[-1][2], rows[-1][4] = shared, same
                rows.append([part, shared, -1, same, False])
            else:
                rows.append([part, -1, -1, False, False])
            last = end
    yield _batch(_EDGES, *([r[i] for r in rows] for i in range(5)))


_LONGS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_GROWN = pa.schema([("part", pa.int64()), *((n, pa.int64()) for n in _LONGS), ("ends_sha256", pa.string()), ("node", pa.binary()), ("parent", pa.binary()), ("seq", pa.int64()), ("piece", pa.string())])


def _names(key: bytes, turns: int) -> list[bytes]:
    """A name for each prefix of 0 to ``turns`` turns."""
    h, out = hashlib.blake2b(digest_size=16), []
    for d in range(turns + 1):
        out.append(h.copy().digest())
        h.update(key[d * WIDTH : (d + 1) * WIDTH])
    return out


class _Part:
    """One part: its keys in order with their conversations, then its tree and the rows that it gives."""

    def __init__(self, part: int, left: int, right: int, same_left: bool, same_right: bool):
        self.part, self.left, self.right, self.same = part, left, right, (same_left, same_right)
        self.keys: list[bytes] = []
        self.ids: list[list[int]] = []

    def add(self, conv: int, key: bytes) -> None:
        if self.keys and self.keys[-1] == key:
            self.ids[-1].append(conv)
        else:
            self.keys.append(key)
            self.ids.append([conv])

    def rows(self) -> dict[str, list]:
        first, last = self.keys[0], self.keys[-1]
        early, late = _names(first, max(self.left, 0)) if self.left >= 0 else [], _names(last, self.right) if self.right >= 0 else []
        out: dict[str, list] = {f.name: [] for f in _GROWN}

        def put(**values) -> int:
            for n, column in out.items():
                column.append(values.get(n))
            return len(out["part"]) - 1

        tree = RadixTree()
        for i, (key, ids) in enumerate(zip(self.keys, self.ids)):
            text = ",".join(map(str, ids))
            ends = None
            begun, goes_on = i == 0 and self.same[0], i == len(self.keys) - 1 and self.same[1]  # in other parts
            if begun or goes_on:
                name = early[-1] if begun else late[-1]
                text = "," + text if begun else text
                for seq, lo in enumerate(range(0, len(text), PIECE)):
                    put(part=self.part, node=name, seq=seq, piece=text[lo : lo + PIECE])
            else:
                ends = hashlib.sha256(text.encode()).hexdigest()
            tree.insert(key, (len(ids), ids[0], ends))

        # depth-first; a frame: node, byte depth, bytes shared with the first and the last key, children to come, sums so far
        def frame(node: Node, above: int, f: int, g: int) -> list:
            end = above + len(node.path)
            f = above + common(node.path, first, above) if f == above else f
            g = above + common(node.path, last, above) if g == above else g
            n, least, ends = node.value or (0, None, None)
            return [node, above, end, f, g, node.items(), [n, least, 0, 0, 0, []], ends]

        stack = [frame(tree.root, 0, 0, 0)]
        while stack:
            node, above, end, f, g, kids, total, ends = stack[-1]
            kid = next(kids, None)
            if kid is not None:
                stack.append(frame(kid[1], end, f, g))
                continue
            stack.pop()
            path = node.path
            highest = 0 if node is tree.root else above // WIDTH + 1
            for d in range(end // WIDTH, highest - 1, -1):  # whole turns on this path, from below
                at = d * WIDTH
                opened, closed = not (at <= f and d <= self.left), not (at <= g and d <= self.right)
                n, least, children, leaves, saved, rows = total
                words = int.from_bytes(path[at - above - 4 : at - above], "big") if d else 0
                leaves += 1 if closed and not rows else 0
                saved += words * (n - (1 if opened else 0))
                name = None if opened and closed else early[d] if not opened else late[d]
                for r in rows:
                    out["parent_conv_id"][r], out["parent"][r] = least, name
                here = ends if at == end and node.value else NOTHING
                row = put(part=self.part, conv_id=least, depth=d, n_convs=n, n_children=children, n_leaves=leaves, saved_tokens=saved, ends_sha256=here, node=name)
                if name is not None and here == NOTHING:
                    out["ends_sha256"][row] = None
                total = [n, least, 1 if opened else 0, leaves, saved, [row]]
            if stack:
                into = stack[-1][6]
                into[0] += total[0]
                into[1] = total[1] if into[1] is None or total[1] < into[1] else into[1]
                for i in (2, 3, 4):
                    into[i] += total[i]
                into[5] += total[5]
        return out


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Part | None = None

    def give() -> Iterator[pa.RecordBatch]:
        yield _batch(_GROWN, *now.rows().values())

    for b in batches:
        for part, left, right, same_left, same_right, conv, key in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or now.part != part:
                if now is not None:
                    yield from give()
                now = _Part(part, left, right, same_left, same_right)
            now.add(conv, key)
    if now is not None:
        yield from give()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which come in order."""
    node, h = None, None
    names: list[bytes] = []
    ends: list[str] = []
    for b in batches:
        for name, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if name != node:
                if h is not None:
                    names.append(node)
                    ends.append(h.hexdigest())
                node, h = name, hashlib.sha256()
            h.update(piece.encode())
    if h is not None:
        names.append(node)
        ends.append(h.hexdigest())
    yield pa.record_batch([pa.array(names, pa.binary()), pa.array(ends, pa.string())], names=["node", "whole"])


def prefix_trie(keys: DataFrame, block: int = 32768) -> DataFrame:
    """The nodes of all keys. keys: conv_id long, key binary (whole turn ids); ``block``: most conversations of one tree."""
    keys = materialize(keys, "trie-keys")
    ordered = keys.repartitionByRange(shuffle_partitions(keys.sparkSession), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = materialize(ordered.mapInArrow(lambda it: _parts(it, block), "part long, conv_id long, key binary"), "trie-parts")
    ends = parts.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    edges = ends.repartition(1).sortWithinPartitions("part").mapInArrow(_edges, "part long, left int, right int, same_left boolean, same_right boolean")
    held = parts.join(edges, "part").select("part", "left", "right", "same_left", "same_right", "conv_id", "key")
    held = held.repartition("part").sortWithinPartitions("part", "key", "conv_id")
    types = "part long, " + ", ".join(f"{n} long" for n in _LONGS) + ", ends_sha256 string, node binary, parent binary, seq long, piece string"
    grown = materialize(held.mapInArrow(_grow, types), "trie-nodes")

    pieces = grown.where("piece is not null").repartition("node").sortWithinPartitions("node", "part", "seq").select("node", "piece")
    whole = pieces.mapInArrow(_finish, "node binary, whole string")
    nodes = grown.where("piece is null")
    edge = nodes.where("node is not null")
    total = edge.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), *(F.sum(c).alias(c) for c in _LONGS[3:]), F.max("ends_sha256").alias("ends"),
    ).join(whole, "node", "left")
    total = materialize(total.withColumn("ends_sha256", F.coalesce("whole", "ends", F.lit(NOTHING))), "trie-edge")
    known = total.select(F.col("node").alias("parent"), F.col("conv_id").alias("up"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    outer = total.join(known, "parent", "left").withColumn("parent_conv_id", F.col("up")).select(columns)
    above = edge.select("part", F.col("node").alias("parent")).distinct().join(known, "parent")  # by part, so that the root's children stay spread
    inner = nodes.where("node is null").join(above, ["part", "parent"], "left").withColumn("parent_conv_id", F.coalesce("up", "parent_conv_id")).select(columns)
    return outer.union(inner)


def op11_prefix_trie(convs: DataFrame) -> DataFrame:
    return prefix_trie(conversation_keys(convs))
