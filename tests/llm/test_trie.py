"""The conversation trie and its radix tree against plain versions; edges of parts."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.prefix_trie import conversation_keys, op11_prefix_trie, prefix_trie
from ledgerloom.llm.radix_tree import Direct, Few, Indexed, RadixTree, common

CONVS = "conv_id long, turn long, role string, text string"


def _plain(rows, group=20, most=4):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turn_id = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16]
            turns[conv].append(((turn is not None, turn or 0), turn_id, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        base = c - (abs(c) % group) * (1 if c > 0 else -1)
        whole = tuple(turns.get(base, [])[:h] + own[h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    out = []
    for node, convs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        kids = {n for n in under if len(n) == len(node) + 1}
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in under if n)
        leaves = sum(1 for n in under if not any(len(m) > len(n) and m[: len(n)] == n for m in under))
        text = ",".join(map(str, sorted(ends[node])))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), leaves, saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def _rows(rng, n):
    rows = []
    for c in [rng.randrange(-60, 400) for _ in range(n)] + [0, 20, 40]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 6])):
            rows.append((c, t + 10 * len(rows), rng.choice(["user", "assistant", None]), rng.choice(["", None, "a b", "a  b c", "x"])))
    return rows


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_equals_a_plain_trie_at_any_cut(spark, block):
    rng = random.Random(block)
    rows = _rows(rng, 60) + [(c, 1, "user", "the same") for c in range(1000, 1100)] + [(None, 1, "user", "nobody"), (7, None, "user", "first"), (8, 5, "u", "w " * 50_000)]
    rows += [(2000, t, "user", f"deep {t}") for t in range(60)] + [(2001, t, "user", f"deep {t}") for t in range(45)] + [(2002, 1, "r", "twice"), (2002, 1, "r", "twice")]
    convs = spark.createDataFrame(rows, CONVS).withColumn("key", F.lit("clash")).withColumn("part", F.lit(1))
    got = prefix_trie(conversation_keys(convs.repartition(5)), block=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _plain(rows)


def test_an_empty_table_has_no_node(spark):
    assert op11_prefix_trie(spark.createDataFrame([], CONVS)).count() == 0
    one = op11_prefix_trie(spark.createDataFrame([(3, None, None, None)], CONVS)).collect()
    assert sorted((r.depth, r.n_convs) for r in one) in ([(0, 1)], [(0, 1), (1, 1)])


def test_layouts_grow_and_keep_every_key():
    for wide, layout in ((3, Few), (5, Few), (20, Indexed), (60, Direct)):
        tree, rng = RadixTree(), random.Random(wide)
        keys = {bytes([rng.randrange(wide)]) + rng.randbytes(rng.randrange(6)) for _ in range(2000)} | {bytes([b]) for b in range(wide)}
        for k in rng.sample(sorted(keys), len(keys)):
            tree.insert(k, k)
        assert isinstance(tree.root.kids, layout) and all(tree.find(k) == k for k in keys) and tree.find(b"\xff\xff\xff\xff\xff\xff\xff\xff") is None
        found, stack = [], [(tree.root, b"")]
        while stack:
            node, path = stack.pop()
            path += node.path
            found += [path] if node.value else []
            stack += [(kid, path) for _, kid in reversed(list(node.items()))]
        assert found == sorted(keys)
    assert common(b"abcd", b"xxabce", 2) == 3 and common(b"", b"a") == 0 and common(b"ab", b"ab") == 2
