import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ledgerloom.llm.packing import best_values, cutting_stock, fill, pack_documents, plan, tokenize

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_knapsacks():
    rng = random.Random(2)
    for _ in range(40):
        sizes = sorted(rng.sample(range(1, 30), 6))
        number, cap = {x: rng.randint(1, 3) for x in sizes}, rng.randint(5, 60)
        sums = {0}
        for x, n in number.items():
            sums |= {s + x * j for s in sums for j in range(n + 1) if s + x * j <= cap}
        chosen = fill(number, cap)
        assert sum(chosen) == max(sums) and all(chosen.count(x) <= n for x, n in number.items())
        worth = np.array([rng.random() for _ in sizes])
        plain = [0.0] * (cap + 1)
        for c in range(1, cap + 1):
            plain[c] = max([plain[c - 1], *(plain[c - x] + w for x, w in zip(sizes, worth) if x <= c)])
        assert np.allclose(best_values(np.array(sizes), worth, cap)[0], plain)


@pytest.mark.parametrize("demand,capacity,optimum", [({45: 97, 36: 610, 31: 395, 14: 211}, 100, 452.25), ({7: 10, 5: 10, 3: 1}, 10, 15.0)])
def test_linear_program(demand, capacity, optimum):
    solution, gap = cutting_stock(demand, capacity, gap=1e-9)
    assert abs(sum(x for _, x in solution) - optimum) < 1e-4 and gap < 1e-3
    for length, n in demand.items():
        assert abs(sum(p.get(length, 0) * x for p, x in solution) - n) < 1e-6
    assert all(sum(x * n for x, n in p.items()) <= capacity for p, _ in solution)


@pytest.mark.parametrize("docs,seed", [(9994, 1), (256_000, 2)])
def test_patterns_deal_nearly_all(docs, seed):
    rng = np.random.default_rng(seed)
    lengths, counts = np.unique(np.clip(np.exp(rng.normal(5.9, 0.8, docs)).astype(int) % 1024, 1, 1023), return_counts=True)
    demand = {int(x): int(n) for x, n in zip(lengths, counts)}
    ranges, dealt, sequences = plan(demand, 1024)
    assert sum(dealt.values()) > 0.95 * docs and len(ranges) < 10_000
    filled, taken = defaultdict(int), defaultdict(int)
    for length, low, high, times, first, offset, step in ranges:
        assert (high - low) % times == 0 and low == taken[length]
        taken[length] = high
        filled[first, times] += (high - low) // times * length
    assert all(x == 1024 for x in filled.values()) and sum(t for _, t in filled) == sequences and dict(taken) == {x: n for x, n in dealt.items() if n}


def _check(rows, texts):
    """Pieces cut every document gaplessly, carry its ids, and fill their sequences gaplessly."""
    want = [np.frombuffer(tokenize(t, PATH, public_tokenizers.PATTERN), "<u4").tolist() + [0] for _, t in texts]
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    made = defaultdict(list)
    for (doc, _), ids in zip(texts, want):
        made[doc].append(ids)
    for doc, lists in made.items():
        if len(lists) > 1 and len(set(map(len, lists))) > 1:
            continue  # ids of one document that differ can't be told apart by place
        for r in pieces[doc]:
            assert r.doc_tokens == len(lists[0]) and any(r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], dtype="<u4").tobytes()) for x in lists)
        assert sum(r.length for r in pieces[doc]) == sum(map(len, lists))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0 and at < 1024


def test_placement(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "x9", "Ünder", "-", "delta"]) for _ in range(rng.choice([0, 1, 5, 90, 400, 900])))) for i in range(300)]
    texts += [(300, None), (301, ""), (302, "y" * 9000 + " z"), (303, "<|endoftext|> in text"), (7, texts[7][1]), (7, texts[7][1])]
    table = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, sequence_id string")
    rows = pack_documents(table.repartition(5), PATH, public_tokenizers.PATTERN).collect()
    _check(rows, texts)
    assert pack_documents(table.where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_whole_tokenizer_agrees():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    for text in ["it's  \n\n\t x　 y 1²3½ ٣٤ é \U0001F600‍", "  lead", "trail  ", "\n" * 50 + "x", "a<|endoftext|>b", "x" * 5000, "\x00\x7f", "w" + " " * 400_000 + "y"]:
        assert np.frombuffer(tokenize(text, PATH, public_tokenizers.PATTERN), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
