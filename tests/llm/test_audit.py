"""The source audit and its transducer against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.source_audit import divergence, op12_source_audit
from ledgerloom.llm.transducer import Transducer

DOCS = "doc_id long, text string, lang string, source string"


def _plain(rows, least=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        frequency, count = Counter(), defaultdict(Counter)
        for one, source, terms in docs:
            if one == lang:
                frequency.update(set(terms))
                count[source].update(terms)
        kept = sorted((t for t, n in frequency.items() if n >= least), key=str.encode)
        whole = Counter()
        for c in count.values():
            whole.update(c)
        scale = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: scale(c) for s, c in count.items()}, scale(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in count if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, rows_, most in (("pair", pair, None), ("term", term, top)):
                rows_.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(rows_[:most])]
    return sorted(out)


def _rows():
    rng = random.Random(5)
    words = [w for w in "stein Fluss river été ÉTÉ naïve 水 水曜 a ab abc abd b ba zz Zz don't x1y2 ſharp".split()] + [chr(0x1F600 + i) for i in range(5)] + ["t%s" % chr(97 + i) * 3 for i in range(26)]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "7", "\x7f"]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", None])) for i in range(120)]
    rows += [(500 + i, "the hot hot passage", "en", "hot") for i in range(80)]  # a third of all rows in one group
    rows += [(900, None, "en", "void"), (901, "", "xx", "a"), (902, "1 2 3", "xx", "b"), (903, "only once", "yy", "a"), (None, "river", "de", "s1"), (905, "q" * 70_000 + " hot" * 50_000, "en", "s1"), (905, "repeated", "en", "s1"), (905, "repeated", "en", "s1")]
    return rows


@pytest.mark.parametrize("block,top", [(1, 3), (4, 200), (65536, 200)])
def test_equals_a_plain_audit_at_any_block(spark, block, top):
    rows = _rows()
    docs = spark.createDataFrame(rows, DOCS).withColumn("block", F.lit("clash")).withColumn("n", F.lit(1)).repartition(6)
    got = sorted((r.lang, r.source, r.part, r.item, r["value"], r["rank"]) for r in divergence(docs, block=block, top=top).collect())
    assert got == _plain(rows, top=top)


def test_empty_tables_and_groups_without_terms(spark):
    assert op12_source_audit(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None, None, None), (2, "a", "en", "x"), (3, "b", "en", "y")]
    got = op12_source_audit(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.lang, r.source, r.item, r["value"], r["rank"]) for r in got) == [("en", "x", "y", 0, 1), ("en", "y", "x", 0, 1)]


def test_transducer_orders_merges_and_leads_back():
    rng = random.Random(2)
    terms = sorted({bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.randrange(1, 9))) for _ in range(3000)} | {b"z" * 5000})
    t = Transducer.loads(Transducer.build(terms).dumps())
    asked = terms + [x + b"~" for x in terms[:50]] + [b"", b"zz"]
    rng.shuffle(asked)
    place = {x: i for i, x in enumerate(terms)}
    assert t.ordinals(b" ".join(asked)).tolist() == [place.get(x, -1) for x in asked]
    assert [t.term(i) for i in range(len(terms))] == terms and t.size == len(terms)
    regular = Transducer.build(sorted(a + b for a in (b"un", b"re", b"") for b in (b"do", b"doing", b"done", b"tie", b"tied")))
    assert len(regular.final) < 20 and regular.size == 15  # endings are shared
    assert Transducer.build([]).ordinals(b"a b").tolist() == [-1, -1]
    with pytest.raises(ValueError):
        Transducer.build([b"b", b"a"])
    assert np.array_equal(Transducer.build([b"a"]).ordinals(b"a"), [0])
