"""The prefix-tree join against all pairs, with limits so small that every path is taken."""

import os
import random
from array import array
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ngram_join
from ledgerloom.llm.common import discard, materialize, shuffles_freed, slotted
from ledgerloom.llm.ngram_join import PrefixTree, jaccard_components, op13_ngram_join, prefix_length

DOCS = "doc_id long, text string"


def _shingles(text, n):
    w = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def _plain(rows, n, percent):
    sets = [_shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[top(i)].append(d)
    return sorted((d, len(sets[i]), min(least[top(i)])) for i, (d, _) in enumerate(rows))


def _rows(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(400)
    passage = [word() for _ in range(25)]
    rows = []
    for base in range(8):
        text = [word() for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.choice([1, 2, 6, 14])):  # near copies at every distance around the limit
            copy = list(text)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    hub = [word() for _ in range(100)]
    for i in range(30):  # alike, but seldom linked
        copy = list(hub)
        for _ in range(rng.randrange(2, 5)):
            copy[rng.randrange(100)] = word()
        rows.append(" ".join(copy))
    rows += [" ".join([word() for _ in range(rng.randrange(60))] + passage) for _ in range(25)] + [" ".join(passage)] * 3
    rows += ["A b", "a  B", "a b c", "one", "", None, "Été x y z", "ÉtÉ x y z", " ".join(word() for _ in range(20_000))]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,n,percent,most,trees_of", [(1, 3, 90, 3, 2), (2, 3, 90, 32, 4096), (3, 5, 80, 5, 3), (4, 1, 60, 4, 2)])
def test_equals_all_pairs(spark, seed, n, percent, most, trees_of):
    rows = _rows(seed)
    docs = spark.createDataFrame(rows, DOCS).withColumn("v", F.lit("clash")).withColumn("token", F.lit(1)).repartition(5)
    got = sorted(tuple(r) for r in jaccard_components(docs, n, percent, most, trees_of).collect())
    assert got == _plain(rows, n, percent)


@pytest.mark.parametrize("seed,n,percent,most,trees_of", [(5, 3, 90, 3, 2), (6, 1, 60, 40, 3)])
def test_second_walk_equals_all_pairs(spark, seed, n, percent, most, trees_of):
    rows = _rows(seed)
    got = jaccard_components(spark.createDataFrame(rows, DOCS).repartition(5), n, percent, most, trees_of, nearest=1)
    assert sorted(tuple(r) for r in got.collect()) == _plain(rows, n, percent)


@pytest.mark.parametrize("changes,limits", [(2, {}), (1, {"nearest": 2})])
def test_pairs_of_a_large_group_grow_with_its_size(spark, monkeypatch, changes, limits):
    """Copies that are nearly alike: too unlike to link (2 words changed), or linked (1), where no star finds them first."""
    rng = random.Random(11)
    hub = ["h%d" % i for i in range(150)]
    rows = []
    for d in range(120):
        copy = list(hub)
        for i in rng.sample(range(150), changes):
            copy[i] = "c%d-%d" % (d, i)
        rows.append((d, " ".join(copy)))
    size, write = {}, ngram_join.materialize

    def noted(df, name):
        out = write(df, name)
        size[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialize", noted)
    got = jaccard_components(spark.createDataFrame(rows, DOCS), 3, 90, most=1000, **limits)
    assert sorted(tuple(r) for r in got.collect()) == _plain(rows, 3, 90)
    assert size["join-candidates"] + size.get("join-last-pairs", 0) < 12 * len(rows)  # of 7,140 pairs


@pytest.mark.parametrize("few,kept", [(256, 8), (0, 100)])
def test_unlike_texts_of_a_list_get_no_tree(spark, monkeypatch, few, kept):
    """Texts that share a passage and no more, and four pairs that link: prefixes travel for the pairs only."""
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(100_000)
    passages = [[word() for _ in range(12)] for _ in range(40)]
    rows = [(i, " ".join([word() for _ in range(60)] + passages[i % 40])) for i in range(240)]
    for i in range(4):
        rows.append((1000 + i, rows[i][1] + " " + word()))
    tables, write = {}, ngram_join.materialize

    def noted(df, name):
        out = write(df, name)
        if name in ("join-visits", "join-dealt"):
            tables[name] = out.select("v").distinct().count()
        return out

    monkeypatch.setattr(ngram_join, "materialize", noted)
    got = jaccard_components(spark.createDataFrame(rows, DOCS), 3, 90, most=1000, few=few)  # no star finds the pairs first
    assert sorted(tuple(r) for r in got.collect()) == _plain(rows, 3, 90)
    assert tables["join-visits"] > 100 and (tables["join-dealt"] <= kept if few else tables["join-dealt"] > kept)


def test_slots_keep_all_that_is_wanted_and_little_else(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("tk"))
    got = slotted(rows, "tk", rows.where("id % 100 = 0").select("tk"))
    assert got.columns == ["id", "tk"] and got.where("id % 100 = 0").count() == 200 and got.count() < 220
    assert slotted(rows, "tk", rows.limit(0).select("tk")).count() == 0


def test_shuffles_and_tables_go_when_they_are_read_no_more(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    with shuffles_freed(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == was
    table = materialize(spark.range(10), "gone")
    folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    discard(table)
    assert not os.path.exists(folder)


def test_marks_differ_no_more_than_their_sets():
    rng = np.random.default_rng(5)
    for n in (1, 40, 511, 513, 1020, 1030, 9000, 20_000):
        for other in (max(1, n * 9 // 10), n, n + n // 9):
            pool = np.unique(rng.integers(0, 1 << 62, 2 * n + other))
            a, b = (np.sort(rng.choice(pool[: n + other // 8 + 1], k, replace=False)) for k in (n, min(other, n + other // 8 + 1)))
            bits = [ngram_join.mark_bits(len(x)) for x in (a, b)]
            one, two = (ngram_join.fold(int.from_bytes(ngram_join.mark(x)), k, min(bits)) for x, k in zip((a, b), bits))
            assert (one ^ two).bit_count() <= len(np.setxor1d(a, b))
    assert ngram_join.mark(a) == ngram_join.mark(a[::-1])


def test_empty_repeated_and_nameless_rows(spark):
    assert op13_ngram_join(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(7, "a b c d"), (7, "a b c d"), (3, "A B C D"), (None, "a b c d"), (None, "alone in here"), (9, None), (9, "  ")]
    got = sorted((tuple(r) for r in op13_ngram_join(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert got == sorted([(7, 2, 3), (7, 2, 3), (3, 2, 3), (None, 2, 3), (None, 1, None), (9, 0, 9), (9, 0, 9)], key=repr)


def test_walk_finds_every_link_and_prunes():
    rng = random.Random(9)
    for percent in (60, 90):
        sets = [sorted(rng.sample(range(60), rng.randrange(3, 50))) for _ in range(40)] + [sorted(set(range(40)) - {x}) for x in range(25)]
        k = [prefix_length(len(s), percent) for s in sets]
        found = set()
        for token in range(60):
            tree = PrefixTree(percent)
            for i, s in enumerate(sets):
                if token in s[: k[i]]:
                    at = s.index(token)
                    head = array("q", s[at : k[i]])
                    found |= {(i, j) for j, _ in tree.walk(head, len(s), len(s) - at, i)}
                    tree.insert(head, i, len(s), len(s) - at, i)
        links = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= percent * len(set(sets[i]) | set(sets[j]))}
        meet = sum(1 for i in range(len(sets)) for j in range(i) if set(sets[i][: k[i]]) & set(sets[j][: k[j]]))
        assert links <= found and len(found) < meet
    tree = PrefixTree(90)
    tree.insert(array("q", [1, 2]), 1, 10, 10, 5)
    assert tree.walk(array("q", [1, 2]), 10, 10, 5) == [] and tree.walk(array("q", [1, 2]), 10, 10, 6) == [(1, 2)] and tree.walk(array("q", [1, 2]), 20, 20, 6) == []
