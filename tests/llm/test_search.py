import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize
from ledgerloom.llm.vector_search import integer_vectors, op10_top_k, search, top_k


def _exact(w, ids, k):
    """query -> [(vec_id, score)] by brute force; ids may repeat vectors."""
    out = {}
    for q in {i for i in ids if i % 50 == 0}:
        own = w[ids.index(q)]
        found = sorted({(-int(own @ w[j]), i) for j, i in enumerate(ids) if i != q})
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def _rows(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_clusters_are_pruned(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(24, 16))
    v = centres[rng.integers(0, 24, 3000)] + rng.normal(size=(3000, 16)) * 0.02
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    vectors = materialize(integer_vectors(table), "integers")
    best, visited = search(vectors, vectors.where("vec_id % 50 = 0"), 5, block=64, query_block=16)
    assert _rows(best) == _exact(np.floor(256 * v).astype(np.int64), list(range(3000)), 5)
    pairs = visited.toPandas()
    assert not pairs.duplicated().any()
    share = len(pairs) / (pairs.qblock.nunique() * (3000 / 64))
    assert share < 0.5, share


def test_ties_lengths_and_few(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (7, [-1.0, 0.5]), (100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 3.0]), (150, []), (None, [1.0, 0.0]), (200, None), (250, [1.0, None])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "v": F.lit("clash")})
    got = _rows(op10_top_k(table))
    assert got == {0: [(3, 65536), (50, 65536), (7, -65536)], 50: [(0, 65536), (3, 65536), (7, -65536)], 100: [(101, 14 * 65536)]}
    assert op10_top_k(table.where("false")).count() == 0


@pytest.mark.parametrize("k", [1, 9])
def test_many_copies(spark, k):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8))
    v[100:300] = v[100]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    vectors = materialize(integer_vectors(table), "integers")
    best = top_k(vectors, vectors.where("vec_id % 50 = 0"), k, block=32, query_block=4)
    assert _rows(best) == _exact(np.floor(256 * v).astype(np.int64), list(range(400)), k)
