"""Exact top-k inner products with a pivot-distance index.

Vectors are keyed by their nearest pivot and the distance to it, and sorted by that key; blocks of consecutive
vectors are annuli around a pivot, each with its least and greatest distance to every pivot. Inner products become
distances by one more coordinate that gives all candidates one norm: |q-x|^2 = |q|^2 + M - 2 q.x. Queries are sorted by
the same key and travel in blocks of one pivot, so that a pair of blocks is one matrix product.

The search expands in rounds. The first visits the annulus of a block's own pivot that is nearest to its key; its k-th
best distance r bounds what follows. Each later round visits the nearest annuli that the triangle inequality leaves
(those whose distances to each pivot p meet [d(q,p)-r, d(q,p)+r]), with r as the rounds before left it, and the last one
visits all that are left. Which pairs of blocks to visit is settled on distances alone; vectors travel for those pairs
only, and an annulus that many query blocks visit is dealt out by salt. ``search`` also gives the pairs visited.

Equal vectors are stored once with their k+1 smallest ids (enough, as ties go to smaller ids and a query leaves out only
itself), so a vector that a third of the rows share is no larger than another. Pivots are a sample of ``pivots``
vectors, a fixed bound; every vector is indexed and the result does not depend on them. Vectors without clusters (such
as random directions in many dimensions) leave the triangle inequality nothing to prune; all pairs are visited then.

Defined results: vectors that are null or empty, or hold null or non-finite components, take no part, nor do rows with
null ids; vectors of another length than most meet only their like (one plan a length: an embedding table has few).
Repeated rows count once per id. Fewer than k candidates give all of them; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shuffle_partitions


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * x) of every component, as long; unusable rows are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    usable = (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.col("vec_id").isNotNull()
    return df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v")).where(usable).select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.int64)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if bound < 2**52 else a @ b.T


def _key(pivots: np.ndarray, norm: float):
    def distances(v: np.ndarray, query: bool) -> np.ndarray:
        own = (v.astype(np.float64) ** 2).sum(axis=1)
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(norm - own, 0))
        p = pivots.astype(np.float64)
        p_own = (p**2).sum(axis=1)
        p_extra = np.sqrt(np.maximum(norm - p_own, 0))
        d2 = own[:, None] + p_own[None, :] - 2 * v.astype(np.float64) @ p.T + (extra[:, None] - p_extra[None, :]) ** 2
        return np.sqrt(np.maximum(d2, 0))

    return distances


def _best(ids: list[int], queries: np.ndarray, known: list[list[int]], score: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """The k best of one pair of blocks for each query, leaving out the query itself."""
    kth = np.partition(score, -min(k + 1, score.shape[1]), axis=1)[:, -min(k + 1, score.shape[1])]
    for i, q in enumerate(ids):
        at = np.flatnonzero(score[i] >= kth[i])
        rows = sorted((-int(score[i, j]), x) for j in at.tolist() for x in known[j] if x != q)
        for s, x in rows[:k]:
            yield q, x, -s


PAIRS_A_TASK = 64  # query blocks that one copy of an annulus serves


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, **index: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query (vec_id, v) with all vectors but its own row's."""
    out = None
    for size in [r[0] for r in vectors.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]:
        found, _ = search(vectors.where(F.size("v") == size), queries.where(F.size("v") == size), k, **index)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def _narrow(v: np.ndarray) -> tuple[str, bytes]:
    kind = next(t for t in ("<i2", "<i4", "<i8") if not v.size or (v.min() >= np.iinfo(t).min and v.max() <= np.iinfo(t).max))
    return kind, v.astype(kind).tobytes()


_ANNULI = pa.schema([("annulus", pa.string()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("lows", pa.list_(pa.float64())), ("highs", pa.list_(pa.float64())), ("kind", pa.string()), ("data", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64())))])
_BLOCKS = pa.schema([("qblock", pa.string()), ("own", pa.int32()), ("q", pa.list_(pa.int64())), ("qkind", pa.string()), ("qdata", pa.binary()), ("qd", pa.binary()), ("nears", pa.list_(pa.float64())), ("fars", pa.list_(pa.float64()))])


def _in_blocks(batches: Iterator[pa.RecordBatch], size: int, schema: pa.Schema, make: Callable[[list[dict]], dict]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one pivot, at most ``size`` of them, as one row each."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and (held[0]["pivot"] != row["pivot"] or len(held) == size):
                yield pa.RecordBatch.from_pylist([make(held)], schema=schema)
                held = []
            held.append(row)
    if held:
        yield pa.RecordBatch.from_pylist([make(held)], schema=schema)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 32, block: int = 1024, query_block: int = 256, expand: tuple[int | None, ...] = (1, 4, None)) -> tuple[DataFrame, DataFrame]:
    """The result of ``top_k`` for vectors of one length, and the pairs (qblock, annulus) that were visited."""
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    pairs = vectors.select("vec_id", "v").distinct()
    ranked = pairs.groupBy("v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    once = ranked.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    once = materialize(once, "vectors")
    norm = float(once.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()[0] or 0)
    chosen = np.array([r[0] for r in once.select("v").orderBy(F.xxhash64("v")).limit(pivots).collect()], dtype=np.int64)
    distances = _key(chosen, norm)
    width = chosen.shape[1] if len(chosen) else 0

    def keyed(query: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    d = distances(_matrix(b.column(0)), query)
                    p = d.argmin(axis=1)
                    yield pa.record_batch([b.column(0), b.column(1), pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p])], names=["v", "ids", "pivot", "d"])

        return run

    def sorted_by_key(df: DataFrame, query: bool) -> DataFrame:
        order = ["pivot", "d", F.xxhash64("v"), "ids"]
        return df.mapInArrow(keyed(query), "v array<long>, ids array<long>, pivot int, d double").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def annulus(rows: list[dict]) -> dict:
        v = np.array([x["v"] for x in rows], dtype=np.int64)
        d, (kind, data) = distances(v, False), _narrow(v)
        name = f"{rows[0]['pivot']}:{rows[0]['d']!r}:{rows[0]['ids'][0]}"
        return {"annulus": name, "pivot": rows[0]["pivot"], "low": rows[0]["d"], "high": rows[-1]["d"], "lows": d.min(axis=0), "highs": d.max(axis=0), "kind": kind, "data": data, "ids": [x["ids"] for x in rows]}

    def query_rows(rows: list[dict]) -> dict:
        v = np.array([x["v"] for x in rows], dtype=np.int64)
        d, (kind, data), ids = distances(v, True), _narrow(v), [x["ids"][0] for x in rows]
        return {"qblock": f"{rows[0]['pivot']}:{rows[0]['d']!r}:{ids[0]}", "own": rows[0]["pivot"], "q": ids, "qkind": kind, "qdata": data, "qd": d.tobytes(), "nears": d.min(axis=0), "fars": d.max(axis=0)}

    index = sorted_by_key(once.select("v", "ids"), False).mapInArrow(lambda it: _in_blocks(it, block, _ANNULI, annulus), "annulus string, pivot int, low double, high double, lows array<double>, highs array<double>, kind string, data binary, ids array<array<long>>")
    index = materialize(index, "annuli")
    asked = sorted_by_key(queries.select("v", F.array("vec_id").alias("ids")).distinct(), True).mapInArrow(lambda it: _in_blocks(it, query_block, _BLOCKS, query_rows), "qblock string, own int, q array<long>, qkind string, qdata binary, qd binary, nears array<double>, fars array<double>")
    asked = materialize(asked, "queries")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = len(r["q"])
                d, reach = np.frombuffer(r["qd"], np.float64).reshape(n, -1), np.array(r["reach"])[:, None]
                at = np.flatnonzero(((d - reach <= np.array(r["highs"])) & (d + reach >= np.array(r["lows"]))).all(axis=1))
                if len(at):
                    q = np.frombuffer(r["qdata"], r["qkind"]).reshape(n, width)[at].astype(np.int64)
                    x = np.frombuffer(r["data"], r["kind"]).reshape(-1, width).astype(np.int64)
                    rows = list(_best([r["q"][i] for i in at.tolist()], q, r["ids"], _exact(q, x), k))
                    if rows:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["query_id", "vec_id", "score"])

    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                q = np.frombuffer(r["qdata"], r["qkind"]).reshape(-1, width).astype(np.float64)
                kth = np.array([np.nan if x is None else float(x) for x in r["kths"]])
                d = np.sqrt(np.maximum((q**2).sum(axis=1) + norm - 2 * kth, 0)) * (1 + 1e-9) + 1e-6
                rows.append(np.where(np.isnan(d), np.inf, d).tolist())
            yield pa.record_batch([b.column("qblock"), pa.array(rows, pa.list_(pa.float64())), pa.array([max(x) for x in rows], pa.float64())], names=["qblock", "reach", "widest"])

    gaps = lambda x, y: F.zip_with(x, y, lambda a, c: a - c)
    least = F.array_max(F.zip_with(gaps("nears", "highs"), gaps("lows", "fars"), lambda a, c: F.greatest(a, c)))  # no pair is nearer
    tops = visited = None
    for take in expand:
        if tops is None:
            bound = asked.select("qblock", F.transform("q", lambda x: F.lit(float("inf"))).alias("reach"), F.lit(float("inf")).alias("widest"))
        else:
            kth = tops.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))  # none: fewer than k found so far
            each = asked.select("qblock", F.posexplode("q").alias("i", "query_id")).join(kth, "query_id", "left")
            kths = each.groupBy("qblock").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "kth"))), lambda x: x["kth"]).alias("kths"))
            bound = asked.select("qblock", "qkind", "qdata").join(kths, "qblock").mapInArrow(reaches, "qblock string, reach array<double>, widest double")
        bound = materialize(bound, "bounds")
        sides = asked.select("qblock", "own", "nears", "fars").join(bound.select("qblock", "widest"), "qblock").select("*", F.posexplode("nears").alias("p", "near"))
        meets = (F.col("p") == F.col("pivot")) & (F.col("near") - F.col("widest") <= F.col("high")) & (F.col("fars")[F.col("p")] + F.col("widest") >= F.col("low"))
        near = sides if visited is not None else sides.where("p = own")
        near = near.join(index.select("annulus", "pivot", "low", "high", "lows", "highs"), meets).withColumn("least", least).where("least <= widest")
        if visited is not None:
            near = near.join(visited, ["qblock", "annulus"], "left_anti")
        if take is not None:
            away = F.abs(F.col("low") + F.col("high") - F.col("near") - F.col("fars")[F.col("p")])
            near = near.withColumn("n", F.row_number().over(Window.partitionBy("qblock").orderBy("least", away, "annulus"))).where(F.col("n") <= take)
        todo = near.groupBy("annulus", "qblock").agg(F.first("own").alias("own"))
        copies = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("annulus")) / PAIRS_A_TASK).cast("int")
        todo = todo.select("annulus", "qblock", copies.alias("copies")).withColumn("salt", F.pmod(F.xxhash64("qblock"), F.col("copies")).cast("int"))
        todo = materialize(todo, "pairs")
        data = index.join(todo.select("annulus", "salt").distinct(), "annulus").select("annulus", "salt", "lows", "highs", "kind", "data", "ids")
        visits = todo.select("annulus", "salt", "qblock").join(asked.select("qblock", "q", "qkind", "qdata", "qd"), "qblock").join(bound.select("qblock", "reach"), "qblock")
        found = visits.join(data, ["annulus", "salt"]).mapInArrow(scores, "query_id long, vec_id long, score long")
        if tops is not None:
            found = found.unionByName(tops.drop("rank"))
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        tops = found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
        tops = materialize(tops, "tops")
        seen = todo.select("qblock", "annulus")
        visited = seen if visited is None else visited.unionByName(seen)
    return tops, visited


def op10_top_k(embeddings: DataFrame) -> DataFrame:
    vectors = materialize(integer_vectors(embeddings), "integers")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))
