"""Rows beside each other in a total order, without gathering a key: range partitions and their edges.

Rows are range-partitioned and sorted; a task sees neighbours inside its partition. A partition's first and last rows
also need the row across the border: they are set aside, at most two a partition. Edges are rows in an order as well, so
they are closed the same way, ``fan`` to a task, level by level, until one task can close the last of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

EDGE = "__pid int, __pos int, __item binary"
OPEN = "open"  # a neighbour that is not known yet; None: there is none


def with_neighbours(df: DataFrame, order: list, context: Callable[[dict], dict], f: Callable[[dict, dict | None, dict | None], dict], fields: str, circular: bool = False, fan: int = 1000) -> DataFrame:
    """``f(row, before, after)`` for every row of ``df`` in ``order``; ``before`` and ``after`` are ``context(row)`` of the
    rows beside it, None at the ends (with ``circular``, the row after the last is the first). ``fields``: the DDL of what f gives.
    Results are written to the shared folder while the edges are closed."""
    names = [x.split()[0] for x in fields.split(", ")]
    spark = df.sparkSession

    def close(items: Iterator[tuple], last: bool) -> Iterator[dict]:
        """Results of items (row, before, after) in order, and the items that stay open. last: these are all there are."""
        pid, n = TaskContext.get().partitionId(), 0
        blank = dict.fromkeys([*names, "__pid", "__pos", "__item"])
        held = first = None
        for row, before, after in items:
            here = context(row)
            if held is not None:
                one, two, three = held
                yield from done(blank, pid, n - 1, one, two, here if three == OPEN else three)
                before = context(one) if before == OPEN else before
            elif last:
                first = here
                before = None if before == OPEN else before
            held, n = (row, before, after), n + 1
        if held is not None:
            one, two, three = held
            if last and three == OPEN:
                three = first if circular else None
            yield from done(blank, pid, n - 1, one, two, three)

    def done(blank: dict, pid: int, pos: int, row: dict, before, after) -> Iterator[dict]:
        if before == OPEN or after == OPEN:
            yield blank | {"__pid": pid, "__pos": pos, "__item": pickle.dumps((row, before, after))}
        else:
            yield blank | f(row, before, after)

    def batched(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for row in rows:
            out.append(row)
            if len(out) >= 500:
                yield _batch(out, fields)
                out = []
        if out:
            yield _batch(out, fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(close(((row, OPEN, OPEN) for b in batches for row in b.to_pylist()), False))

    def edges(last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from batched(close((pickle.loads(e) for b in batches for e in b.column(0).to_pylist()), last))

        return run

    schema = f"{fields}, {EDGE}"
    level = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    level = materialize(level.mapInArrow(rows, schema), "neighbours")
    out = level.where("__pid is null").select(*names)
    while (left := level.where("__pid is not null")).count() > 2 * fan:
        parts = left.select("__pid", "__pos", "__item").repartitionByRange(max(1, left.count() // fan), "__pid", "__pos").sortWithinPartitions("__pid", "__pos")
        level = materialize(parts.select("__item").mapInArrow(edges(False), schema), "edges")
        out = out.unionByName(level.where("__pid is null").select(*names))
    left = left.select("__pid", "__pos", "__item").repartition(1).sortWithinPartitions("__pid", "__pos")
    return out.unionByName(left.select("__item").mapInArrow(edges(True), schema).select(*names))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[dict], fields: str) -> pa.RecordBatch:
    kinds = [x.split() for x in f"{fields}, {EDGE}".split(", ")]
    return pa.record_batch([pa.array([r[n] for r in rows], _ARROW[t]) for n, t in kinds], names=[n for n, _ in kinds])
