"""Confirmation of candidate links on the full shingle sets, without a hub's text on each of its pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, materialize
from .near_dedup import shingle_sets

PAIRS_A_TASK = 1024


def _check(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The text of ``a`` comes before those of its partners."""
    hub = None
    for rows in batches:
        one, two = [], []
        for a, b, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), column_bytes(rows.column(2))):
            tokens = shingle_sets([text], n)[1]
            if b is None:
                hub = tokens
                continue
            both = len(np.intersect1d(hub, tokens, assume_unique=True))
            if 100 * both >= percent * (len(hub) + len(tokens) - both):
                one.append(a)
                two.append(b)
        yield pa.record_batch([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["a", "b"])


def confirm_links(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], n: int, percent: int, name: str) -> DataFrame:
    """The distinct pairs (a, b) whose sets of ``n``-word shingles have 100 * intersection >= percent * union. texts: from ids v
    to rows (v, text). A hub's partners are dealt over tasks of about 1,024, and its text goes once to each of these."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_TASK).cast("int").alias("salts"))
    ends = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    needed = materialize(texts(ends), f"{name}-texts")
    hubs = salts.join(needed, salts["a"] == needed["v"]).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    partners = pairs.join(salts, "a").join(needed, F.col("b") == F.col("v")).select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "text")
    rows = hubs.union(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").isNotNull(), "b").select("a", "b", "text")
    return materialize(rows.mapInArrow(lambda it: _check(it, n, percent), "a long, b long"), name)
