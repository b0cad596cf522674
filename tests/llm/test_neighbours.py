import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.neighbours import with_neighbours


@pytest.mark.parametrize("n,circular", [(0, True), (1, True), (1, False), (2, True), (3, False), (300, True), (301, False)])
def test_borders_are_closed_level_by_level(spark, n, circular):
    keys = random.Random(n).sample(range(10_000), n)
    table = spark.createDataFrame([(k,) for k in keys], "k long").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        f = lambda row, before, after: {"k": row["k"], "b": (before or {}).get("k"), "a": (after or {}).get("k")}
        got = with_neighbours(table, [F.col("k").desc()], lambda r: {"k": r["k"]}, f, "k long, b long, a long", circular, fan=3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    order = sorted(keys, reverse=True)
    want = {k: (order[i - 1] if i else None, order[i + 1] if i + 1 < n else (order[0] if circular else None)) for i, k in enumerate(order)}
    assert {r.k: (r.b, r.a) for r in got} == want and len(got) == n
