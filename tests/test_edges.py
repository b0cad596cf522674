"""Edges of jurisdictions by names and by keys."""

from ledgerloom.operators import declared


def test_edges_by_keys_equal_those_by_names_and_are_exchanged_before_they_are_counted(spark):
    rows = [(1, 10, 0, 1), (1, 10, 0, 1), (1, 11, 0, 0), (2, 10, 1, 1), (3, 10, 2, 1), (4, 12, 9, 0)]
    names = spark.createDataFrame([(0, "A"), (1, "B"), (2, "B")], "key int, name string")  # two keys of one name; 9 has none
    keyed = spark.createDataFrame(rows, "issuer long, receiver long, from int, to int")
    out = declared.trading_edges(keyed, names)
    want = [("A>A", 1, 1), ("A>B", 1, 2), ("B>B", 2, 2)]
    assert sorted(map(tuple, out.collect())) == want
    named = spark.createDataFrame([(i, r, {0: "A", 1: "B", 2: "B"}[f], {0: "A", 1: "B"}[t]) for i, r, f, t in rows if f != 9], "issuer long, receiver long, from string, to string")
    assert sorted(map(tuple, declared.trading_edges(named).collect())) == want
    plan = declared.trading_edges(keyed, names)._jdf.queryExecution().executedPlan().toString()
    first = [line for line in plan.splitlines() if "HashAggregate(keys=[issuer" in line or "REPARTITION_BY_COL" in line]
    assert "REPARTITION_BY_COL" in first[-1]  # below every count by edge
