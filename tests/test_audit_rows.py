"""The result of an audit in one pass against the operators that it is made of."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom import run_queries
from ledgerloom.operators import assemble, evaluate, runs
from ledgerloom.sources.tabular import export_rows, resolve_headers

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("bits", [31, 5])
def test_one_pass_equals_its_parts(spark, monkeypatch, bits):
    monkeypatch.setattr(evaluate, "BITS", bits)
    rows = run_queries._profiled(spark, SF).where(F.col("profile").isin(*run_queries.USABLE))
    docs = rows.where("line = 1").withColumn("scenario", F.expr("CASE WHEN k % 11 = 0 THEN 'zero_rated' WHEN k % 13 = 0 THEN 'export' ELSE 'standard' END"))
    stored = evaluate.stored_outcomes(docs, run_queries._found(rows), ("k", "run"))
    defects = assemble.register(assemble.defects(assemble.number_rows(resolve_headers(export_rows(spark, SF))))).select(F.col("file").alias("run"), "n")
    want = runs.audit_results(docs.select("run", "scenario"), stored, defects, "run")
    got = run_queries.audit_result(spark, SF)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count()


def test_lines_and_orders_are_exchanged_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = run_queries.audit_result(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == len(re.findall(r"FileScan parquet \[o_orderkey", plan)) == 1
    keys = sorted(re.findall(r"Exchange hashpartitioning\((\w+)#", plan))
    assert keys == ["c_custkey", "k", "o_custkey", "o_orderkey", "run"]  # orders twice: by customer, then as they are by key


def test_masks_tell_failures_from_open_rules(spark):
    rule = lambda n, severity, holds: evaluate.Rule(f"X-{n}", "line", severity, None, "cardinality", None, lambda: F.expr(holds), "x")
    packs = {"p": [rule(0, "fatal", "false"), rule(1, "error", "cast(null as boolean)"), rule(2, "warning", "cast(null as boolean)"), rule(3, "warning", "false"), rule(4, "fatal", "true")], "q": [rule(4, "fatal", "true")]}
    rows = spark.createDataFrame([(1, 1, "p", "S"), (2, 1, "q", "S"), (3, 1, "r", "S")], "k long, line int, profile string, tax_category string")
    rules, rows = evaluate.pack_rules(packs), evaluate.row_masks(rows, packs)
    got = {r.k: (r.warn, r.fail, r.no_verdict, r.f) for r in rows.select("k", *[c.alias(x) for x, c in evaluate.mask_counts(F.col("masks"), rules).items()], F.array(*evaluate.failing(F.col("masks"), rules)).alias("f")).collect()}
    assert got == {1: (2, 1, 1, [1]), 2: (0, 0, 0, [0]), 3: (0, 0, 0, [0])}


def test_defects_are_shaped_only_where_they_are(spark):
    found = assemble.defects(assemble.number_rows(resolve_headers(export_rows(spark, SF))))
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString().split("explode")[-1]
    assert found.count() == assemble.count_defects(assemble.number_rows(resolve_headers(export_rows(spark, SF)))).agg(F.sum("n_defects")).first()[0]
