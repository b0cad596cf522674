import random

from pyspark.sql import functions as F

from ledgerloom import audit_queries
from ledgerloom.operators.audit import ttl_dedup
from ledgerloom.operators.evaluate import row_findings

SF = "/root/testdata/sf0.001"


def test_golden_check_sees_every_invoice(spark, monkeypatch):
    docs = audit_queries.invoices(spark, SF)
    assert audit_queries.expectations(docs).count() == docs.count()
    right = {(r.k, r.problem) for r in audit_queries.golden_check(spark, SF).collect()}
    lost = "rule_id = 'R-041' AND k % 47 <> 0"
    monkeypatch.setattr(audit_queries, "row_findings", lambda rows: row_findings(rows).where(f"NOT ({lost})"))
    wrong = {(r.k, r.problem) for r in audit_queries.golden_check(spark, SF).collect()}
    want = {r.k for r in docs.where("k % 59 = 0 AND k % 47 <> 0 AND k % 43 <> 0").collect()}
    assert want and {k for k, problem in wrong - right if problem == "missing R-041"} == want
    monkeypatch.setattr(audit_queries, "row_findings", lambda rows: (f := row_findings(rows)).unionByName(f.where("k = 37 AND rule_id = 'R-011'").withColumn("rule_id", F.lit("R-010"))))
    assert {(r.k, r.problem) for r in audit_queries.golden_check(spark, SF).collect()} - right == {(37, "unexpected R-010")}


def test_ttl_holds_no_array_of_a_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), rng.choice("ab"), rng.randrange(200)) for _ in range(3000)] + [(4, "a", None), (4, "b", 7), (4, "b", None), (4, "b", 7)] + [(5, "c", d) for d in range(500)]
    df = spark.createDataFrame(rows, "u int, e string, d int").selectExpr("u", "e", "timestamp'2024-01-01' + make_dt_interval(d) AS ts")
    want = {}
    for u, e, d in sorted(rows, key=lambda r: -1 if r[2] is None else r[2]):
        n, kept, last = want.get((u, e), (0, 0, None))
        if d is not None:
            n, kept, last = (n + 1, kept + 1, d) if last is None or d - last >= 5 else (n + 1, kept, last)
        want[u, e] = n, kept, last
    out = ttl_dedup(df, ["u", "e"], "ts", 5)
    assert {(r.u, r.e): (r.arrivals, r.stored) for r in out.collect()} == {k: v[:2] for k, v in want.items()}
    assert "collect_list" not in out._jdf.queryExecution().toString()
