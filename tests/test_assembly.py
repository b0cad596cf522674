from pyspark.sql import functions as F

from ledgerloom.operators import assemble, gates, scores
from ledgerloom.sources.tabular import ALIASES, csv_lines, file_defects, read_csv, read_golden, resolve_headers, write_csv

CSV = """Invoice Number,issue-date,CURRENCY,Buyer_Name,buyer.trn,Line Description,qty,uom,Line Net Amount,Tax Category,VAT Rate
A1,2026-07-15,AED,"Buyer, Ltd",100000000000003,one,1,EA,1000.00,S,5
A1,2026-07-15,AED,,,two,2,Nos.,500.00,S,5
A1,2026-07-15,EUR,,,three,1,EA,1.00,S,5
A2,15/07/2026,AED,x,,one,1,EA,1.00,S,5
A3,2026-07-16,,x,,one,1,EA,,,
"""


def test_csv_documents(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    numbered = assemble.number_rows(resolve_headers(read_csv(spark, str(tmp_path))))
    docs = {r.invoice_number: r for r in assemble.documents(numbered).collect()}
    assert set(docs) == {"A1", "A3"}
    assert (docs["A1"].n_lines, docs["A1"].line_total, docs["A1"].multi_rate) == (2, 150000, False)
    assert (docs["A3"].currency, docs["A3"].n_lines, docs["A3"].line_total) == ("AED", 1, None)
    found = sorted(r.defect_class for r in assemble.defects(numbered).collect())
    assert found == ["currency_inconsistent", "parse_error", "tax_category_unmapped", "trn_missing", "unit_code_freetext"]
    assert numbered.where("invoice_number = 'A1'").agg(F.max("buyer_name")).first()[0] == "Buyer, Ltd"


def test_documents_and_hashes_take_one_exchange_of_their_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV + "A3,2026-07-16,,x,,two,1,EA,,,7\nA4,2026-07-16,AED,x,,one,1,EA,1.00,S,5\nA4,2026-07-16,AED,,,two,1,EA,1.00,S,5.0\n")
    numbered = assemble.number_rows(resolve_headers(read_csv(spark, str(tmp_path)))).localCheckpoint()
    got = assemble.documents(numbered)
    assert sorted((r.invoice_number, r.n_lines, r.line_total, r.multi_rate) for r in got.collect()) == [("A1", 2, 150000, False), ("A3", 2, None, False), ("A4", 2, 200, False)]
    rows = spark.createDataFrame([], numbered.select("file", "row_idx", *ALIASES).schema)
    for made in (assemble.documents, assemble.doc_hash):
        plan = made(assemble.number_rows(rows))._jdf.queryExecution().analyzed().toString()
        assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1  # before: two of documents, three of hashes


def test_scores(spark):
    full = dict.fromkeys(scores.WEIGHTS, 1.0)
    cases = [full, full | {"master_data_quality": 0.0}, full | {"scenario_coverage": 0.5, "rule_failure_rate": 0.2}, full | {"scenario_coverage": 5.0}]
    df = spark.createDataFrame([(i, *c.values()) for i, c in enumerate(cases)], ["k", *full])
    got = {r.k: (r.score, r.band, r.largest_gap) for r in scores.readiness(df, "k").collect()}
    assert got[0][:2] == (100, "ready") and got[1] == (75, "nearly_ready", "master_data_quality") and got[2][2] == "rule_failure_rate" and got[3][0] == 100
    bands = spark.createDataFrame([(0, "not_ready"), (39, "not_ready"), (40, "at_risk"), (69, "at_risk"), (70, "nearly_ready"), (89, "nearly_ready"), (90, "ready"), (100, "ready")], "s int, w string")
    assert all(r.g == r.w for r in bands.select("w", scores.band(F.col("s")).alias("g")).collect())


def test_spec_gate(spark):
    rows = [(True, "1", "1", "quarantined"), (False, None, "1", "unresolved"), (False, "2", "1", "version_mismatch"), (False, "1", "1", "usable")]
    df = spark.createDataFrame(rows, "q boolean, v string, w string, x string")
    assert all(r.g == r.x for r in df.select("x", gates.spec_gate(F.col("q"), F.col("v"), F.col("w")).alias("g")).collect())


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffInvoice Number,Issue Date\nA1, 2026-07-15 \n\nA2\n".encode())
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bad.csv").write_bytes(b"\xff\xfe\x00")
    rows = resolve_headers(read_csv(spark, str(tmp_path / "a.csv"))).orderBy("row_idx").collect()
    assert [(r.row_idx, r.invoice_number, r.issue_date) for r in rows] == [(0, "A1", "2026-07-15"), (1, "A2", None)]
    found = {r.file.rsplit("/", 1)[1]: r.source_ref for r in file_defects(spark, str(tmp_path / "*.csv")).collect()}
    assert found == {"empty.csv": "header", "bad.csv": "file"}


def test_files_with_their_own_headers(spark, tmp_path):
    """Each file's header names its values, whatever the other files have."""
    (tmp_path / "a.csv").write_text('Invoice Number,Issue Date,Currency\nA1,2026-07-15,AED,behind\n"A\n2",2026-07-16\n')
    (tmp_path / "b.csv").write_bytes('\ufeff\n"Total, gross",CURRENCY,bt-2,Grand Total,Document Number,invoice no\n9,EUR,2026-01-01,5,B1,\n,,,,,\n,USD,,6,B2,B3\n'.encode())
    (tmp_path / "c.csv").write_text("\n\nInvoiceNo\n")
    (tmp_path / "d.csv").write_text("")
    rows = resolve_headers(read_csv(spark, str(tmp_path))).select(F.element_at(F.split("file", "/"), -1).alias("f"), "row_idx", "invoice_number", "issue_date", "currency", "payable")
    assert sorted(map(tuple, rows.collect()), key=lambda r: r[:2]) == [
        ("a.csv", 0, "A1", "2026-07-15", "AED", None), ("a.csv", 1, "A\n2", "2026-07-16", None, None),
        ("b.csv", 0, "B1", "2026-01-01", "EUR", "5"), ("b.csv", 1, None, None, None, None), ("b.csv", 2, "B3", None, "USD", "6"),
    ]
    fields = [[("Invoice No", 'x "y", z'), ("date", None)], [("Invoice No", ""), ("date", "d")]]
    written = spark.createDataFrame([("p", 5, fields[0]), ("p", 7, fields[1]), ("q", 1, [("date", "e")])], "file string, row_idx long, fields array<struct<name:string,value:string>>")
    write_csv(written, str(tmp_path / "out"))
    back = resolve_headers(read_csv(spark, str(tmp_path / "out"))).select(F.regexp_extract("file", "file=(.)", 1), "row_idx", "invoice_number", "issue_date")
    assert sorted(map(tuple, back.collect())) == [("p", 0, 'x "y", z', None), ("p", 1, None, "d"), ("q", 0, None, "e")]


def test_csv_lines_take_one_exchange(spark):
    rows = spark.createDataFrame([("p", 2, [("a", "3")]), ("p", 1, [("a", 'x"')]), ("q", 1, [("b", None)])], "file string, row_idx long, fields array<struct<name:string,value:string>>")
    lines = csv_lines(rows)
    assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [r.value for r in lines.where("file = 'p'").collect()] == ['"a"\n"x"""', '"3"']


def test_golden_files(spark, tmp_path):
    (tmp_path / "uae").mkdir()
    (tmp_path / "uae" / "one.xml").write_text("<Invoice/>")
    (tmp_path / "uae" / "one.expected.json").write_text('{"outcome": "fail",\n "fired_rules": ["R-001"]}')
    (tmp_path / "uae" / "two.xml").write_text("<Invoice/>")
    got = {r.name: r for r in read_golden(spark, str(tmp_path), "outcome string, fired_rules array<string>").collect()}
    assert got["one"].profile == "uae" and got["one"].xml == "<Invoice/>" and got["one"].expected.fired_rules == ["R-001"] and got["two"].expected is None


def test_expectation_details(spark):
    found = spark.createDataFrame([(1, "R-1", 0, "c", "t", ("s",)), (2, "R-1", 0, "c", "t", ("s",)), (2, "R-1", 0, "c", "t", ("s",)), (3, "R-1", 0, "x", "y", (None,))], "k int, rule_id string, node int, failure_class string, term string, shape struct<regex_class:string>")
    want = spark.createDataFrame([(i, "R-1", "c", "t", "s") for i in (1, 2, 3, 4)], "k int, rule_id string, failure_class string, term string, regex_class string")
    assert sorted((r.k, r.problem) for r in scores.check_details(want, found).collect()) == [(2, "twice R-1"), (3, "class R-1"), (3, "shape R-1"), (3, "term R-1"), (4, "silent R-1")]
    cases = spark.createDataFrame([(1, "superset", " "), (2, "superset", "why"), (3, "exact", None), (4, "superset", None)], "k int, match string, justification string")
    assert [r.k for r in scores.unjustified(cases).orderBy("k").collect()] == [1, 4]
    matches = spark.createDataFrame([(1, "p", 0, 2), (1, "p", 0, 1), (1, "p", 1, 2)], "k int, pattern string, node int, seq int")
    assert sorted((r.node, r.seq) for r in gates.claimed(matches, ["k", "pattern", "node"], "seq").collect()) == [(0, 1), (1, 2)]
    terms = spark.createDataFrame([(["BT-1"],), (list(gates.MANDATORY),), (None,)], "mapped array<string>")
    assert gates.confirm(terms, F.current_timestamp()).count() == 1
