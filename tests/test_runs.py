import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, runs
from ledgerloom.operators.audit import insert_or_nothing
from ledgerloom.plans.rules import DEFAULT, pack
from ledgerloom.sources import ubl, vouchers
from ledgerloom.streaming import validate

FILE = """<ENVELOPE><BODY><X><VOUCHER A="1"><VOUCHERTYPENAME>Sales</VOUCHERTYPENAME><VOUCHERNUMBER> 7 </VOUCHERNUMBER><DATE>20260715</DATE><PARTYLEDGERNAME>Buyer &amp; Co</PARTYLEDGERNAME><CMPVATTINNUMBER>9</CMPVATTINNUMBER>
<ALLINVENTORYENTRIES.LIST><STOCKITEMNAME>a</STOCKITEMNAME><BILLEDQTY> 10 Nos</BILLEDQTY><AMOUNT>-1,000.50</AMOUNT><RATEOFVAT>5</RATEOFVAT></ALLINVENTORYENTRIES.LIST>
<ALLINVENTORYENTRIES.LIST><ACTUALQTY>2</ACTUALQTY><AMOUNT>20</AMOUNT><GSTRATE>0</GSTRATE></ALLINVENTORYENTRIES.LIST>
<ALLLEDGERENTRIES.LIST><LEDGERNAME>Other</LEDGERNAME><AMOUNT>1</AMOUNT></ALLLEDGERENTRIES.LIST><ALLLEDGERENTRIES.LIST><LEDGERNAME>Buyer &amp; Co</LEDGERNAME><AMOUNT>-1071.53</AMOUNT></ALLLEDGERENTRIES.LIST></VOUCHER></X>
<VOUCHER><VOUCHERTYPENAME>Journal</VOUCHERTYPENAME></VOUCHER><VOUCHER/></BODY></ENVELOPE>"""


def test_vouchers(spark):
    accepted = vouchers.accept(vouchers.scan(spark.createDataFrame([("f", FILE), ("g", "<ENVELOPE/>"), ("h", "no xml")], "file string, xml string")))
    docs = vouchers.documents(accepted)
    d = docs.collect()
    assert len(d) == 1
    d = d[0]
    assert (d.invoice_number, d.issue_date, d.doc_type, d.currency, d.buyer_name, d.buyer_trn, d.seller_trn) == ("7", "2026-07-15", "invoice", "AED", "Buyer & Co", None, "9")
    assert (d.line_total, d.tax_amount, d.payable, d.has_allowance, d.multi_rate) == (102050, None, 107153, False, True)
    assert [(x.line, x.description, x.quantity, x.unit_text, x.minor) for x in d.lines] == [(1, "a", "10", "Nos", 100050), (2, None, "2", None, 2000)]
    found = sorted((r.file, r.source_ref, r.defect_class) for r in vouchers.defects(accepted, docs).collect())
    assert found == [("f", "voucher[0]", "tax_category_unmapped"), ("f", "voucher[0]", "trn_missing"), ("f", "voucher[0].line[0]", "unit_code_freetext"), ("f", "voucher[1]", "parse_error"), ("f", "voucher[2]", "parse_error"), ("g", "file", "parse_error"), ("h", "file", "parse_error")]


def test_ubl(spark):
    ubl.self_test(spark)
    with pytest.raises(ValueError):
        ubl.self_test(spark, [*DEFAULT, DEFAULT[0].__class__("X-1", "document", "fatal", None, "cardinality", None, lambda: F.lit(None).cast("boolean"), "an unknown")])
    bare = '<Invoice><cbc:ID xmlns:cbc="c"/><cac:LegalMonetaryTotal xmlns:cac="a"><cbc:PayableAmount xmlns:cbc="c">5</cbc:PayableAmount></cac:LegalMonetaryTotal></Invoice>'
    texts = spark.createDataFrame([(1, bare), (2, "<Order/>"), (3, "<Invoice><a></Invoice>"), (4, None), (5, "")], "k long, xml string")
    parsed = {r.k: r for r in ubl.parse_ubl(texts).collect()}
    assert {k: r.refused for k, r in parsed.items()} == {1: None, 2: "root", 3: "malformed", 4: "malformed", 5: "malformed"}
    assert parsed[1].terms["BT-1"] in ("", None) and parsed[1].terms["BT-115"] == "5" and parsed[1].terms["BT-112"] is None and not parsed[1].lines
    found = ubl.judge(texts).collect()
    assert sorted(r.k for r in found if r.outcome == "no_verdict") == [2, 3, 4, 5]
    assert {"R-001", "R-010", "R-041"} <= {r.rule_id for r in found if r.k == 1} and not {"R-013", "R-014", "R-015"} & {r.rule_id for r in found if r.k == 1}


def test_runs(spark):
    files = [("tally", "text/csv", "a.csv", "tally_xml"), ("x", "", "B.XLSX", "xlsx"), ("x", "text/csv", "b", "csv"), ("x", "", "c.xml", "tally_xml"), ("x", "image/png", "d", None), ("x", None, None, None)]
    df = spark.createDataFrame(files, "v string, m string, f string, w string")
    assert all(r.g == r.w for r in df.select("w", runs.detect_format(F.col("v"), F.col("m"), F.col("f")).alias("g")).collect())
    keys = spark.createDataFrame([({"zeroRated": True, "selfBilled": True, "export": False},)], "m map<string,boolean>").select(runs.scenario_keys(F.col("m"))).first()[0]
    assert keys == ["zero_rated"]
    at = lambda d: dt.datetime(2024, 1, d)
    done = spark.createDataFrame([(1, "completed", 1, at(1)), (2, "failed", 2, at(1)), (2, "running", 1, at(9)), (3, "running", 1, at(9)), (4, "running", 3, at(2))], "run int, status string, attempt int, lease_until timestamp")
    got = {r.run: (r.action, r.attempt) for r in runs.claims(spark.range(1, 6).select(F.col("id").cast("int").alias("run")), done, F.lit(at(5))).collect()}
    assert got == {1: ("skip", 2), 2: ("claim", 3), 3: ("held", 2), 4: ("claim", 4), 5: ("claim", 1)}
    cases = spark.createDataFrame([("a", "fail")] * 40 + [("a", "pass")] * 20 + [("b", "fail")] * 10 + [("peppol-bis-3.0", "fail")] * 99, "profile string, outcome string")
    assert {r.profile: (r.cases, r.failing, r.balanced) for r in runs.balance(cases).collect()} == {"a": (60, 40, True), "b": (10, 10, False), "peppol-bis-3.0": (99, None, False)}


def test_ruleset_hash(spark):
    rules, lists = runs.catalogue(spark, DEFAULT), spark.createDataFrame([("L", "a"), ("L", "b")], "list_id string, code string")
    first = evaluate.ruleset_hash(rules, lists).first()[0]
    assert first.startswith("sha256:") and first == evaluate.ruleset_hash(rules.orderBy(F.desc("rule_id")), lists.orderBy(F.desc("code"))).first()[0]
    assert first != evaluate.ruleset_hash(rules, lists.where("code = 'a'")).first()[0] != evaluate.ruleset_hash(rules.limit(3), lists).first()[0]
    assert insert_or_nothing(rules, rules.limit(30), ["rule_id"]).count() == 2


def test_files_hash(spark, tmp_path):
    hashes = []
    for name, files in (("a", {"x.sch": b"1", "y.sch": b"2"}), ("b", {"y.sch": b"2", "x.sch": b"1"}), ("c", {"x.sch": b"2", "y.sch": b"1"}), ("d", {"x.sch": b"1"})):
        (tmp_path / name).mkdir()
        for file, content in files.items():
            (tmp_path / name / file).write_bytes(content)
        hashes.append(evaluate.files_hash(spark.read.format("binaryFile").load(str(tmp_path / name))).first()[0])
    assert hashes[0] == hashes[1] and len(set(hashes)) == 3


def test_access_log_and_normalise(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, n int")
    assert [r.n for r in runs.tenant_read(df, "b", "me", "audit", f"{tmp_path}/log").collect()] == [2] and runs.tenant_read(df, None, "me", "audit", f"{tmp_path}/log").count() == 0
    assert spark.read.parquet(f"{tmp_path}/log").where("actor = 'me' AND reason = 'audit'").count() == 2
    for _ in range(2):
        assert runs.write_normalised(df, df, "r1", str(tmp_path)).first().doc_count == 2
    assert spark.read.parquet(f"{tmp_path}/invoice").count() == 2


def test_streams(spark, tmp_path):
    good = ubl.to_ubl(spark.createDataFrame([tuple(ubl.GOOD.values())], ", ".join(f"{c} {'long' if c == 'k' else 'string'}" for c in ubl.GOOD)), spark.createDataFrame([], "k long, line int, amount string, item_name string, tax_category string, unit string, quantity string")).first().xml
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(good)
    (tmp_path / "in" / "b.xml").write_text("<Invoice><")
    for _ in range(2):  # the second run has nothing to do
        validate.stream_findings(validate.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out" / "findings")).collect()
    assert {r.rule_id for r in found} == {"R-010", "R-011"}
    assert [r.message for r in spark.read.parquet(str(tmp_path / "out" / "no_verdict")).collect()] == ["malformed"]


def test_linked_copies(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    batches = [[("t", "c", "f1", at(0)), ("t", "c", "f2", at(5)), ("u", "c", "g1", at(1))], [("t", "c", "f3", at(89)), ("t", "d", "h1", at(89))], [("t", "c", "f4", at(90)), ("t", "c", "f5", at(91)), ("u", "c", "g2", at(200))]]
    source = str(tmp_path / "arrivals")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "tenant string, checksum string, file_id string, at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("tenant string, checksum string, file_id string, at timestamp").parquet(source)
        query = validate.link_copies(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r.file_id: r.copy_of for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"f1": None, "f2": "f1", "g1": None, "f3": "f1", "h1": None, "f4": None, "f5": "f4", "g2": None}


def test_windowed_counts(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    spark.createDataFrame([(at(1, 5), "a"), (at(1, 50), "a"), (at(1, 55), "b"), (at(2, 1), "a"), (at(9), "z")], "at timestamp, rule string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, rule string").parquet(str(tmp_path / "in"))
    query = validate.counts_by_window(stream, "at", "rule").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.window.start.hour, r.rule): r.n for r in spark.table("windows").collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (2, "a"): 1}


def test_defects_read_each_voucher_once(spark):
    accepted = vouchers.accept(vouchers.scan(spark.createDataFrame([], "file string, xml string")))
    plan = vouchers.defects(accepted, vouchers.documents(accepted))._jdf.queryExecution().analyzed().toString()
    assert plan.count("posexplode") == 1  # before: one for each kind of defect
