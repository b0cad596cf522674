import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.hashing import hmac_sha256, line_bucket
from ledgerloom.functions.money import minor_to_decimal, to_minor
from ledgerloom.functions.shape import charset, holds_raw, message, regex_class, value_shape
from ledgerloom.operators.audit import insert_or_nothing, tenant_scope, ttl_dedup
from ledgerloom.operators.evaluate import findings
from ledgerloom.plans.rules import ALL, DEFAULT, check, pack
from ledgerloom.sources.codelists import LISTS, CodeList, load_code_lists

# Amounts whose results the published semantics give, then cases of our own.
MONEY = [("0.07", "AED", 7, None), ("1.234", "BHD", 1234, None), ("1", "OMR", 1000, None), ("-42.50", "AED", -4250, None), ("1,000.00", "AED", 100000, None), ("1.500", "AED", 150, None),
         ("1.005", "AED", None, "malformed"), ("one thousand", "AED", None, "malformed"), ("", "AED", None, "malformed"), (None, "AED", None, "malformed"), ("1", "JPY", None, "unknown_currency"), ("x", "XYZ", None, "unknown_currency"),
         ("0.5", "aed", 50, None), ("1.5", "bhd", 1500, None), ("+7", "Eur", 700, None), (".5", "USD", 50, None), ("5.", "USD", 500, None), (".", "USD", None, "malformed"), ("-", "USD", None, "malformed"), ("1e3", "USD", None, "malformed"),
         ("9007199254740991", "AED", None, "malformed"), ("90071992547409.91", "AED", 9007199254740991, None), ("1" * 60, "AED", None, "malformed"), ("1.5" + "0" * 40, "AED", 150, None), ("\t2\u00a0", "AED", 200, None), (" ", "zzz", None, "malformed")]


def test_money(spark):
    df = spark.createDataFrame(MONEY, "a string, c string, minor long, reason string")
    for r in df.select("a", "c", "minor", "reason", to_minor(F.col("a"), F.col("c")).alias("m")).collect():
        assert (r.m.minor, r.m.reason) == (r.minor, r.reason), r
    back = spark.createDataFrame([(7, "AED", "0.07"), (0, "AED", "0.00"), (5, "BHD", "0.005"), (-4250, "EUR", "-42.50")], "m long, c string, w string")
    assert all(r.g == r.w for r in back.select("w", minor_to_decimal(F.col("m"), F.col("c")).alias("g")).collect())


def test_shapes(spark):
    cases = [("123456789012345", "numeric", "[0-9]{15}"), ("ABCDEF", "alpha", "[A-Z]{6}"), ("abc123", "alnum", "[a-z]{3}[0-9]{3}"), ("a-b", "mixed", "[a-z]{1}[^A-Za-z0-9]{1}[a-z]{1}"),
             ("a1b2c3d4e5f6g7h8i9", "alnum", r"[\s\S]{18}"), ("", "empty", None), (None, None, None)]
    df = spark.createDataFrame(cases, "v string, c string, x string")
    for r in df.select("v", "c", "x", charset(F.col("v")).alias("gc"), regex_class(F.col("v")).alias("gx"), value_shape(F.col("v")).alias("s")).collect():
        assert (r.gc, r.gx) == (r.c, r.x)
    assert spark.createDataFrame([("1",)], "v string").select(value_shape(F.col("v")).alias("s")).first().s.len is None


def test_hashes_and_buckets(spark):
    got = spark.createDataFrame([("ar:1",)], "t string").select(hmac_sha256(b"key", F.col("t"))).first()[0]
    assert got == hmac.new(b"key", b"ar:1", hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([(0, "1"), (1, "1"), (2, "2-5"), (6, "6-20"), (21, "21-100"), (101, "100+")], "n int, w string")
    assert all(r.g == r.w for r in rows.select("w", line_bucket(F.col("n")).alias("g")).collect())


def test_rules(spark):
    check(ALL)
    assert len(ALL) == 35
    with pytest.raises(ValueError):
        check([ALL[0], ALL[0]])
    good = dict(k=1, id="A", issue_date="2024-01-01", due_date="2024-02-01", type_code="380", root="Invoice", currency="AED", seller_name="s", buyer_name="b", n_lines=1, line_total="1.00", line_sum="1.00",
                tax_inclusive="1.00", tax_exclusive="1.00", tax_total="0.00", payable="1.00", prepaid="0", predecessor_ref="x", seller_country="AE", buyer_country="AE", seller_trn="1" * 15, buyer_trn="2" * 15,
                customization_id="c", profile_id="p", buyer_ref="r", order_ref="o")
    assert [r.id for r in DEFAULT][:6] == [f"R-04{i}" for i in range(6)] and len(DEFAULT) == 32 and len(pack("en16931")) == 26
    with pytest.raises(ValueError):
        pack("peppol-bis-3.0")
    assert len(pack("peppol-bis-3.0", quarantined=True)) == 29
    with pytest.raises(ValueError):
        pack("en16931", LISTS | {"UNTDID5305": CodeList("UNTDID5305", ("S",))})
    broken = {"R-001": {"id": ""}, "R-003": {"issue_date": "01/02/2024"}, "R-006": {"currency": "aed"}, "R-011": {"line_total": "2.00"}, "R-014": {"line_total": "1.000"}, "R-015": {"tax_total": "0.000"},
              "R-023": {"due_date": "2023-01-01"}, "R-026": {"seller_country": "ae"}, "R-041": {"buyer_trn": ""}, "R-007": {"currency": "ZZZ"}, "R-005": {"type_code": "999"}, "R-043": {"seller_trn": "12"}, "R-045": {"buyer_country": " "}}
    rows = [good | {"k": 0}] + [good | change | {"k": i} for i, change in enumerate(broken.values(), 1)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], list(good))
    found = {}
    for r in findings(df, "document").collect():
        found.setdefault(r.k, set()).add(r.rule_id)
    assert found == {i: {rule} for i, rule in enumerate(broken, 1)}
    plan = findings(df, "document")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_audit(spark):
    days = [(1, d) for d in (0, 10, 85, 95, 100, 190, 200)]
    t = spark.createDataFrame(days, "u int, d int").selectExpr("u", "timestamp'2024-01-01' + make_dt_interval(d) as ts")
    assert ttl_dedup(t, ["u"], "ts", 90).first().stored == 3
    old, new = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert [r.id for r in insert_or_nothing(new, old, ["id"]).collect()] == [2]
    assert tenant_scope(new.withColumn("tenant_id", F.lit("a")), None).count() == 0


def test_code_lists(spark, tmp_path):
    (tmp_path / "units.json").write_text('{"list_id": "UNECE_REC20",\n"completeness": "partial", "codes": ["QX", "H87"]}')
    lists = load_code_lists(spark, str(tmp_path))
    assert lists["UNECE_REC20"].codes == ("H87", "QX") and not lists["UNECE_REC20"].may_deny() and lists["UNTDID5305"].may_deny()
    row = spark.createDataFrame([(1, 1, "1", "S", "item", "QX"), (2, 1, "1", "S", "item", "KGM")], "k long, line int, amount string, tax_category string, item_name string, unit string")
    assert [(r.k, r.rule_id, r.outcome) for r in findings(row, "line", pack("en16931", lists)).collect()] == [(2, "R-020", "warn")]


def test_raw_patterns(spark):
    found = ["x 123456789012345 y", "xAE070331234567890123456", "a@b.1x", "é@ü-x.de"]
    clean = ["1234567890123456", "a@b", "AE07 0331", "", None, "9AE0"]
    df = spark.createDataFrame([(v, True) for v in found] + [(v, False) for v in clean], "v string, w boolean")
    assert all(r.g == r.w for r in df.select("w", holds_raw(F.col("v")).alias("g")).collect())


def test_messages(spark):
    df = spark.createDataFrame([(None, "nothing"), ("", "empty"), ("ab", "2 characters (alpha)"), ("1", "a numeric value"), ("alpha", "5 characters")], "v string, w string")
    assert all(r.g == f"Expected x; received {r.w}." for r in df.select("w", message("x", F.col("v")).alias("g")).collect())
