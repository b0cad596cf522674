"""Queries on assembled documents, gates, scores and declared work, with their DuckDB equivalents."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import recurrence_key
from .operators import assemble, declared, gates, scores
from .operators.evaluate import row_findings, row_outcomes
from .plans.rules import DEFAULT
from .sources.fixtures import DUCK_WITH, invoice_rows, invoices
from .sources.tabular import EXPORT, export_rows, resolve_headers

AS_OF = "1997-01-01"
TERMS = {"BT-1": "id", "BT-2": "issue_date", "BT-5": "currency", "BT-31": "seller_trn", "BT-44": "buyer_name", "BT-48": "buyer_trn", "BT-106": "line_total", "BT-112": "tax_inclusive"}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return assemble.number_rows(resolve_headers(export_rows(spark, d)))


def _present() -> Column:
    return gates.present_terms({t: F.col(c) for t, c in TERMS.items()})


def _failures(spark: SparkSession, d: str) -> DataFrame:
    found = row_findings(invoice_rows(spark, d), keep=("custkey", "issued")).where("outcome = 'fail'")
    key = recurrence_key(F.col("custkey").cast("string"), F.col("rule_id"), F.col("term"), F.lit(None).cast("string"))
    return found.select("k", "custkey", "rule_id", key.alias("recurrence_key"), F.to_date("issued").alias("occurred_at"))


def assemble_documents(spark: SparkSession, d: str) -> DataFrame:
    return assemble.documents(_numbered(spark, d)).drop("buyer_trn")


def assembled_lines(spark: SparkSession, d: str) -> DataFrame:
    return assemble.line_rows(_numbered(spark, d)).select("file", "row_idx", "line", "unit", F.col("net.minor").alias("minor"), F.col("net.reason").alias("reason"))


def assembly_defects(spark: SparkSession, d: str) -> DataFrame:
    return assemble.defects(_numbered(spark, d)).select("file", "row_idx", "defect_class")


def defect_register(spark: SparkSession, d: str) -> DataFrame:
    return assemble.register(assemble.defects(_numbered(spark, d))).select("file", "defect_class", "n", F.col("first_shape.regex_class").alias("first_class"))


def doc_hash(spark: SparkSession, d: str) -> DataFrame:
    return assemble.doc_hash(_numbered(spark, d))


def mapping_presence(spark: SparkSession, d: str) -> DataFrame:
    terms = invoices(spark, d).select(F.explode(_present()).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


def mandatory_gaps(spark: SparkSession, d: str) -> DataFrame:
    return invoices(spark, d).select("k", F.array_join(gates.mandatory_gaps(_present()), ",").alias("gaps")).where("gaps <> ''")


def mapping_gate(spark: SparkSession, d: str) -> DataFrame:
    confirmed = F.when(F.col("k") % 4 != 0, F.col("issued"))
    return invoices(spark, d).select(gates.gate(_present(), confirmed).alias("gate")).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


def orphan_lines(spark: SparkSession, d: str) -> DataFrame:
    orders = _table(spark, d, "orders").where("o_orderkey % 10 <> 0").withColumnRenamed("o_orderkey", "l_orderkey")
    return gates.orphans(_table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), orders, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def next_profile_version(spark: SparkSession, d: str) -> DataFrame:
    orders = _table(spark, d, "orders").select("o_custkey", "o_orderkey")
    old = orders.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("int").alias("version"))
    return gates.next_version(orders.where("o_orderkey % 2 = 1"), old, ["o_custkey"], "o_orderkey").withColumn("version", F.col("version").cast("int"))


def first_errors(spark: SparkSession, d: str) -> DataFrame:
    return gates.until_first_error(row_findings(invoice_rows(spark, d)), "k", ["rule_id", "node"]).groupBy("rule_id").agg(F.count(F.lit(1)).alias("documents"))


def expectations(docs: DataFrame) -> DataFrame:
    """What ``check_expectations`` expects of every invoice, from the defects that the fixtures plant by its key. Keys
    divisible by 47 carry the seeded case as well, which expects R-041 and R-040 and forbids R-011 and R-018."""
    k = F.col("k")
    by = lambda *n: F.greatest(*[k % x == 0 for x in n]) if len(n) > 1 else k % n[0] == 0
    on_line = lambda hit: F.exists(F.sequence(F.lit(1), "n_lines"), hit)
    planted = {
        "R-001": by(97, 101), "R-003": by(53), "R-006": by(71) & ~by(89), "R-007": by(178), "R-009": by(83), "R-011": by(37) & ~by(73), "R-012": by(127), "R-013": by(131), "R-014": by(73),
        "R-017": on_line(lambda i: ((k + i) % 41 == 0) & ((k + i) % 31 != 0)), "R-018": on_line(lambda i: (k + i) % 31 == 0), "R-019": by(163) | on_line(lambda i: (k + i) % 29 == 0), "R-021": on_line(lambda i: (k + i) % 79 == 0),
        "R-022": (F.col("root") == "CreditNote") & by(5), "R-023": by(61) & ~by(53), "R-024": on_line(lambda i: (k + i) % 31 == 0), "R-025": by(127) & ~by(131), "R-026": by(67),
        "R-041": by(47, 59) & ~by(43), "R-042": by(43), "R-043": by(103), "R-044": by(109), "R-045": by(107),
    }
    rules = F.array_compact(F.array(*[F.when(hit, F.lit(rule)) for rule, hit in planted.items()]))
    warnings = F.array(*[F.lit(r.id) for r in DEFAULT if r.severity == "warning"])
    none, seeded, case, not_in_case = F.array().cast("array<string>"), by(47), F.array(F.lit("R-041"), F.lit("R-040")), F.array(F.lit("R-011"), F.lit("R-018"))
    outcome = F.when(seeded | (F.size(F.array_except("rules", warnings)) > 0), "fail").when(F.size("rules") > 0, "warn").otherwise("pass")
    others = F.array_except(F.array(*[F.lit(r.id) for r in DEFAULT]), F.array_union("rules", case))
    return docs.select("k", rules.alias("rules")).select(
        "k", outcome.alias("outcome"), F.when(seeded, "superset").otherwise("exact").alias("match"), F.array_union("rules", F.when(seeded, case).otherwise(none)).alias("fired_rules"),
        F.when(seeded, F.array_union(others, not_in_case)).otherwise(none).alias("must_not_fire"),
    )


def golden_check(spark: SparkSession, d: str) -> DataFrame:
    rows = invoice_rows(spark, d)
    return scores.check_expectations(expectations(rows.where("line = 1")), row_findings(rows))


def readiness_score(spark: SparkSession, d: str) -> DataFrame:
    rows = invoice_rows(spark, d)
    failing = row_outcomes(rows).where("outcome = 'fail'").select("k", F.lit(1).alias("bad"))
    seen = rows.where("line = 1").join(failing, "k", "left").groupBy("custkey").agg(
        F.avg(F.size(_present()) / 8).alias("mandatory_field_coverage"), F.avg(F.when(F.size(_present()) == 8, 1.0).otherwise(0.0)).alias("master_data_quality"),
        (F.count_distinct("root") / 2).alias("scenario_coverage"), (1 - F.count("bad") / F.count(F.lit(1))).alias("rule_failure_rate"),
    )
    return scores.readiness(seen.withColumn("lifecycle_readiness", F.when(F.col("custkey") % 2 == 0, 1.0).otherwise(0.5)), "custkey")


def scenario_coverage(spark: SparkSession, d: str) -> DataFrame:
    seen = assemble.documents(_numbered(spark, d)).groupBy("file").agg(F.collect_set("scenario").alias("seen"))
    want = F.array(F.lit("standard"), F.lit("zero_rated"), F.lit("export"))
    c = scores.scenario_coverage(want, F.col("seen"))
    return seen.select("file", F.round(c["ratio"], 4).alias("ratio"), F.array_join(F.array_sort(c["unobserved"]), ",").alias("unobserved"), F.array_join(F.array_sort(c["undeclared"]), ",").alias("undeclared"))


def frozen_receivables(spark: SparkSession, d: str) -> DataFrame:
    docs = invoices(spark, d)
    each = docs.groupBy("currency", "custkey").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("line_sum") * 100).cast("long")).alias("cents"))
    by = each.groupBy("currency").agg(F.sum("n").alias("invoices"), F.sum("cents").alias("cents"), F.count("custkey").alias("entities"))
    by = by.select("currency", "invoices", F.lit(Decimal("0.125")).alias("failure_rate"), F.expr("cents div invoices").alias("average"), "entities")
    return scores.frozen_receivables(by.drop("entities"), by.select("currency", "entities"), "currency").drop("workings")


def ap_match(spark: SparkSession, d: str) -> DataFrame:
    docs = invoices(spark, d).select(F.col("k").alias("seq"), F.col("custkey").alias("counterparty"), F.floor(F.col("k") / 2).alias("number"), (F.col("line_sum") * 100).cast("long").alias("payable"), F.col("n_lines").alias("quantity"))
    base = docs.where("seq % 2 = 0")
    orders = base.where("seq % 14 <> 0").select("counterparty", "number", (F.col("payable") + F.when(F.col("seq") % 22 == 0, 100).otherwise(0)).alias("amount"))
    receipts = base.where("seq % 6 = 0").select("counterparty", "number", (F.col("quantity") - F.when(F.col("seq") % 18 == 0, 1).otherwise(0)).alias("received"))
    return declared.ap_match(docs.union(base.where("seq % 34 = 0").withColumn("seq", -F.col("seq"))), orders, receipts).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def trading_edges(spark: SparkSession, d: str) -> DataFrame:
    names = _table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    supplier = _table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("from"))
    customer = _table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("to"))
    rows = _table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(_table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return declared.trading_edges(rows.select(F.col("l_suppkey").alias("issuer"), F.col("o_custkey").alias("receiver"), "from", "to"), names)


def deadline_breach(spark: SparkSession, d: str) -> DataFrame:
    orders = _table(spark, d, "orders")
    sent = F.when(F.col("o_orderkey") % 5 != 0, F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 40 AS INT))"))
    late = declared.breached(F.expr("o_orderdate + INTERVAL 30 DAYS"), sent, F.to_timestamp(F.lit(AS_OF)))
    return orders.select("o_orderpriority", late.alias("late")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("breached"))


def exception_queue(spark: SparkSession, d: str) -> DataFrame:
    return declared.exception_queue(_failures(spark, d), F.to_date(F.lit(AS_OF)))


def recurrence_after_fix(spark: SparkSession, d: str) -> DataFrame:
    failures = _failures(spark, d)
    fixes = failures.groupBy("recurrence_key").agg(F.date_add(F.min("occurred_at"), 30).alias("resolved_at"))
    return declared.recurred_after(fixes, failures)


def recurrence_stats(spark: SparkSession, d: str) -> DataFrame:
    return declared.recurrence_stats(_failures(spark, d), ["rule_id"], "custkey")


def divergence_magnitude(spark: SparkSession, d: str) -> DataFrame:
    docs = invoices(spark, d).select((F.col("k") % 100).cast("double").alias("gap"), F.col("line_sum").cast("double").alias("total"))
    return docs.select(declared.magnitude(F.col("gap"), F.col("total")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def revenue_mix(spark: SparkSession, d: str) -> DataFrame:
    bills = invoices(spark, d).select(F.date_format("issued", "yyyy-MM").alias("month"), F.col("line_sum").cast("decimal(18,2)").alias("amount"), (F.col("order_ref").isNotNull()).alias("recurring"), (F.col("root") == "Invoice").alias("collected"))
    return declared.revenue_mix(bills).select("month", *[F.col(c).cast("double").alias(c) for c in ("billed", "collected", "recurring")])


def capacity_trigger(spark: SparkSession, d: str) -> DataFrame:
    week = F.floor(F.date_diff("l_shipdate", F.to_date(F.lit("1970-01-05"))) / 7).cast("int")
    weeks = _table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), week.alias("week")).agg(F.sum("l_quantity").alias("used"))
    return declared.capacity_trigger(weeks, "supplier", 50.0)


def scenario_required_terms(spark: SparkSession, d: str) -> DataFrame:
    scene = F.element_at(F.array(*map(F.lit, gates.REQUIRED)), (F.col("k") % 4 + 1).cast("int"))
    return invoices(spark, d).select("k", scene.alias("scenario"), F.array_join(gates.scenario_gaps(scene, _present()), ",").alias("missing"))


def late_issuance(spark: SparkSession, d: str) -> DataFrame:
    shipped = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_shipdate").alias("received"))
    return declared.late_issuance(invoices(spark, d).select("k", "issued").join(shipped, "k"), "issued", "received").select("k")


QUERIES = (
    assemble_documents, assembled_lines, assembly_defects, defect_register, doc_hash, mapping_presence, mandatory_gaps, mapping_gate, orphan_lines, next_profile_version, first_errors, golden_check,
    readiness_score, scenario_coverage, frozen_receivables, ap_match, trading_edges, deadline_breach, exception_queue, recurrence_after_fix, recurrence_stats, divergence_magnitude, revenue_mix,
    capacity_trigger, scenario_required_terms, late_issuance,
)


def tables(shape: str) -> str:
    """DuckDB WITH text of the assembly, which ends in the view ``defs``; ``shape``: the class signature of {0}."""
    blank = lambda c: f"nullif(trim({c}), '')"
    source = {"invoice_number": '"Invoice Number"', "issue_date": '"Issue-Date"', "doc_type": "doc_type", "scenario": '"Supply Type"', "currency": '"CURRENCY"', "buyer_trn": '"Buyer TRN"', "line_extension": '"BT-106"', "line_number": '"line_no"',
              "line_description": '"Item.Name"', "line_quantity": "qty", "line_unit": "uom", "line_net": '"line amount"', "line_tax_category": "tax_category", "line_tax_rate": '"VAT-Rate"'}
    cols = ", ".join(f"{blank(v)} AS {k}" for k, v in source.items())
    minor = lambda v, c: (f"CASE WHEN {c} IN ('AED','EUR','USD') THEN CASE WHEN regexp_matches({v}, '^[0-9]+(\\.[0-9]{{1,2}}0*)?$') THEN CAST(CAST({v} AS DECIMAL(38,9)) * 100 AS BIGINT) END "  # noqa: E731
                          f"WHEN {c} = 'BHD' THEN CASE WHEN regexp_matches({v}, '^[0-9]+(\\.[0-9]{{1,3}}0*)?$') THEN CAST(CAST({v} AS DECIMAL(38,9)) * 1000 AS BIGINT) END END")
    unit = "regexp_matches(line_unit, '^[A-Z0-9]{2,3}$')"
    known = "doc_currency IN ('AED','EUR','USD','BHD')"
    low = lambda c: f"lower(replace(replace({c}, ' ', '_'), '-', '_'))"
    types, scenes = (", ".join(f"'{x}'" for x in v) for v in (assemble.TYPES, assemble.SCENARIOS))
    tab = DUCK_WITH + ", raw AS (" + EXPORT.replace("{invoices}", "invoices").replace("{rows}", "line_rows") + f""", ), canon AS (SELECT file, row_idx, {cols} FROM raw),
acc AS (SELECT *, coalesce(invoice_number IS NOT NULL AND regexp_matches(issue_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$'), false) AS accepted FROM canon),
num AS (SELECT *, row_number() OVER w AS n, coalesce(first_value(currency) OVER w, 'AED') AS doc_currency FROM acc WINDOW w AS (PARTITION BY file, invoice_number, accepted ORDER BY row_idx)),
con AS (SELECT *, accepted AND coalesce(currency, 'AED') <> doc_currency AS conflict FROM num),
adm AS (SELECT *, accepted AND NOT conflict AND (n = 1 OR coalesce(line_net, line_description, line_quantity) IS NOT NULL) AS admitted FROM con),
lin AS (SELECT *, coalesce(TRY_CAST(line_number AS INT), row_number() OVER (PARTITION BY file, invoice_number ORDER BY row_idx)) AS line, {minor('line_net', 'doc_currency')} AS minor FROM adm WHERE admitted),
tot AS (SELECT file, invoice_number, count(*) AS n_lines, CASE WHEN count(minor) = count(*) THEN sum(minor) END AS line_sum, count(DISTINCT line_tax_rate) > 1 AS multi_rate, bool_and(line_tax_category IS NULL) AS unmapped FROM lin GROUP BY ALL),
docs AS (SELECT file, invoice_number, issue_date, doc_currency AS currency, {low("coalesce(doc_type, 'invoice')")} AS doc_type, CASE WHEN {low('scenario')} IN ({scenes}) THEN {low('scenario')} ELSE 'standard' END AS scenario, n_lines, CAST(coalesce({minor('line_extension', 'doc_currency')}, line_sum) AS BIGINT) AS line_total, multi_rate
  FROM adm JOIN tot USING (file, invoice_number) WHERE accepted AND n = 1 AND {low("coalesce(doc_type, 'invoice')")} IN ({types})),
defs AS (SELECT file, row_idx, 'parse_error' AS defect_class, NULL AS v FROM adm WHERE NOT accepted UNION ALL SELECT file, row_idx, 'currency_inconsistent', coalesce(currency, 'AED') FROM adm WHERE conflict
  UNION ALL SELECT file, row_idx, 'unit_code_freetext', line_unit FROM lin WHERE line_unit IS NOT NULL AND NOT {unit} UNION ALL SELECT file, row_idx, 'currency_inconsistent', doc_currency FROM lin WHERE line_net IS NOT NULL AND NOT ({known})
  UNION ALL SELECT file, row_idx, 'parse_error', NULL FROM lin WHERE line_number IS NOT NULL AND TRY_CAST(line_number AS INT) IS NULL
  UNION ALL SELECT file, row_idx, 'parse_error', NULL FROM adm WHERE accepted AND n = 1 AND {low('doc_type')} NOT IN ({types})
  UNION ALL SELECT file, row_idx, x.c, x.v FROM (SELECT file, row_idx, unnest(list_filter([CASE WHEN {low('scenario')} NOT IN ({scenes}) THEN {{'c': 'identifier_inconsistent', 'v': scenario}} END, CASE WHEN buyer_trn IS NULL THEN {{'c': 'trn_missing', 'v': NULL}} END, CASE WHEN unmapped THEN {{'c': 'tax_category_unmapped', 'v': NULL}} END], lambda x: x IS NOT NULL)) AS x
  FROM adm LEFT JOIN tot USING (file, invoice_number) WHERE accepted AND n = 1 AND coalesce({low('doc_type')} IN ({types}), true)))"""
    tab = tab.replace(", ), canon", "), canon")
    return tab


def oracles(found: str, shape: str) -> dict[str, str]:
    """DuckDB SQL by name; ``found`` is the WITH text that ends in the view ``found``, ``shape`` the class signature of {0}."""
    tab, unit = tables(shape), "regexp_matches(line_unit, '^[A-Z0-9]{2,3}$')"
    known = "doc_currency IN ('AED','EUR','USD','BHD')"
    present = "list_filter([" + ", ".join(f"CASE WHEN trim(CAST({c} AS VARCHAR)) <> '' THEN '{t}' END" for t, c in TERMS.items()) + "], lambda x: x IS NOT NULL)"
    lacks = lambda terms: "list_filter([" + ", ".join(f"'{t}'" for t in terms) + f"], lambda x: NOT list_contains({present}, x))"
    need = " ".join(f"WHEN {i} THEN array_to_string({lacks(terms)}, ',')" for i, terms in enumerate(gates.REQUIRED.values()))
    names = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(gates.REQUIRED))
    fails = found + ", fl AS (SELECT f.k, i.custkey, f.rule_id, sha256(concat(i.custkey, chr(31), f.rule_id, chr(31), coalesce(f.term, ''), chr(31), 'no-shape')) AS recurrence_key, CAST(i.issued AS DATE) AS occurred_at FROM found f JOIN invoices i ON f.k = i.k WHERE f.outcome = 'fail')"
    text = lambda c: f"CAST(json_array(CAST({c} AS VARCHAR)) AS VARCHAR)"
    cents = "CAST(line_sum * 100 AS BIGINT)"
    return {
        "assemble_documents": f"{tab} SELECT * FROM docs",
        "assembled_lines": f"{tab} SELECT file, row_idx, CAST(line AS INT) AS line, CASE WHEN {unit} THEN line_unit END AS unit, minor, CASE WHEN line_net IS NULL THEN 'malformed' WHEN NOT ({known}) THEN 'unknown_currency' WHEN minor IS NULL THEN 'malformed' END AS reason FROM lin",
        "assembly_defects": f"{tab} SELECT file, row_idx, defect_class FROM defs",
        "defect_register": f"{tab} SELECT file, defect_class, count(*) AS n, first({shape.format('v')} ORDER BY row_idx) AS first_class FROM defs GROUP BY file, defect_class",
        "doc_hash": f"{tab}, item AS (SELECT file, invoice_number, string_agg(concat('[', concat_ws(',', {text('line')}, {text('line_description')}, {text('line_quantity')}, {text('CASE WHEN ' + unit + ' THEN line_unit END')}, {text('minor')}, {text('line_tax_category')}), ']'), ',' ORDER BY line, row_idx) AS items FROM lin GROUP BY ALL) "
                    f"SELECT file, invoice_number, sha256(concat('[', concat_ws(',', {text('invoice_number')}, {text('d.issue_date')}, {text('d.currency')}, {text('d.doc_type')}, {text('d.scenario')}, {text('a.buyer_trn')}, {text('d.line_total')}), ',[', coalesce(items, ''), ']]')) AS doc_hash "
                    "FROM docs d JOIN (SELECT file, invoice_number, buyer_trn FROM adm WHERE accepted AND n = 1) a USING (file, invoice_number) LEFT JOIN item USING (file, invoice_number)",
        "mapping_presence": f"{DUCK_WITH} SELECT term, count(*) AS documents FROM (SELECT unnest({present}) AS term FROM invoices) GROUP BY 1",
        "mandatory_gaps": f"{DUCK_WITH} SELECT * FROM (SELECT k, array_to_string({lacks(gates.MANDATORY)}, ',') AS gaps FROM invoices) WHERE gaps <> ''",
        "mapping_gate": f"{DUCK_WITH} SELECT CASE WHEN k % 4 = 0 THEN 'unconfirmed' WHEN len({present}) < 8 THEN 'gaps' ELSE 'usable' END AS gate, count(*) AS n FROM invoices GROUP BY 1",
        "orphan_lines": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0) GROUP BY 1",
        "next_profile_version": "SELECT o_custkey, o_orderkey, CAST(coalesce(v, 0) + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS version FROM orders LEFT JOIN (SELECT o_custkey, count(*) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) USING (o_custkey) WHERE o_orderkey % 2 = 1",
        "first_errors": f"{found} SELECT rule_id, count(*) AS documents FROM (SELECT k, min(rule_id) AS rule_id FROM found WHERE severity <> 'warning' GROUP BY k) GROUP BY 1",
        "golden_check": f"{found}, g AS (SELECT i.k, list(DISTINCT f.rule_id) AS got, max(CASE f.outcome WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS r FROM invoices i LEFT JOIN found f ON i.k = f.k WHERE i.k % 47 = 0 GROUP BY 1) "
                        "SELECT k, problem FROM (SELECT k, unnest([CASE WHEN r = 1 THEN 'outcome warn' WHEN r = 0 THEN 'outcome pass' END, CASE WHEN NOT list_contains(got, 'R-040') THEN 'missing R-040' END, CASE WHEN NOT list_contains(got, 'R-041') THEN 'missing R-041' END, CASE WHEN list_contains(got, 'R-011') THEN 'forbidden R-011' END, CASE WHEN list_contains(got, 'R-018') THEN 'forbidden R-018' END]) AS problem FROM g) WHERE problem IS NOT NULL",
        "readiness_score": f"{found}, b AS (SELECT DISTINCT k, 1 AS bad FROM found WHERE outcome = 'fail'), p AS (SELECT custkey, avg(len({present}) / 8) AS a, avg(CASE WHEN len({present}) = 8 THEN 1.0 ELSE 0.0 END) AS m, count(DISTINCT root) / 2 AS s, 1 - count(bad) / count(*) AS f, CASE WHEN custkey % 2 = 0 THEN 1.0 ELSE 0.5 END AS l FROM invoices LEFT JOIN b USING (k) GROUP BY custkey), "
                           "s AS (SELECT custkey, CAST(floor(30 * a + 25 * m + 20 * s + 15 * f + 10 * l + 0.5) AS INT) AS score, (list_sort([{'g': round(30 * (1 - a), 9), 'o': 5, 'n': 'mandatory_field_coverage'}, {'g': round(25 * (1 - m), 9), 'o': 4, 'n': 'master_data_quality'}, {'g': round(20 * (1 - s), 9), 'o': 3, 'n': 'scenario_coverage'}, {'g': round(15 * (1 - f), 9), 'o': 2, 'n': 'rule_failure_rate'}, {'g': round(10 * (1 - l), 9), 'o': 1, 'n': 'lifecycle_readiness'}], 'DESC'))[1].n AS largest_gap FROM p) "
                           "SELECT custkey, score, CASE WHEN score < 40 THEN 'not_ready' WHEN score < 70 THEN 'at_risk' WHEN score < 90 THEN 'nearly_ready' ELSE 'ready' END AS band, largest_gap FROM s",
        "scenario_coverage": f"{tab}, s AS (SELECT file, list(DISTINCT scenario) AS seen FROM docs GROUP BY 1) SELECT file, round(len(list_intersect(['standard', 'zero_rated', 'export'], seen)) / 3, 4) AS ratio, array_to_string(list_sort(list_filter(['standard', 'zero_rated', 'export'], lambda x: NOT list_contains(seen, x))), ',') AS unobserved, array_to_string(list_sort(list_filter(seen, lambda x: NOT list_contains(['standard', 'zero_rated', 'export'], x))), ',') AS undeclared FROM s",
        "frozen_receivables": f"{DUCK_WITH}, b AS (SELECT currency, count(DISTINCT custkey) AS sample_size, CAST(floor(count(*) * 0.125 * (CAST(sum({cents}) AS BIGINT) // count(*)) + 0.5) AS BIGINT) AS at_risk FROM invoices GROUP BY 1) SELECT currency, at_risk, CAST(floor(at_risk * 0.7 + 0.5) AS BIGINT) AS frozen, CASE WHEN sample_size >= 40 THEN 'corpus' ELSE 'estimate' END AS basis, sample_size FROM b",
        "ap_match": f"{DUCK_WITH}, i AS (SELECT k AS s, k // 2 AS num, custkey, {cents} AS p, n_lines AS q FROM invoices), b AS (SELECT * FROM i WHERE s % 2 = 0), a AS (SELECT * FROM i UNION ALL SELECT -s, num, custkey, p, q FROM b WHERE s % 34 = 0), c AS (SELECT *, row_number() OVER (PARTITION BY custkey, num, p ORDER BY s) > 1 AS dup FROM a), "
                    "o AS (SELECT custkey, num, p + CASE WHEN s % 22 = 0 THEN 100 ELSE 0 END AS amount FROM b WHERE s % 14 <> 0), r AS (SELECT custkey, num, q - CASE WHEN s % 18 = 0 THEN 1 ELSE 0 END AS received FROM b WHERE s % 6 = 0) "
                    "SELECT CASE WHEN dup THEN 'duplicate' WHEN amount IS NULL THEN 'no_po' WHEN p <> amount THEN 'price_variance' WHEN received IS NULL THEN 'matched_2way' WHEN received <> q THEN 'qty_variance' ELSE 'matched_3way' END AS state, count(*) AS n FROM c LEFT JOIN o USING (custkey, num) LEFT JOIN r USING (custkey, num) GROUP BY 1",
        "trading_edges": "SELECT concat(a.n_name, '>', b.n_name) AS jurisdiction_pair, count(DISTINCT (l_suppkey, o_custkey)) AS edges, count(*) AS documents FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey GROUP BY 1",
        "deadline_breach": f"SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '{AS_OF}' > o_orderdate + INTERVAL 30 DAY ELSE o_orderkey % 40 > 30 END) AS breached FROM orders GROUP BY 1",
        "exception_queue": f"{fails} SELECT recurrence_key, count(DISTINCT k) AS documents, min(occurred_at) AS first_seen, min(occurred_at) + 14 < DATE '{AS_OF}' AS overdue FROM fl GROUP BY 1",
        "recurrence_after_fix": f"{fails} SELECT recurrence_key, min(occurred_at) + 30 AS resolved_at, max(occurred_at) > min(occurred_at) + 30 AS recurred FROM fl GROUP BY 1",
        "recurrence_stats": f"{fails} SELECT rule_id, count(*) AS occurrences, count(DISTINCT custkey) AS entities, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen FROM fl GROUP BY 1 HAVING count(DISTINCT custkey) >= 3",
        "divergence_magnitude": f"{DUCK_WITH}, r AS (SELECT CAST(k % 100 AS DOUBLE) / nullif(CAST(line_sum AS DOUBLE), 0) AS r FROM invoices) SELECT CASE WHEN r < 0.001 THEN '<0.1%' WHEN r < 0.01 THEN '0.1-1%' WHEN r < 0.05 THEN '1-5%' WHEN r >= 0.05 THEN '>5%' END AS bucket, count(*) AS n FROM r GROUP BY 1",
        "revenue_mix": f"{DUCK_WITH} SELECT strftime(issued, '%Y-%m') AS month, CAST(sum(line_sum) AS DOUBLE) AS billed, CAST(coalesce(sum(line_sum) FILTER (WHERE root = 'Invoice'), 0) AS DOUBLE) AS collected, CAST(coalesce(sum(line_sum) FILTER (WHERE order_ref IS NOT NULL), 0) AS DOUBLE) AS recurring FROM invoices GROUP BY 1",
        "capacity_trigger": "WITH w AS (SELECT l_suppkey AS supplier, CAST(floor((CAST(l_shipdate AS DATE) - DATE '1970-01-05') / 7) AS INT) AS week, sum(l_quantity) AS used FROM lineitem GROUP BY ALL), b AS (SELECT *, week - row_number() OVER (PARTITION BY supplier ORDER BY week) AS g FROM w WHERE used > 0.7 * 50.0) SELECT supplier, min(week) AS from_week, count(*) AS weeks FROM b GROUP BY supplier, g HAVING count(*) >= 3",
        "scenario_required_terms": f"{DUCK_WITH} SELECT k, CASE k % 4 {names} END AS scenario, CASE k % 4 {need} END AS missing FROM invoices",
        "late_issuance": "SELECT o_orderkey AS k FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE CAST(r AS DATE) - CAST(o_orderdate AS DATE) > 14",
    }
