"""Registered queries over the given tables, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit_queries, file_queries, ordered_queries, run_queries, stream_queries
from .functions.hashing import line_bucket, recurrence_key
from .functions.money import minor_to_decimal, to_minor
from .functions.shape import charset, holds_raw, regex_class
from .operators import audit
from .operators.evaluate import by_rule, row_findings, row_outcomes
from .plans.rules import ALL, DEFAULT, Rule
from .sources.codelists import LISTS
from .sources.fixtures import DUCK_WITH, invoice_rows, invoices

Query = Callable[[SparkSession, str], DataFrame]


def _found(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return row_findings(invoice_rows(spark, d), keep=keep)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def findings_by_rule(spark: SparkSession, d: str) -> DataFrame:
    return by_rule(_found(spark, d))


def findings_by_class(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).groupBy("failure_class", "outcome").agg(F.count(F.lit(1)).alias("n"))


def doc_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return row_outcomes(invoice_rows(spark, d)).groupBy("outcome").agg(F.count(F.lit(1)).alias("documents"))


def value_shapes(spark: SparkSession, d: str) -> DataFrame:
    docs = invoices(spark, d)
    v = docs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("id", "issue_date", "buyer_trn", "line_total")])).alias("x")).select("x.*")
    v = v.unionByName(_table(spark, d, "pages").select(F.lit("url").alias("field"), F.col("url").alias("v")))
    shaped = v.select("field", F.length("v").alias("len"), charset(F.col("v")).alias("charset"), regex_class(F.col("v")).alias("regex_class"))
    return shaped.groupBy("field", "len", "charset", "regex_class").agg(F.count(F.lit(1)).alias("n"))


def pii_scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").where(holds_raw(F.col("text"))).select("doc_id")


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    return invoice_rows(spark, d).select("k", "line", "currency", "amount", to_minor(F.col("amount"), F.col("currency")).alias("m"))


def to_minor_lines(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d).select("k", "line", "m.minor", "m.reason")


def minor_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    back = minor_to_decimal(F.col("m.minor"), F.col("currency"))
    same = back.cast("decimal(38,3)") == F.col("amount").cast("decimal(38,3)")
    return _scaled(spark, d).groupBy("currency").agg(F.count(F.lit(1)).alias("lines"), F.count_if(same).alias("same"))


def line_buckets(spark: SparkSession, d: str) -> DataFrame:
    return invoices(spark, d).groupBy(line_bucket(F.col("n_lines")).alias("bucket")).agg(F.count(F.lit(1)).alias("documents"))


def recurrence_keys(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d, "custkey")
    key = recurrence_key(F.col("custkey").cast("string"), F.col("rule_id"), F.col("term"), F.col("shape.regex_class"))
    each = found.groupBy("k", key.alias("recurrence_key")).agg(F.count(F.lit(1)).alias("n"))  # a document's findings are together: no exchange
    return each.groupBy("recurrence_key").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("documents"))


def supplier_readiness(spark: SparkSession, d: str) -> DataFrame:
    rows = invoice_rows(spark, d)
    return audit.supplier_readiness(row_findings(rows, keep=("custkey", "issued")), rows.where("line = 1"), "custkey", "issued")


def reconcile_ledger(spark: SparkSession, d: str) -> DataFrame:
    cents = (F.col("line_sum") * 100).cast("long")
    docs = invoices(spark, d).select(F.col("k").alias("ref"), cents.alias("amount"))
    shift = F.when(F.col("ref") % 11 == 0, 1).when(F.col("ref") % 17 == 0, 500).otherwise(0)
    ledger = docs.where("ref % 13 <> 0").select(F.when(F.col("ref") % 19 == 0, -F.col("ref")).otherwise(F.col("ref")).alias("ref"), (F.col("amount") + shift).alias("amount"))
    return audit.reconcile(ledger, docs)


def catalogue_diff(spark: SparkSession, d: str) -> DataFrame:
    part = _table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), "p_name")
    old = part.where("rule_id % 11 <> 0").select("rule_id", F.sha2("p_name", 256).alias("text_hash"))
    text = F.when(F.col("rule_id") % 7 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    return audit.catalogue_diff(old, part.where("rule_id % 13 <> 0").select("rule_id", F.sha2(text, 256).alias("text_hash")))


def latest_profile(spark: SparkSession, d: str) -> DataFrame:
    return audit.latest(_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


def retention_purge(spark: SparkSession, d: str) -> DataFrame:
    orders = _table(spark, d, "orders").withColumn("expires_at", F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    return audit.retention(orders, "expires_at", F.to_timestamp(F.lit("1996-01-01")))


def file_dedup_ttl(spark: SparkSession, d: str) -> DataFrame:
    return audit.ttl_dedup(_table(spark, d, "events"), ["user_id", "event_type"], "ts", 5)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        findings_by_rule, findings_by_class, doc_outcomes, value_shapes, pii_scan_documents, to_minor_lines, minor_roundtrip, line_buckets,
        recurrence_keys, supplier_readiness, reconcile_ledger, catalogue_diff, latest_profile, retention_purge, file_dedup_ttl, *audit_queries.QUERIES, *run_queries.QUERIES, *ordered_queries.QUERIES, *stream_queries.QUERIES, *file_queries.QUERIES,
    )}


def _ns(c: str) -> str:
    return f"coalesce(trim(regexp_replace({c}, '[ \\t\\r\\n]+', ' ', 'g')), '')"


_DATE = "(regexp_matches({0}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND TRY_CAST({0} AS DATE) IS NOT NULL)"
_BAD_TRN = "({0} <> '' AND NOT regexp_matches({0}, '^[0-9]{{15}}$'))"
_DEC = "CAST({0} AS DECIMAL(38,9))"
_UNLISTED = {x.list_id: "NOT IN (" + ", ".join(f"'{c}'" for c in x.codes) + ")" for x in LISTS.values()}
#: When each rule fires, in SQL.
FIRES = {
    "R-001": f"{_ns('id')} = ''", "R-002": f"{_ns('issue_date')} = ''", "R-003": f"{_ns('issue_date')} <> '' AND NOT {_DATE.format('issue_date')}", "R-004": f"{_ns('type_code')} = ''",
    "R-005": f"type_code {_UNLISTED['UNCL1001']}", "R-006": "NOT regexp_matches(coalesce(currency, ''), '^[A-Z]{3}$')",
    "R-007": f"regexp_matches(currency, '^[A-Z]{{3}}$') AND currency {_UNLISTED['ISO4217']}",
    "R-008": f"{_ns('seller_name')} = ''", "R-009": f"{_ns('buyer_name')} = ''", "R-010": "n_lines < 1", "R-011": f"{_DEC.format('line_total')} <> line_sum",
    "R-012": f"{_DEC.format('tax_inclusive')} <> {_DEC.format('tax_exclusive')} + {_DEC.format('tax_total')}", "R-013": f"{_ns('payable')} = ''",
    "R-014": "NOT regexp_matches(line_total, '^-?[0-9]+(\\.[0-9]{1,2})?$')", "R-015": "NOT regexp_matches(tax_total, '^-?[0-9]+(\\.[0-9]{1,2})?$')",
    "R-016": f"{_ns('amount')} = ''", "R-017": f"{_ns('tax_category')} = ''", "R-018": f"{_ns('tax_category')} <> '' AND tax_category NOT IN ('AE', 'E', 'G', 'K', 'L', 'M', 'O', 'S', 'Z')",
    "R-019": "unit IS NOT NULL AND NOT regexp_matches(unit, '^[A-Z0-9]{1,3}$')", "R-020": f"regexp_matches(coalesce(unit, ''), '^[A-Z0-9]{{1,3}}$') AND unit {_UNLISTED['UNECE_REC20']}",
    "R-021": f"{_ns('item_name')} = ''", "R-022": f"root = 'CreditNote' AND {_ns('predecessor_ref')} = ''",
    "R-023": f"{_DATE.format('issue_date')} AND {_DATE.format('due_date')} AND TRY_CAST(due_date AS DATE) < TRY_CAST(issue_date AS DATE)",
    "R-024": f"{_ns('tax_category')} <> '' AND tax_category NOT IN ('AE', 'E', 'G', 'K', 'L', 'M', 'O', 'S', 'Z')",
    "R-025": f"payable <> '' AND TRY_CAST(payable AS DECIMAL(38,9)) <> {_DEC.format('tax_inclusive')}", "R-026": "NOT regexp_matches(seller_country, '^[A-Z]{2}$')",
    "R-040": f"{_ns('seller_trn')} = ''", "R-041": f"{_ns('buyer_trn')} = ''", "R-042": _BAD_TRN.format(_ns("buyer_trn")), "R-043": _BAD_TRN.format(_ns("seller_trn")),
    "R-044": f"{_ns('customization_id')} = ''", "R-045": f"{_ns('buyer_country')} = ''", "R-060": f"{_ns('customization_id')} = ''", "R-061": f"{_ns('profile_id')} = ''", "R-062": f"{_ns('order_ref')} = ''",
}
_FROM = {"document": "invoices", "line": "line_rows", "subtotal": "(SELECT DISTINCT k, tax_category FROM line_rows)"}
_TEXT = lambda v: "NULL" if v is None else f"'{v}'"
_RUNS = "regexp_extract_all({0}, '[0-9]+|[A-Z]+|[a-z]+|\\s+|[^A-Za-z0-9\\s]+')"
_CLASS = (
    "CASE WHEN {0} IS NULL OR {0} = '' THEN NULL WHEN len(" + _RUNS + ") > 12 THEN concat('[\\s\\S]{{', length({0}), '}}') ELSE array_to_string(list_transform(" + _RUNS + ", lambda r: concat("
    "CASE WHEN regexp_matches(r, '^[0-9]') THEN '[0-9]' WHEN regexp_matches(r, '^[A-Z]') THEN '[A-Z]' WHEN regexp_matches(r, '^[a-z]') THEN '[a-z]' WHEN regexp_matches(r, '^\\s') THEN '\\s' ELSE '[^A-Za-z0-9]' END, '{{', length(r), '}}')), '') END"
)
def _found_by(rules: list[Rule]) -> str:
    return DUCK_WITH + ", found AS (" + " UNION ALL ".join(
        f"SELECT k, {'line' if r.grain == 'line' else '0'} AS node, '{r.id}' AS rule_id, '{r.severity}' AS severity, {_TEXT(r.term)} AS term, '{r.failure}' AS failure_class, '{'warn' if r.severity == 'warning' else 'fail'}' AS outcome, "
        f"{'CAST(NULL AS VARCHAR)' if r.value in (None, 'buyer_ref') else f'CAST({r.value} AS VARCHAR)'} AS v FROM {_FROM[r.grain]} WHERE {FIRES[r.id]}" for r in rules
    ) + ")"


_FOUND = _found_by(DEFAULT)
#: The raw-value patterns for an engine whose \\w, \\d and \\b know ASCII alone.
_W, _D = r"\p{L}\p{M}\p{N}\p{Pc}", r"\p{Nd}"
_RAW = (rf"(^|[^{_W}]){_D}{{15}}($|[^{_W}])", rf"[A-Z]{{2}}{_D}{{2}}[A-Z0-9]{{11,30}}", rf"(^|[^{_W}]|[.+-])[{_W}.+-]*[{_W}]@[{_W}-]+\.[{_W}.]*[{_W}]")
_CENTS = "CAST(line_sum * 100 AS BIGINT)"
_SCALED = DUCK_WITH + """, scaled AS (SELECT l.k, l.line, i.currency, l.amount, CASE WHEN upper(i.currency) IN ('AED','EUR','GBP','INR','PLN','SAR','USD') THEN CAST(l.net * 100 AS BIGINT) WHEN upper(i.currency) IN ('BHD','OMR') THEN CAST(l.net * 1000 AS BIGINT) END AS minor
FROM line_rows l JOIN invoices i ON l.k = i.k)"""


def oracle_sql() -> dict[str, str]:
    fields = " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS v FROM invoices" for c in ("id", "issue_date", "buyer_trn", "line_total"))
    return audit_queries.oracles(_FOUND, _CLASS) | run_queries.oracles(_FOUND, _CLASS, _found_by(ALL), audit_queries.tables(_CLASS)) | ordered_queries.oracles(FIRES, _CLASS) | stream_queries.oracles() | file_queries.oracles() | {
        "findings_by_rule": f"{_FOUND} SELECT rule_id, severity, term, failure_class, count(*) AS findings, count(DISTINCT k) AS documents FROM found GROUP BY ALL",
        "findings_by_class": f"{_FOUND} SELECT failure_class, outcome, count(*) AS n FROM found GROUP BY ALL",
        "doc_outcomes": f"{_FOUND}, w AS (SELECT k, max(CASE outcome WHEN 'fail' THEN 2 ELSE 1 END) AS r FROM found GROUP BY k) SELECT CASE r WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS outcome, count(*) AS documents FROM invoices LEFT JOIN w USING (k) GROUP BY 1",
        "value_shapes": f"{DUCK_WITH}, f AS ({fields} UNION ALL SELECT 'url', url FROM pages) SELECT field, CAST(length(v) AS INT) AS len, CASE WHEN v IS NULL THEN NULL WHEN v = '' THEN 'empty' WHEN regexp_matches(v, '^[0-9]+$') THEN 'numeric' WHEN regexp_matches(v, '^[A-Za-z]+$') THEN 'alpha' WHEN regexp_matches(v, '^[A-Za-z0-9]+$') THEN 'alnum' ELSE 'mixed' END AS charset, {_CLASS.format('v')} AS regex_class, count(*) AS n FROM f GROUP BY ALL",
        "pii_scan_documents": f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{_RAW[0]}') OR regexp_matches(text, '{_RAW[1]}') OR regexp_matches(text, '{_RAW[2]}')",
        "to_minor_lines": f"{_SCALED} SELECT k, line, minor, CASE WHEN minor IS NULL THEN 'unknown_currency' END AS reason FROM scaled",
        "minor_roundtrip": f"{_SCALED} SELECT currency, count(*) AS lines, count(minor) AS same FROM scaled GROUP BY 1",
        "line_buckets": f"{DUCK_WITH} SELECT CASE WHEN n_lines <= 1 THEN '1' WHEN n_lines <= 5 THEN '2-5' WHEN n_lines <= 20 THEN '6-20' WHEN n_lines <= 100 THEN '21-100' ELSE '100+' END AS bucket, count(*) AS documents FROM invoices GROUP BY 1",
        "recurrence_keys": f"{_FOUND} SELECT sha256(concat(custkey, chr(31), rule_id, chr(31), coalesce(term, ''), chr(31), coalesce({_CLASS.format('v')}, 'no-shape'))) AS recurrence_key, count(*) AS occurrences, count(DISTINCT k) AS documents FROM found JOIN (SELECT k, custkey FROM invoices) USING (k) GROUP BY 1",
        "supplier_readiness": f"{_FOUND}, f AS (SELECT custkey, k, rule_id, issued FROM found JOIN (SELECT k, custkey, issued FROM invoices) USING (k) WHERE outcome = 'fail'), u AS (SELECT custkey, rule_id, count(*) AS m FROM f GROUP BY ALL), t AS (SELECT custkey, rule_id, row_number() OVER (PARTITION BY custkey ORDER BY m DESC, rule_id) AS n FROM u), g AS (SELECT custkey, count(DISTINCT k) AS failed, max(issued) AS last_breach FROM f GROUP BY 1), d AS (SELECT custkey, count(*) AS documents FROM invoices GROUP BY 1) SELECT custkey, documents, round(coalesce(failed, 0) / documents, 4) AS fail_rate, rule_id AS top_rule, last_breach FROM d LEFT JOIN g USING (custkey) LEFT JOIN (SELECT custkey, rule_id FROM t WHERE n = 1) USING (custkey)",
        "reconcile_ledger": f"{DUCK_WITH}, i AS (SELECT k AS ref, {_CENTS} AS a FROM invoices), l AS (SELECT CASE WHEN ref % 19 = 0 THEN -ref ELSE ref END AS ref, a + CASE WHEN ref % 11 = 0 THEN 1 WHEN ref % 17 = 0 THEN 500 ELSE 0 END AS b FROM i WHERE ref % 13 <> 0) SELECT ref, CASE WHEN b IS NULL THEN 'invoice_not_in_ledger' WHEN a IS NULL THEN 'ledger_not_in_invoice' WHEN abs(a - b) = 1 THEN 'rounding_drift' ELSE 'amount_mismatch' END AS divergence FROM i FULL JOIN l USING (ref) WHERE a IS NULL OR b IS NULL OR a <> b",
        "catalogue_diff": "WITH o AS (SELECT p_partkey AS rule_id, sha256(p_name) AS h FROM part WHERE p_partkey % 11 <> 0), n AS (SELECT p_partkey AS rule_id, sha256(CASE WHEN p_partkey % 7 = 0 THEN concat(p_name, '!') ELSE p_name END) AS g FROM part WHERE p_partkey % 13 <> 0) SELECT rule_id, CASE WHEN h IS NULL THEN 'added' WHEN g IS NULL THEN 'removed' WHEN h <> g THEN 'changed' ELSE 'same' END AS state FROM o FULL JOIN n USING (rule_id)",
        "latest_profile": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1",
        "file_dedup_ttl": "WITH RECURSIVE s AS (SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY ALL UNION ALL SELECT s.user_id, s.event_type, min(e.ts) FROM s JOIN events e ON e.user_id = s.user_id AND e.event_type = s.event_type AND e.ts >= s.t + INTERVAL 5 DAY GROUP BY ALL) "
                          "SELECT user_id, event_type, CAST(n AS INT) AS arrivals, CAST(stored AS INT) AS stored FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) JOIN (SELECT user_id, event_type, count(*) AS stored FROM s GROUP BY ALL) USING (user_id, event_type)",
        "retention_purge": "SELECT count(*) FILTER (WHERE o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1996-01-01') AS kept, count(*) FILTER (WHERE NOT o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1996-01-01') AS purged FROM orders",
    }
