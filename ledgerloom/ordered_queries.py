"""Queries by patterns: findings in order and cut, claims, tallies and fates, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ordered
from .operators.evaluate import row_grains, with_first
from .plans.patterns import Context, Pattern, patterns
from .plans.rules import ALL, pack
from .sources.fixtures import DUCK_WITH, invoice_rows

#: Only invoices follow the plain profile here, so that it has no element for the rules of credit notes.
PROFILE = "CASE WHEN k % 3 = 0 AND root = 'Invoice' THEN 'en16931' ELSE 'pint-ae' END"
USABLE = ("en16931", "pint-ae")
#: Contexts that compete for lines; a line without a tax category leaves the first undecided.
COMPETING = (
    Pattern("units", (
        Context("standard line", "line", ("R-019", "R-020"), lambda: F.col("tax_category") == "S"), Context("credited line", "line", ("R-021",), lambda: F.col("root") == "CreditNote"), Context("other line", "line", ("R-016", "R-017")),
    )),
    Pattern("categories", (Context("odd line", "line", ("R-018",), lambda: F.col("line") % 2 == 1),)),
)


def _in_order(spark: SparkSession, d: str, **options) -> DataFrame:
    found = ordered.row_findings_in_order(invoice_rows(spark, d), patterns("pint-ae"), pack("pint-ae"), **options)
    return found.select("k", "ordinal", "node", "rule_id", "outcome", F.col("shape.regex_class").alias("regex_class"))


def findings_in_order(spark: SparkSession, d: str) -> DataFrame:
    return _in_order(spark, d)


def findings_until_error(spark: SparkSession, d: str) -> DataFrame:
    """Up to the first error of each document, with the warnings before it."""
    return _in_order(spark, d, stop_on_first_error=True)


def errors_until_error(spark: SparkSession, d: str) -> DataFrame:
    return _in_order(spark, d, include_warnings=False, stop_on_first_error=True)


def competing_contexts(spark: SparkSession, d: str) -> DataFrame:
    """What each rule says in the context that claims a line, by kind of document."""
    placed = {r for p in COMPETING for c in p.contexts for r in c.rules}
    return ordered.tallies(with_first(invoice_rows(spark, d), "k"), COMPETING, [r for r in ALL if r.id in placed], row_grains(), "root")


def claimed_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the competing contexts in order, those without a verdict among them."""
    placed = {r for p in COMPETING for c in p.contexts for r in c.rules}
    found = ordered.row_findings_in_order(invoice_rows(spark, d), COMPETING, [r for r in ALL if r.id in placed])
    return found.select("k", "ordinal", "node", "rule_id", "outcome")


def rule_fates(spark: SparkSession, d: str) -> DataFrame:
    rows = with_first(invoice_rows(spark, d), "k").withColumn("profile", F.expr(PROFILE))
    tally = ordered.tallies(rows, patterns("pint-ae"), pack("pint-ae"), row_grains(), "profile")
    members = spark.createDataFrame([(p, r.id) for p in USABLE for r in pack(p)], "profile string, rule_id string")
    return ordered.fates(tally, members)


QUERIES = (findings_in_order, findings_until_error, errors_until_error, competing_contexts, claimed_findings, rule_fates)


def oracles(fires: dict[str, str], shape: str) -> dict[str, str]:
    """fires: when each rule fires, in SQL; shape: the class signature of {0}."""
    rules = {r.id: r for r in ALL}
    source = {
        "document": "(SELECT *, 0 AS node FROM doc)", "line": "(SELECT l.*, d.root, d.profile, l.line AS node FROM line_rows l JOIN doc d ON d.k = l.k)",
        "subtotal": "(SELECT s.*, d.root, d.profile FROM (SELECT k, tax_category, min(line) AS node FROM line_rows GROUP BY ALL) s JOIN doc d ON d.k = s.k)",
    }
    base = f"{DUCK_WITH}, doc AS (SELECT *, {PROFILE} AS profile FROM invoices)"
    value = lambda r: "CAST(NULL AS VARCHAR)" if rules[r].value in (None, "buyer_ref") else f"CAST({rules[r].value} AS VARCHAR)"
    condition = {"credit note": "root = 'CreditNote'"}
    placed = [(i, c, r) for i, c in enumerate(c for p in patterns("pint-ae") for c in p.contexts) for r in c.rules]
    order = {r: n for n, (_, _, r) in enumerate(placed)}
    found = base + ", found AS (" + " UNION ALL ".join(
        f"SELECT k, node, {i} AS place, {order[r]} AS n, '{r}' AS rule_id, '{rules[r].severity}' AS severity, {value(r)} AS v FROM {source[c.grain]} WHERE ({condition.get(c.name, 'true')}) AND ({fires[r]})" for i, c, r in placed
    ) + "), before AS (SELECT *, coalesce(max(CASE WHEN severity <> 'warning' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY place, node, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM found)"
    last = f"SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY place, node, n) AS INT) AS ordinal, CAST(node AS INT) AS node, rule_id, CASE severity WHEN 'warning' THEN 'warn' ELSE 'fail' END AS outcome, {shape.format('v')} AS regex_class FROM before"

    # who claims a line: 1 standard, 2 credited, 3 other; NULL where the category, and with it the first context, is unknown
    lines = f"{base}, l AS (SELECT l.*, d.root FROM line_rows l JOIN doc d ON d.k = l.k), c AS (SELECT *, tax_category IS NULL AS unsure, CASE WHEN tax_category = 'S' THEN 1 WHEN root = 'CreditNote' THEN 2 ELSE 3 END AS who FROM l)"
    # an undecided first context leaves the later ones that match undecided, too
    who = {"R-019": ("who = 1 AND NOT unsure", "unsure", "standard line", 0), "R-020": ("who = 1 AND NOT unsure", "unsure", "standard line", 1), "R-021": ("who = 2 AND NOT unsure", "unsure AND root = 'CreditNote'", "credited line", 2),
           "R-016": ("who = 3 AND NOT unsure", "unsure", "other line", 3), "R-017": ("who = 3 AND NOT unsure", "unsure", "other line", 4), "R-018": ("line % 2 = 1", "false", "odd line", 5)}
    group = {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 3}
    fails = lambda r: f"coalesce({fires[r]}, false)"
    return {
        "findings_in_order": f"{found} {last}",
        "findings_until_error": f"{found} {last} WHERE over_ = 0",
        "errors_until_error": f"{found} {last} WHERE over_ = 0 AND severity <> 'warning'",
        "competing_contexts": f"{lines} " + " UNION ALL ".join(
            f"SELECT root, '{'categories' if n == 5 else 'units'}' AS pattern, '{name}' AS context, '{r}' AS rule_id, count(*) FILTER (WHERE {hit} AND NOT {fails(r)}) AS holds, count(*) FILTER (WHERE {hit} AND {fails(r)}) AS fails, CAST(0 AS BIGINT) AS no_verdict, count(*) FILTER (WHERE {unsure}) AS undetermined FROM c GROUP BY root"
            for r, (hit, unsure, name, n) in who.items()
        ),
        "claimed_findings": f"{lines}, f AS (" + " UNION ALL ".join(
            f"SELECT k, line AS node, {group[n]} AS place, {n} AS n, '{r}' AS rule_id, CASE WHEN {unsure} THEN 'no_verdict' ELSE '{'warn' if rules[r].severity == 'warning' else 'fail'}' END AS outcome FROM c WHERE ({unsure}) OR ({hit} AND {fails(r)})" for r, (hit, unsure, _, n) in who.items()
        ) + ") SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY place, node, n) AS INT) AS ordinal, node, rule_id, outcome FROM f",
        "rule_fates": base + ", t AS (" + " UNION ALL ".join(
            f"SELECT profile, '{r}' AS rule_id, count(*) AS judged, count(*) FILTER (WHERE {fires[r]}) AS fails FROM {source[c.grain]} WHERE {condition.get(c.name, 'true')} GROUP BY profile" for _, c, r in placed
        ) + "), member AS (" + " UNION ALL ".join(f"SELECT '{p}' AS profile, '{r.id}' AS rule_id" for p in USABLE for r in pack(p)) + "), f AS (SELECT m.profile, coalesce(t.judged, 0) AS judged, coalesce(t.fails, 0) AS fails FROM member m LEFT JOIN t ON t.profile = m.profile AND t.rule_id = m.rule_id WHERE m.profile IN (SELECT profile FROM doc)) "
        "SELECT coalesce(profile, 'TOTAL') AS profile, count(*) AS declared, count(*) FILTER (WHERE fails > 0) AS fired, count(*) FILTER (WHERE judged > 0 AND fails = 0) AS always_true, count(*) FILTER (WHERE judged = 0) AS absent, CAST(0 AS BIGINT) AS undetermined, CAST(0 AS BIGINT) AS unreachable FROM f GROUP BY ROLLUP (profile)",
    }
