"""Evaluation by patterns: contexts claim elements, findings have an order, and rules are counted without exploding.

Rows are judged elements, or lines that stand for their document and subtotal as well (``applies`` tells which grains a
row has). Everything is one pass over them; the order and its cut need one exchange by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shape import message, value_shape
from ..plans.patterns import Context, Pattern, check_patterns
from ..plans.rules import Rule
from .evaluate import explode_codes, row_grains, rule_table, value_columns, value_of, with_first

FIRED, UNKNOWN, UNDETERMINED = 1, 2, 3


def claims(of: tuple[Pattern, ...], applies: dict[str, Column]) -> list[tuple[Pattern, Context, Column, Column]]:
    """For each context whether it claims the row's element, and whether that cannot be told: a context that is NULL leaves
    open who claims, so that no later context of its pattern claims either."""
    out = []
    for p in of:
        taken = {grain: F.lit(False) for grain in applies}
        unsure = {grain: F.lit(False) for grain in applies}
        for c in p.contexts:
            if c.grain not in applies:
                continue
            match, free = c.matches(), applies[c.grain] & ~taken[c.grain]
            yes, open_ = F.coalesce(match, F.lit(False)), match.isNull()
            out.append((p, c, free & yes & ~unsure[c.grain], free & (open_ | (yes & unsure[c.grain]))))
            unsure[c.grain] = unsure[c.grain] | open_
            taken[c.grain] = taken[c.grain] | (yes & ~unsure[c.grain])
    return out


def _judged(of: tuple[Pattern, ...], rules: list[Rule], applies: dict[str, Column]) -> list[tuple[int, Rule, Column, Column, Column]]:
    """Context number, rule, claimed, undetermined and holds, in order."""
    check_patterns(of, rules)
    known = {r.id: r for r in rules}
    return [(i, known[r], claimed, unsure, known[r].satisfied()) for i, (_, c, claimed, unsure) in enumerate(claims(of, applies)) for r in c.rules]


def ordered_findings(rows: DataFrame, of: tuple[Pattern, ...], rules: list[Rule], applies: dict[str, Column], key: str = "k", node: Column | None = None, keep: tuple[str, ...] = (), include_warnings: bool = True, stop_on_first_error: bool = False) -> DataFrame:
    """Findings of each document in the order of patterns, contexts, elements and rules: key, ``keep``, ordinal (from 1), node,
    grain, rule_id, severity, term, failure_class, outcome, shape, message.

    With ``stop_on_first_error`` a document's findings end with its first fatal, error or missing verdict; warnings before it stay
    unless ``include_warnings`` is off. A rule without an answer, or in a context that cannot be decided, is ``no_verdict``."""
    judged = _judged(of, rules, applies)
    values = sorted({r.value for _, r, *_ in judged if r.value})
    table = rule_table([r for _, r, *_ in judged], values, place=[place for place, *_ in judged])
    codes = [F.when(unsure, n * 4 + UNDETERMINED).when(claimed & holds.isNull(), n * 4 + UNKNOWN).when(claimed & ~holds, n * 4 + FIRED) for n, (_, _, claimed, unsure, holds) in enumerate(judged)]
    node = F.col("line") if node is None else node
    hit = explode_codes(rows.select(key, *keep, node.cast("int").alias("__node"), *value_columns(values), F.array(*codes).alias("__codes")))
    hit = hit.withColumn("__rule", F.element_at(table, F.floor(F.col("__code") / 4).cast("int") + 1))
    r = F.col("__rule")
    lost = F.col("__code") % 4 != FIRED
    outcome = F.when(lost, "no_verdict").when(r["severity"] == "warning", "warn").otherwise("fail")
    place = F.when(r["grain"] == "document", 0).otherwise(F.col("__node"))
    if not include_warnings:
        hit = hit.where(lost | (r["severity"] != "warning"))
    order = Window.partitionBy(key).orderBy(r["place"], place, "__code")
    if stop_on_first_error:
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        hit = hit.withColumn("__over", F.max(lost | (r["severity"] != "warning")).over(before)).where(~F.coalesce("__over", F.lit(False)))
    hit = hit.withColumn("ordinal", F.row_number().over(order))
    hit = hit.withColumn("__value", value_of(values, r["value"]))
    value = F.col("__value")
    return hit.select(
        key, *keep, "ordinal", place.alias("node"), r["grain"].alias("grain"), r["rule_id"].alias("rule_id"), r["severity"].alias("severity"), r["term"].alias("term"), r["failure_class"].alias("failure_class"),
        outcome.alias("outcome"), value_shape(value).alias("shape"), message(r["expected"], value).alias("message"),
    )


def row_findings_in_order(rows: DataFrame, of: tuple[Pattern, ...], rules: list[Rule], key: str = "k", **options) -> DataFrame:
    """``ordered_findings`` of lines that carry their document's fields; a subtotal's place is the first line of its category."""
    return ordered_findings(with_first(rows, key), of, rules, row_grains(), key, **options)


def tallies(rows: DataFrame, of: tuple[Pattern, ...], rules: list[Rule], applies: dict[str, Column], by: str) -> DataFrame:
    """Of each ``by`` and rule: pattern, context, and the elements at which it holds, fails, has no_verdict or is undetermined.
    Counted as columns of one aggregate, which tasks combine before the exchange; no finding is made."""
    judged = _judged(of, rules, applies)
    names = [(p.name, c.name) for p, c, *_ in claims(of, applies)]
    counts, rows_of = [], []
    for n, (place, r, claimed, unsure, holds) in enumerate(judged):
        parts = {"holds": claimed & holds, "fails": claimed & ~holds, "no_verdict": claimed & holds.isNull(), "undetermined": unsure}
        counts += [F.count_if(c).alias(f"__{n}_{name}") for name, c in parts.items()]
        rows_of.append(F.struct(F.lit(names[place][0]).alias("pattern"), F.lit(names[place][1]).alias("context"), F.lit(r.id).alias("rule_id"), *(F.col(f"__{n}_{name}").alias(name) for name in parts)))
    return rows.groupBy(by).agg(*counts).select(by, F.explode(F.array(*rows_of)).alias("x")).select(by, "x.*")


def fates(tally: DataFrame, members: DataFrame, by: str = "profile", unreachable: dict[str, set[str]] | None = None) -> DataFrame:
    """Rules of each ``by`` by fate, with a TOTAL row: declared, fired (false somewhere), always_true (judged somewhere, never false),
    undetermined (never judged, and some context could not be decided), absent (its context never occurred) and unreachable
    (those of the absent that ``unreachable`` names as proven). members: ``by`` and rule_id of the rules that each has; one
    that judged no document is left out."""
    proven = F.lit(False)
    for name, ids in (unreachable or {}).items():
        proven = proven | ((F.col(by) == name) & F.col("rule_id").isin(*ids))
    there = tally.join(F.broadcast(members), [by, "rule_id"])
    judged, fired = F.col("holds") + F.col("fails") + F.col("no_verdict") > 0, F.col("fails") > 0
    kind = F.when(fired, "fired").when(judged, "always_true").when(F.col("undetermined") > 0, "undetermined").otherwise("absent")
    each = there.select(by, kind.alias("kind"), proven.alias("proven"))
    sums = [F.count_if(F.col("kind") == x).alias(x) for x in ("fired", "always_true", "absent", "undetermined")]
    out = each.rollup(by).agg(F.count(F.lit(1)).alias("declared"), *sums, F.count_if((F.col("kind") == "absent") & F.col("proven")).alias("unreachable"))
    return out.withColumn(by, F.coalesce(by, F.lit("TOTAL")))
