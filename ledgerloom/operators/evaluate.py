"""One-pass evaluation of a rule pack: findings, outcomes and documents without a verdict."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import recurrence_key
from ..functions.shape import message, value_shape
from ..functions.text import apart
from ..plans.rules import DEFAULT, Rule, check


def _fired(rules: list[Rule], applies: dict[str, Column]) -> Column:
    """Numbers of a row's fired rules as an array with NULLs: twice the place in ``rules``, and one more where the predicate is NULL,
    which fires without a verdict, never as a pass."""
    fired = []
    for n, r in enumerate(rules):
        if r.grain in applies:
            holds = r.satisfied()
            fired.append(F.when(applies[r.grain] & holds.isNull(), 2 * n + 1).when(applies[r.grain] & ~holds, 2 * n))
    return F.array(*fired)


OPEN = 1 << 32  # weight of a rule without a verdict; a failed one weighs 1


def weight(rules: list[Rule], grain: str) -> Column:
    """How many rules of a grain a row fails, and ``OPEN`` for each whose predicate is NULL there: each is evaluated once."""
    return reduce(Column.__add__, [F.coalesce((~r.satisfied()).cast("bigint"), F.lit(OPEN)) for r in rules if r.grain == grain], F.lit(0).cast("bigint"))


BITS = 31  # rules in a mask: the lower bits say which fail, the upper ones which have no verdict


def pack_rules(packs: dict[str, list[Rule]]) -> list[Rule]:
    """The rules of all packs, each once."""
    return list({r.id: r for rules in packs.values() for r in rules}.values())


def row_masks(rows: DataFrame, packs: dict[str, list[Rule]]) -> DataFrame:
    """Rows with ``masks`` (one for each ``BITS`` rules) of the rules that fire on a row, of the pack of its ``profile`` (none for
    other profiles), and ``first``, whether it is its document's first line. Each rule is evaluated once."""
    rules = pack_rules(packs)
    check(rules)
    rows, applies, bits = with_first(rows, "k"), row_grains(), []
    for n, r in enumerate(rules):
        own = F.col("profile").isin(*[p for p, pack in packs.items() if r.id in {x.id for x in pack}])
        fired = F.coalesce((~r.satisfied()).cast("bigint") * (1 << n % BITS), F.lit(1 << n % BITS + BITS))
        bits.append(F.when(own & applies[r.grain], fired).otherwise(F.lit(0).cast("bigint")))
    masks = [reduce(Column.bitwiseOR, bits[i:i + BITS]) for i in range(0, len(rules), BITS)]
    return rows.withColumns({"masks": F.array(*masks), "first": apart(F.col("line")) == 1})  # apart: the rules are many


def _bits(rules: list[Rule], warning: bool) -> list[int]:
    return [sum(1 << i for i, r in enumerate(rules[at:at + BITS]) if (r.severity == "warning") == warning) for at in range(0, len(rules), BITS)]


def mask_counts(masks: Column, rules: list[Rule]) -> dict[str, Column]:
    """How many rules of the masks are stored as ``warn``, ``fail`` and ``no_verdict``; a warning is ``warn`` either way."""
    count = lambda of, warning: reduce(Column.__add__, [F.bit_count(of(masks[i]).bitwiseAND(bits)) for i, bits in enumerate(_bits(rules, warning))])
    open_ = lambda m: F.shiftrightunsigned(m, BITS)
    return {"warn": count(lambda m: m.bitwiseOR(open_(m)), True), "fail": count(lambda m: m, False), "no_verdict": count(open_, False)}


def failing(masks: Column, rules: list[Rule]) -> list[Column]:
    """The masks' rules that fail and are no warnings."""
    return [masks[i].bitwiseAND(bits) for i, bits in enumerate(_bits(rules, False))]


def rule_table(rules: list[Rule], values: list[str], **more: list[int]) -> Column:
    """The rules as a constant array of structs; ``value`` is the place of the rule's column in ``values``, from 1 (0: none)."""
    extra = lambda n: [F.lit(x[n]).alias(name) for name, x in more.items()]
    return F.array(*[F.struct(
        F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.term).cast("string").alias("term"), F.lit(r.failure).alias("failure_class"), F.lit(r.expected).alias("expected"), F.lit(r.grain).alias("grain"),
        F.lit(values.index(r.value) + 1 if r.value else 0).alias("value"), *extra(n),
    ) for n, r in enumerate(rules)])


def value_columns(values: list[str]) -> list[Column]:
    return [F.col(v).cast("string").alias(f"__v{i}") for i, v in enumerate(values)]


def value_of(values: list[str], place: Column) -> Column:
    """The value at ``place`` of ``values`` (from 1; 0: NULL), of rows that carry ``value_columns``."""
    return F.element_at(F.array(F.lit(None).cast("string"), *[F.col(f"__v{i}") for i in range(len(values))]), place + 1)


def explode_codes(coded: DataFrame) -> DataFrame:
    """One row with ``__code`` for each of ``__codes`` that is not NULL. The array is a column of its own and no lambda cleans it:
    what a lambda or a generator holds is interpreted row by row."""
    return coded.select(*[c for c in coded.columns if c != "__codes"], F.explode_outer("__codes").alias("__code")).where("__code is not null")


def _exploded(rows: DataFrame, rules: list[Rule], applies: dict[str, Column], node: Column, key: str, keep: tuple[str, ...]) -> DataFrame:
    """Small numbers are exploded; what a finding says of its rule is looked up for those that fired."""
    values = sorted({r.value for r in rules if r.value and r.grain in applies})
    table = rule_table([r if r.grain in applies else replace(r, value=None) for r in rules], values)
    hit = explode_codes(rows.select(key, *keep, node.cast("int").alias("__node"), *value_columns(values), _fired(rules, applies).alias("__codes")))
    hit = hit.withColumn("__rule", F.element_at(table, F.floor(F.col("__code") / 2).cast("int") + 1)).withColumn("__value", value_of(values, F.col("__rule.value")))
    r, value = F.col("__rule"), F.col("__value")
    outcome = F.when(F.col("__code") % 2 == 1, "no_verdict").when(r["severity"] == "warning", "warn").otherwise("fail")
    place = F.when(r["grain"] == "line", F.col("__node")).otherwise(0)
    names = ("rule_id", "severity", "term", "failure_class")
    return hit.select(key, *keep, place.alias("node"), r["grain"].alias("grain"), *[r[n].alias(n) for n in names], outcome.alias("outcome"), value_shape(value).alias("shape"), message(r["expected"], value).alias("message"))


def findings(rows: DataFrame, grain: str, rules: list[Rule] = DEFAULT, key: str = "k", keep: tuple[str, ...] = ()) -> DataFrame:
    """Fired rules of one grain: key, ``keep``, node, grain, rule_id, severity, term, failure_class, outcome, shape, message.
    All rules share one scan."""
    check(rules)
    return _exploded(rows, rules, {grain: F.lit(True)}, F.col("line") if grain == "line" else F.lit(0), key, keep)


def row_findings(rows: DataFrame, rules: list[Rule] = DEFAULT, key: str = "k", keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of all three grains over lines that carry their document's fields: document rules judge a document's
    first line, subtotal rules the first line of each tax category. One scan and one exchange serve all."""
    check(rules)
    return _exploded(with_first(rows, key), rules, row_grains(), F.col("line"), key, keep)


def row_grains() -> dict[str, Column]:
    """Which rows each grain judges, of lines that carry their document's fields."""
    return {"document": F.col("line") == 1, "line": F.lit(True), "subtotal": F.col("first_of_category")}


def with_first(rows: DataFrame, key: str) -> DataFrame:
    """Optional fields, and whether a line is its document's first of its tax category, unless the rows say so already."""
    first = F.row_number().over(Window.partitionBy(key, "tax_category").orderBy("line")) == 1
    return with_optional(rows if "first_of_category" in rows.columns else rows.withColumn("first_of_category", first))


def node_findings(nodes: DataFrame, rules: list[Rule] = DEFAULT, key: str = "k", keep: tuple[str, ...] = (), refusal: Rule | None = None) -> DataFrame:
    """Findings over rows that are one judged element each: ``grain`` and ``node`` say which, beside the document's fields.
    ``refusal`` judges rows of a grain of its own, so that refused documents take the same pass."""
    check(rules)
    rules = [*rules, *([refusal] if refusal else [])]
    applies = {grain: F.col("grain") == grain for grain in ("document", "line", "subtotal", *([refusal.grain] if refusal else []))}
    return _exploded(with_optional(nodes), rules, applies, F.col("node"), key, keep)


def with_optional(rows: DataFrame) -> DataFrame:
    """Absent optional fields as NULL columns."""
    return rows.withColumns({c: F.lit(None).cast("string") for c in ("prepaid", "buyer_ref") if c not in rows.columns})


def subtotals(lines: DataFrame) -> DataFrame:
    """Tax categories of each document."""
    return lines.select("k", "tax_category").distinct()


def all_findings(invoices: DataFrame, lines: DataFrame, rules: list[Rule] = DEFAULT) -> DataFrame:
    """Findings of documents and lines that are tables of their own."""
    parts = [findings(with_optional(invoices), "document", rules), findings(lines, "line", rules), findings(subtotals(lines), "subtotal", rules)]
    return reduce(DataFrame.unionByName, parts)


def node_path(root: Column, grain: Column, node: Column) -> Column:
    """Path of the judged element in its document, in prefix form."""
    top = F.concat(F.lit("/ubl:"), root, F.lit("[1]"))
    return F.when(grain == "line", F.concat(top, F.lit("/cac:"), F.when(root == "CreditNote", "CreditNoteLine").otherwise("InvoiceLine"), F.lit("["), node.cast("string"), F.lit("]"))).otherwise(top)


def stored_outcomes(invoices: DataFrame, found: DataFrame, keep: tuple[str, ...] = ("k",)) -> DataFrame:
    """Findings as they are stored: a warning is ``warn``, others carry their document's outcome; a judged document without
    findings has one ``pass`` row without a rule."""
    own = F.when(F.col("severity") == "warning", "warn").otherwise(F.col("outcome"))
    stored = found.select("k", "rule_id", own.alias("stored"))
    return invoices.select(*keep).join(stored, "k", "left").select(*keep, "rule_id", F.coalesce("stored", F.lit("pass")).alias("outcome"))


def outcomes(invoices: DataFrame, found: DataFrame) -> DataFrame:
    """k and outcome of every document: no_verdict, fail, warn or pass."""
    rank = F.when(F.col("outcome") == "no_verdict", 3).when(F.col("outcome") == "fail", 2).otherwise(1)
    worst = found.groupBy("k").agg(F.max(rank).alias("worst"))
    name = F.when(F.col("worst") == 3, "no_verdict").when(F.col("worst") == 2, "fail").when(F.col("worst") == 1, "warn").otherwise("pass")
    return invoices.select("k").join(worst, "k", "left").select("k", name.alias("outcome"))


def facts(found: DataFrame, entity: Column) -> DataFrame:
    """Findings as facts of the anonymised store: no key of a document, the shape of the value in camel case, a warning as
    ``warn`` and others with their outcome, and the key under which the same failure of ``entity`` recurs."""
    shape = F.struct(F.col("shape.len").alias("len"), F.col("shape.charset").alias("charset"), F.col("shape.regex_class").alias("regexClass"), F.col("shape.expected").alias("expected"))
    key = recurrence_key(entity, F.col("rule_id"), F.col("term"), F.col("shape.regex_class"))
    return found.select(F.col("rule_id").alias("ruleId"), "severity", F.col("term").alias("businessTerm"), F.col("failure_class").alias("failureClass"), F.when(F.col("severity") == "warning", "warn").otherwise(F.col("outcome")).alias("outcome"), shape.alias("valueShape"), key.alias("recurrenceKey"))


RANK = {"no_verdict": 3, "fail": 2, "warn": 1}


def row_outcomes(rows: DataFrame, rules: list[Rule] = DEFAULT, key: str = "k") -> DataFrame:
    """key and outcome of every document of ``row_findings``' input, without a join back: a document's rows are together."""
    rows, applies = with_first(rows, key), row_grains()
    ranks = []
    for r in rules:
        holds = r.satisfied()
        ranks.append(F.when(applies[r.grain] & holds.isNull(), RANK["no_verdict"]).when(applies[r.grain] & ~holds, RANK["warn"] if r.severity == "warning" else RANK["fail"]).otherwise(0))
    worst = rows.groupBy(key).agg(F.max(F.greatest(*ranks)).alias("worst"))
    name = F.when(F.col("worst") == 3, "no_verdict").when(F.col("worst") == 2, "fail").when(F.col("worst") == 1, "warn").otherwise("pass")
    return worst.select(key, name.alias("outcome"))


def by_rule(found: DataFrame) -> DataFrame:
    """Findings and documents of each rule; counted by document first, which needs no exchange where findings are together."""
    group = ["rule_id", "severity", "term", "failure_class"]
    each = found.groupBy("k", *group).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*group).agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("documents"))


def finding_groups(found: DataFrame) -> DataFrame:
    """Failures by rule, term, class, severity, path and shape, most frequent first (ties by rule and path)."""
    group = ["rule_id", "term", "failure_class", "severity", "path", "shape"]
    return found.where("outcome = 'fail'").groupBy(*group).agg(F.count(F.lit(1)).alias("affected")).orderBy(F.col("affected").desc(), "rule_id", "path", F.col("shape.regex_class"))


def fired_twice(found: DataFrame) -> DataFrame:
    """Rules that fired more than once in a document: k, rule_id and how often."""
    return found.groupBy("k", "rule_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def coverage(found: DataFrame, profiles: dict[str, list[Rule]], seen: DataFrame) -> DataFrame:
    """Rules of each profile by fate, with a total row: declared, fired, always_true (its grain occurs, it was never false)
    and absent (no judged document has its grain). found: profile, rule_id; seen: profile and grain of what was judged."""
    spark = found.sparkSession
    table = spark.createDataFrame([(p, r.id, r.grain) for p, rules in profiles.items() for r in rules], "profile string, rule_id string, grain string")
    hit = found.groupBy("profile", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    there = seen.select("profile", "grain").distinct().withColumn("there", F.lit(True))
    fate = table.join(hit, ["profile", "rule_id"], "left").join(there, ["profile", "grain"], "left")
    counts = [F.count(F.lit(1)).alias("declared"), F.count("n").alias("fired"), F.count_if(F.col("n").isNull() & F.col("there").isNotNull()).alias("always_true"), F.count_if(F.col("n").isNull() & F.col("there").isNull()).alias("absent")]
    return fate.rollup("profile").agg(*counts).withColumn("profile", F.coalesce("profile", F.lit("TOTAL")))


def hash_tree(rows: DataFrame) -> DataFrame:
    """One row: the digest of all hashes ``h``, whatever their order. Leaves are the hashes of one four-digit prefix, sorted; above
    them are the 256 two-digit prefixes, then the root, so that no task holds more than its part (a 65,536th of the rows)."""
    of = lambda df, digits: df.groupBy(F.substring("part", 1, digits).alias("part")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    leaves = of(rows.select(F.col("h").alias("part"), "h"), 4)
    return of(of(leaves, 2), 0).select("h")


def ruleset_hash(rules: DataFrame, lists: DataFrame) -> DataFrame:
    """Identity of a ruleset: a hash over its rules (rule_id, text) and code lists (list_id, code), whatever their order."""
    line = lambda kind, *c: F.sha2(F.concat_ws("\x1f", F.lit(kind), *c), 256).alias("h")
    rows = rules.select(line("rule", "rule_id", "text")).union(lists.select(line("list", "list_id", "code")))
    return hash_tree(rows).select(F.concat(F.lit("sha256:"), "h").alias("ruleset_hash"))


def files_hash(files: DataFrame) -> DataFrame:
    """The same of files as they are (path, content, as Spark's ``binaryFile`` gives them): their names and bytes."""
    name = F.element_at(F.split("path", "/"), -1)
    return hash_tree(files.select(F.sha2(F.concat_ws("\x1f", name, F.sha2("content", 256)), 256).alias("h"))).select(F.concat(F.lit("sha256:"), "h").alias("ruleset_hash"))
