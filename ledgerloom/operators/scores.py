"""Readiness, scenario coverage, frozen receivables and expectations."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the readiness score, in the order that breaks ties of the largest gap.
WEIGHTS = {"mandatory_field_coverage": 30, "master_data_quality": 25, "scenario_coverage": 20, "rule_failure_rate": 15, "lifecycle_readiness": 10}
CORPUS_BASIS = 40


def unit_range(c: Column) -> Column:
    """Clamped to 0 to 1; anything that is no finite number is an error."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a score input is not finite")).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def half_up(c: Column) -> Column:
    """Nearest integer, halves towards positive infinity."""
    return F.floor(c + F.lit(Decimal("0.5")))  # a decimal stays exact


def band(score: Column) -> Column:
    return F.when(score < 40, "not_ready").when(score < 70, "at_risk").when(score < 90, "nearly_ready").otherwise("ready")


def readiness(df: DataFrame, key: str) -> DataFrame:
    """score, band and the component with the largest weighted gap (the first on a tie) of rows that hold the five inputs."""
    part = {name: unit_range(F.col(name).cast("double")) for name in WEIGHTS}
    total = sum((part[name] * w for name, w in WEIGHTS.items()), F.lit(0.0))
    gaps = F.array(*[F.struct(F.round((1 - part[name]) * w, 9).alias("gap"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, w) in enumerate(WEIGHTS.items())])
    return df.select(key, half_up(total).cast("int").alias("score"), F.array_max(gaps)["name"].alias("largest_gap")).select(key, "score", band(F.col("score")).alias("band"), "largest_gap")


def scenario_coverage(declared: Column, observed: Column) -> Column:
    """struct<ratio, unobserved, undeclared>; the ratio is 0 if nothing is declared."""
    both = F.size(F.array_intersect(declared, observed))
    ratio = F.when(F.size(F.array_distinct(declared)) > 0, both / F.size(F.array_distinct(declared))).otherwise(0.0)
    return F.struct(ratio.alias("ratio"), F.array_except(declared, observed).alias("unobserved"), F.array_except(observed, declared).alias("undeclared"))


def frozen_receivables(df: DataFrame, sizes: DataFrame, key: str, days: int = 21) -> DataFrame:
    """Minor units at risk a month and frozen while failing invoices (columns invoices, failure_rate, average) are sent
    again; ``sizes`` (key, entities) says how many entities the figures rest on. Exact where failure_rate is a decimal."""
    risk = half_up(F.col("invoices") * F.col("failure_rate") * F.col("average")).cast("long")
    out = df.join(sizes, key, "left").withColumn("sample_size", F.coalesce("entities", F.lit(0))).withColumn("at_risk", risk)
    out = out.withColumn("frozen", half_up(F.col("at_risk").cast("decimal(20,0)") * days / 30).cast("long"))
    said = F.array(F.format_string("%d invoices/month", F.col("invoices").cast("long")), F.format_string("x %.1f%% projected failure rate", F.col("failure_rate").cast("double") * 100), F.format_string("x %d minor units average value", F.col("average").cast("long")),
                   F.format_string("= %d minor units at risk per month", "at_risk"), F.lit(f"x {days} days to resubmit / 30"), F.format_string("= %d minor units frozen", "frozen"))
    return out.select(key, "at_risk", "frozen", F.when(F.col("sample_size") >= CORPUS_BASIS, "corpus").otherwise("estimate").alias("basis"), "sample_size", said.alias("workings"))


def check_expectations(expected: DataFrame, found: DataFrame, key: str = "k") -> DataFrame:
    """key and problem of each case whose fired rules differ. expected: key, outcome, match ('exact' or 'superset'),
    fired_rules, must_not_fire; found: key, rule_id, outcome."""
    rank = F.when(F.col("outcome") == "fail", 2).otherwise(1)
    got = found.groupBy(key).agg(F.collect_set("rule_id").alias("got"), F.max(rank).alias("rank"))
    both = expected.join(got, key, "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    now = F.when(F.col("rank") == 2, "fail").when(F.col("rank") == 1, "warn").otherwise("pass")
    name = lambda what, rules: F.transform(F.array_sort(rules), lambda r: F.concat(F.lit(f"{what} "), r))
    none = F.array().cast("array<string>")
    problems = F.concat(
        F.when(now != F.col("outcome"), F.array(F.concat(F.lit("outcome "), now))).otherwise(none), name("missing", F.array_except("fired_rules", "got")),
        F.when(F.col("match") == "exact", name("unexpected", F.array_except("got", "fired_rules"))).otherwise(none), name("forbidden", F.array_intersect("got", "must_not_fire")),
    )
    return both.select(key, F.explode(problems).alias("problem"))


def check_details(expected: DataFrame, found: DataFrame, key: str = "k") -> DataFrame:
    """key and problem of each expected finding (key, rule_id, failure_class, term, regex_class) that did not fire, fired more
    than once in one place, or fired with another class, term or shape. found: also node and shape."""
    got = found.groupBy(key, "rule_id", "node").agg(F.count(F.lit(1)).alias("times"), F.first("failure_class").alias("c"), F.first("term").alias("t"), F.first("shape.regex_class").alias("s"))
    got = got.groupBy(key, "rule_id").agg(F.max("times").alias("times"), F.min(F.struct("node", "c", "t", "s")).alias("x"))
    both = expected.join(got, [key, "rule_id"], "left")
    differs = lambda name, a, b: F.when(~a.eqNullSafe(b), F.concat(F.lit(f"{name} "), F.col("rule_id")))
    silent = F.when(F.col("times").isNull(), F.concat(F.lit("silent "), F.col("rule_id")))
    rest = [F.when(F.col("times") > 1, F.concat(F.lit("twice "), F.col("rule_id"))), differs("class", F.col("failure_class"), F.col("x.c")), differs("term", F.col("term"), F.col("x.t")), differs("shape", F.col("regex_class"), F.col("x.s"))]
    problems = F.when(silent.isNotNull(), F.array(silent)).otherwise(F.array_compact(F.array(*rest)))
    return both.select(key, F.explode(problems).alias("problem"))


def unjustified(expected: DataFrame, key: str = "k") -> DataFrame:
    """Cases that expect more than they name (match ``superset``) without a reason (justification)."""
    return expected.where((F.col("match") == "superset") & (F.coalesce(F.trim("justification"), F.lit("")) == "")).select(key, F.lit("superset without a reason").alias("problem"))
