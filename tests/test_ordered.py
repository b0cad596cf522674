"""Claims, order, options and fates on elements written out by hand."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ordered
from ledgerloom.plans.patterns import Context, Pattern, check_patterns, patterns
from ledgerloom.plans.rules import PROFILES, Rule, pack

NODES = "k long, grain string, node int, kind string, a string, b string"
applies = lambda: {g: F.col("grain") == g for g in ("document", "line")}


def rule(name, severity="error", grain="line", value="a", holds=None):
    return Rule(name, grain, severity, "BT-1", "invalid_code", value, holds or (lambda: F.col("a") == "ok"), "an ok")


RULES = [rule("W", "warning"), rule("E"), rule("F", "fatal"), rule("D", "warning", "document"), rule("X", holds=lambda: F.col("b") == "ok")]
PATTERNS = (
    Pattern("one", (Context("special", "line", ("W", "E"), lambda: F.col("kind") == "s"), Context("any", "line", ("F",)))),
    Pattern("two", (Context("document", "document", ("D",)),)),
    Pattern("three", (Context("rest", "line", ("X",), lambda: F.col("kind") != "s"),)),
)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, NODES).repartition(3)
    out = ordered.ordered_findings(df, PATTERNS, RULES, applies(), node=F.col("node"), **options)
    return [(r.k, r.ordinal, r.node, r.rule_id, r.outcome) for r in out.orderBy("k", "ordinal").collect()]


ROWS = [
    (1, "document", 0, None, "bad", None), (1, "line", 2, "s", "bad", "bad"), (1, "line", 1, "t", "bad", "bad"), (1, "line", 3, "s", "ok", "bad"),  # line 3 is fine where it is claimed
    (2, "document", 0, None, "bad", None), (2, "line", 1, "t", "ok", "ok"),  # a warning only
    (3, "document", 0, None, "ok", None), (3, "line", 1, None, "ok", None),  # nobody knows who claims, and X has no answer either way
]


def test_contexts_claim_and_findings_have_an_order(spark):
    assert found(spark, ROWS) == [
        (1, 1, 2, "W", "warn"), (1, 2, 2, "E", "fail"), (1, 3, 1, "F", "fail"), (1, 4, 0, "D", "warn"), (1, 5, 1, "X", "fail"),  # the special context goes first, then the other lines
        (2, 1, 0, "D", "warn"),
        (3, 1, 1, "W", "no_verdict"), (3, 2, 1, "E", "no_verdict"), (3, 3, 1, "F", "no_verdict"), (3, 4, 1, "X", "no_verdict"),
    ]


def test_options(spark):
    cut = [(1, 1, 2, "W", "warn"), (1, 2, 2, "E", "fail"), (2, 1, 0, "D", "warn"), (3, 1, 1, "W", "no_verdict")]
    assert found(spark, ROWS, stop_on_first_error=True) == cut  # the warning before the error stays
    assert found(spark, ROWS, stop_on_first_error=True, include_warnings=False) == [(1, 1, 2, "E", "fail"), (3, 1, 1, "W", "no_verdict")]
    assert [r[3] for r in found(spark, ROWS, include_warnings=False) if r[0] == 1] == ["E", "F", "X"]
    assert found(spark, []) == []


def test_tallies_and_fates(spark):
    df = spark.createDataFrame(ROWS, NODES).withColumn("profile", F.when(F.col("k") == 2, "small").otherwise("large"))
    tally = ordered.tallies(df, PATTERNS, RULES, applies(), "profile")
    got = {(r.profile, r.rule_id): (r.pattern, r.context, r.holds, r.fails, r.no_verdict, r.undetermined) for r in tally.collect()}
    assert got["large", "E"] == ("one", "special", 1, 1, 0, 1) and got["large", "F"] == ("one", "any", 0, 1, 0, 1) and got["large", "D"] == ("two", "document", 1, 1, 0, 0)
    assert got["small", "E"] == ("one", "special", 0, 0, 0, 0) and got["small", "F"] == ("one", "any", 1, 0, 0, 0) and got["large", "X"] == ("three", "rest", 0, 1, 0, 1)
    members = spark.createDataFrame([(p, r.id) for p in ("large", "small", "unseen") for r in RULES], "profile string, rule_id string")
    fates = {r.profile: (r.declared, r.fired, r.always_true, r.absent, r.undetermined, r.unreachable) for r in ordered.fates(tally, members, unreachable={"small": {"W", "F"}}).collect()}
    assert fates == {"large": (5, 5, 0, 0, 0, 0), "small": (5, 1, 2, 2, 0, 1), "TOTAL": (10, 6, 2, 2, 0, 1)}
    alone = ordered.tallies(df.where("k = 3"), PATTERNS, RULES, applies(), "profile")
    assert ordered.fates(alone, members).where("profile = 'large'").first().undetermined == 4


def test_patterns_are_checked():
    for profile in PROFILES:
        check_patterns(patterns(profile), pack(profile, quarantined=True))
    rules, line = pack("en16931"), Context("x", "line", ("R-016",))
    for bad in ((*patterns("en16931"), Pattern("twice", (line,))), patterns("en16931")[1:], (*patterns("en16931")[:-1], Pattern("s", (Context("s", "line", ("R-024",)),))), (*patterns("en16931"), patterns("en16931")[0]), (*patterns("en16931"), Pattern("u", (Context("u", "line", ("R-999",)),)))):
        with pytest.raises(ValueError):
            check_patterns(bad, rules)
    with pytest.raises(ValueError):
        patterns("other")
