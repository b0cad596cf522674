"""What the plans of judgements must not hold."""

import re

from ledgerloom.operators.evaluate import row_findings
from ledgerloom.sources.fixtures import invoice_rows
from ledgerloom.sources.ubl import _group, _leaf
from pyspark.sql import functions as F


def test_lines_are_exchanged_once_and_no_lambda_judges(spark):
    found = row_findings(invoice_rows(spark, "/root/testdata/sf0.001")).select("k", "rule_id", "outcome")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 2  # lines, and headers where they are not broadcast
    assert "lambdafunction" not in plan and plan.count("tax_category#") and "Exchange hashpartitioning(k#" in plan


def test_groups_name_their_parts_once(spark):
    nested = _group("A", _group("B", _group("C", _leaf("X", F.col("v")))), _group("D", _leaf("Y", F.lit(None).cast("string"))))
    got = [r[0] for r in spark.createDataFrame([("<",), ("",), (None,)], "v string").select(nested).collect()]
    assert got == ["<cac:A><cac:B><cac:C><cbc:X>&lt;</cbc:X></cac:C></cac:B></cac:A>", "<cac:A><cac:B><cac:C><cbc:X></cbc:X></cac:C></cac:B></cac:A>", ""]
    assert str(nested).count("<cbc:X") == 1
