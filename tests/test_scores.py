"""Scores at values where binary fractions would differ from exact ones."""

from decimal import Decimal

from ledgerloom.operators import scores


def test_frozen_receivables_are_exact_at_halves(spark):
    df = spark.createDataFrame([("EUR", 1, Decimal("1.000"), 775657770535), ("AED", 3, Decimal("0.125"), 4)], "currency string, invoices long, failure_rate decimal(4,3), average long")
    sizes = spark.createDataFrame([("EUR", 40)], "currency string, entities long")
    got = {r.currency: r for r in scores.frozen_receivables(df, sizes, "currency").collect()}
    assert (got["EUR"].at_risk, got["EUR"].frozen, got["EUR"].basis) == (775657770535, 542960439375, "corpus")  # doubles gave ...374
    assert (got["AED"].at_risk, got["AED"].frozen, got["AED"].basis) == (2, 1, "estimate")
    assert got["AED"].workings[1] == "x 12.5% projected failure rate"
