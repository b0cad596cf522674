"""Exact scaling between decimal texts and minor units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number of minor digits by currency; others are unknown, never guessed.
EXPONENT = {"AED": 2, "EUR": 2, "GBP": 2, "INR": 2, "PLN": 2, "SAR": 2, "USD": 2, "BHD": 3, "OMR": 3}
FORM = r"^[+-]?(\d+(\.\d*)?|\.\d+)\z"
BLANK = " \t\n\r\v\f\u00a0\u2028\u2029\ufeff"


def exponent(currency: Column) -> Column:
    """Minor digits of a currency, in any case; NULL if unknown."""
    currency = F.upper(currency)
    out = F.lit(None).cast("int")
    for e in sorted(set(EXPONENT.values())):
        out = F.when(currency.isin([c for c, x in EXPONENT.items() if x == e]), e).otherwise(out)
    return out


def to_minor(amount: Column, currency: Column) -> Column:
    """struct<minor:bigint, reason:string>: reason is NULL, ``malformed`` or ``unknown_currency``."""
    trimmed = F.btrim(amount, F.lit(BLANK))
    e = exponent(currency)
    return _judged(F.coalesce(trimmed, F.lit("")) == "", e, _scaled(F.replace(trimmed, F.lit(","), F.lit("")), e))


def _scaled(text: Column, e: Column) -> Column:
    """The number of minor units; NULL if the text is no such number."""
    value = F.when(text.rlike(FORM), text.try_cast("decimal(38,18)"))
    plain = F.rtrim(text, F.lit("0"))  # zeros at the end of a fraction say nothing
    point = F.instr(text, ".")
    fits = (point == 0) | (F.length(plain) - point <= e)
    return F.when(fits, (value * F.when(e == 3, 1000).otherwise(100)).try_cast("decimal(38,0)"))


def _judged(blank: Column, e: Column, scaled: Column) -> Column:
    good = F.coalesce(F.abs(scaled) <= F.lit(2**53 - 1), F.lit(False))
    reason = F.when(blank, "malformed").when(e.isNull(), "unknown_currency").when(~good, "malformed")
    return F.struct(F.when(~blank & e.isNotNull() & good, scaled.cast("bigint")).alias("minor"), reason.alias("reason"))


def to_minor_each(amounts: Column, digits: Column) -> Column:
    """``to_minor`` of each text of an array; digits: ``exponent`` of its currency. A lambda evaluates what it names twice twice,
    so each step is a pass of its own."""
    texts = F.transform(amounts, lambda a: F.btrim(a, F.lit(BLANK)))
    texts = F.transform(texts, lambda t: F.struct((F.coalesce(t, F.lit("")) == "").alias("blank"), F.replace(t, F.lit(","), F.lit("")).alias("text")))
    numbers = F.transform(texts, lambda x: F.struct(x["blank"].alias("blank"), _scaled(x["text"], digits).alias("scaled")))
    return F.transform(numbers, lambda x: _judged(x["blank"], digits, x["scaled"]))


def minor_to_decimal(minor: Column, currency: Column) -> Column:
    e = exponent(currency)
    digits = F.lpad(F.abs(minor).cast("string"), 20, "0")
    whole = F.regexp_replace(F.substr(digits, F.lit(1), 20 - e), "^0+(?=.)", "")
    return F.concat(F.when(minor < 0, "-").otherwise(""), whole, F.when(e > 0, F.concat(F.lit("."), F.right(digits, e))).otherwise(""))
