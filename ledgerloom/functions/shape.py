"""Value shapes: what a value looks like, never what it is. ASCII classes; lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN_CAP = 12
RUNS = r"[0-9]+|[A-Z]+|[a-z]+|\s+|[^A-Za-z0-9\s]+"
# Raw-value patterns; \w is any letter, digit or underscore of Unicode.
RAW = {"fifteen_digits": r"(?U)\b\d{15}\b", "iban": r"[A-Z]{2}(?U:\d{2})[A-Z0-9]{11,30}", "email": r"(?U)\b[\w.+-]+@[\w-]+\.[\w.]+\b"}


def charset(v: Column) -> Column:
    return (
        F.when(v.isNull(), None).when(v == "", "empty").when(v.rlike(r"^[0-9]+\z"), "numeric")
        .when(v.rlike(r"^[A-Za-z]+\z"), "alpha").when(v.rlike(r"^[A-Za-z0-9]+\z"), "alnum").otherwise("mixed")
    )


def regex_class(v: Column) -> Column:
    """Run-length class signature; more than RUN_CAP runs give ``[\\s\\S]{length}``; '' gives NULL."""
    runs = F.regexp_extract_all(v, F.lit(RUNS), F.lit(0))
    name = lambda r: (
        F.when(r.rlike("^[0-9]"), "[0-9]").when(r.rlike("^[A-Z]"), "[A-Z]").when(r.rlike("^[a-z]"), "[a-z]").when(r.rlike(r"^\s"), r"\s").otherwise("[^A-Za-z0-9]")
    )
    signature = F.array_join(F.transform(runs, lambda r: F.concat(name(r), F.lit("{"), F.length(r).cast("string"), F.lit("}"))), "")
    return F.when(v.isNull() | (v == ""), None).when(F.size(runs) > RUN_CAP, F.concat(F.lit(r"[\s\S]{"), F.length(v).cast("string"), F.lit("}"))).otherwise(signature)


def value_shape(v: Column, expected: str | None = None) -> Column:
    """struct<len, charset, regex_class, expected>; a field whose text equals the value is NULL."""
    hide = lambda c: F.when(c.cast("string").eqNullSafe(v), None).otherwise(c)
    return F.struct(
        hide(F.length(v)).alias("len"), hide(charset(v)).alias("charset"), hide(regex_class(v)).alias("regex_class"), hide(F.lit(expected).cast("string")).alias("expected")
    )


def phrase(v: Column) -> Column:
    """What was received, from its length and class alone; a field that would echo the value is left out."""
    s = value_shape(v)
    long = F.concat(s["len"].cast("string"), F.lit(" characters"))
    full = F.concat(long, F.lit(" ("), s["charset"], F.lit(")"))
    return (
        F.when(v.isNull(), "nothing").when(v == "", "empty").when(s["len"].isNull(), F.concat(F.lit("a "), s["charset"], F.lit(" value")))
        .when(s["charset"].isNull(), long).otherwise(full)
    )


def message(expected: Column | str, v: Column) -> Column:
    return F.concat(F.lit("Expected "), F.lit(expected) if isinstance(expected, str) else expected, F.lit("; received "), phrase(v), F.lit("."))


def holds_raw(v: Column) -> Column:
    """Whether any raw-value pattern occurs in the text."""
    out = F.lit(False)
    for pattern in RAW.values():
        out = out | F.coalesce(v.rlike(pattern), F.lit(False))
    return out
