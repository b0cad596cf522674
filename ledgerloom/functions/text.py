"""Lexical guards and text functions over columns. NULL (absent) and '' (empty) stay different."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


SPACE = " \t\r\n"
DATE = r"^\d{4}-\d{2}-\d{2}\z"
DECIMAL = r"^[+-]?(\d+(\.\d*)?|\.\d+)\z"
EXACT = r"^[+-]?(\d{1,29}(\.\d{0,9})?|\.\d{1,9})\z"


def apart(c: Column) -> Column:
    """The value as it is, by way of a lambda. A step that holds one stays out of whole-stage code, where all of a step's expressions
    are one method: with many of them it is too long for the JVM to compile, and is interpreted for every row."""
    return F.element_at(F.transform(F.array(c), lambda x: x), 1)


def edged(c: Column) -> Column:
    """Without white space at the ends; absent becomes empty. Tells empty from filled without a regular expression."""
    return F.coalesce(F.btrim(c, F.lit(SPACE)), F.lit(""))


def ns(c: Column) -> Column:
    """White space normalised; absent becomes empty."""
    return F.regexp_replace(edged(c), r"[ \t\r\n]+", " ")


def filled(c: Column) -> Column:
    return edged(c) != ""


def is_date(c: Column) -> Column:
    """ISO calendar date, by form first and value second."""
    return to_date(c).isNotNull()


def to_date(c: Column) -> Column:
    return F.when(F.trim(c).rlike(DATE), F.trim(c).try_cast("date"))


def is_decimal(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(DECIMAL), F.lit(False))


def to_decimal(c: Column) -> Column:
    """Exact decimal; NULL unless the text is one that fits 29 digits before and 9 after the point."""
    return F.when(F.trim(c).rlike(EXACT), F.trim(c).try_cast("decimal(38,9)"))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
