"""Documents from export rows: an invoice's rows form one document with lines, totals and defects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.money import to_minor
from ..functions.shape import value_shape
from .evaluate import explode_codes

# Document types and scenarios.
TYPES = ("invoice", "credit_note", "debit_note", "self_billed")
SCENARIOS = ("standard", "zero_rated", "exempt", "reverse_charge", "designated_zone", "export")
KEY = ["file", "invoice_number"]
GROUP = [*KEY, "accepted", "alone"]  # what ``number_rows`` exchanges rows by: an aggregate by all of these exchanges none


def plain_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s-]", "_"))


def number_rows(rows: DataFrame, currency: str = "AED", within: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``accepted`` (number and ISO-shaped date present), and for these the document's currency, whether the
    row's own contradicts it (a blank one stands for the default), whether it makes a line, and the line's number. An
    invoice's rows are one small group; a rejected row is a group of its own (``alone``). ``within``: columns that the rows of an
    invoice share anyway; rows that are together by these are not exchanged."""
    ok = F.col("invoice_number").isNotNull() & F.coalesce(F.col("issue_date").rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.lit(False))
    w = Window.partitionBy(*within, *GROUP).orderBy("row_idx")
    rows = rows.withColumn("alone", F.when(~ok, F.col("row_idx")))
    out = rows.withColumn("accepted", ok).withColumn("n", F.row_number().over(w))
    out = out.withColumn("doc_currency", F.coalesce(F.first("currency").over(w), F.lit(currency)))
    out = out.withColumn("conflict", F.col("accepted") & (F.coalesce(F.col("currency"), F.lit(currency)) != F.col("doc_currency")))
    out = out.withColumn("own_currency", F.coalesce(F.col("currency"), F.lit(currency)))
    filled = F.coalesce("line_net", "line_description", "line_quantity").isNotNull()
    out = out.withColumn("admitted", F.col("accepted") & ~F.col("conflict") & ((F.col("n") == 1) | filled))
    at = F.sum(F.col("admitted").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("line", F.when(F.col("admitted"), F.coalesce(F.col("line_number").try_cast("int"), at.cast("int"))))


def _unit() -> Column:
    return F.when(F.col("line_unit").rlike(r"^[A-Z0-9]{2,3}\z"), F.col("line_unit"))


def line_rows(numbered: DataFrame) -> DataFrame:
    """Admitted lines: unit codes that have no code's form become NULL, amounts minor units with a reason."""
    money = to_minor(F.col("line_net"), F.col("doc_currency"))
    return numbered.where("admitted").select(*KEY, "row_idx", "line", "doc_currency", "line_description", "line_quantity", _unit().alias("unit"), "line_net", money.alias("net"), "line_tax_category", F.col("line_tax_rate").try_cast("decimal(9,4)").alias("rate"), "line_unit")


def documents(numbered: DataFrame) -> DataFrame:
    """One row per document: the first accepted row is its header; a document of unknown type is left out."""
    return _assembled(numbered)


def _assembled(numbered: DataFrame, *more: Column) -> DataFrame:
    """Documents with the aggregates ``more`` of their accepted rows; header and lines come from one pass over the rows."""
    header = ["issue_date", "doc_currency", "doc_type", "scenario", "buyer_trn", "line_extension"]
    minor = to_minor(F.when(F.col("admitted"), F.col("line_net")), F.col("doc_currency"))["minor"]
    rows = numbered.where("accepted").withColumns({"minor": minor, "rate": F.when(F.col("admitted"), F.col("line_tax_rate").try_cast("decimal(9,4)"))})
    total = rows.groupBy(*GROUP).agg(
        F.first(F.when(F.col("n") == 1, F.struct(*header)), ignorenulls=True).alias("head"), F.count_if("admitted").alias("n_lines"), F.count("minor").alias("n_minor"), F.sum("minor").alias("minor"),
        (F.min("rate") != F.max("rate")).alias("multi_rate"), *more,
    )
    names = [c for c in total.columns if c not in (*GROUP, "head", "n_lines", "n_minor", "minor", "multi_rate")]
    out = total.select(*KEY, "head.*", "n_lines", F.when(F.col("n_minor") == F.col("n_lines"), F.col("minor")).alias("line_sum"), "multi_rate", *names)
    kind, scene = plain_name(F.coalesce("doc_type", F.lit("invoice"))), plain_name(F.coalesce("scenario", F.lit("standard")))
    stated = to_minor(F.col("line_extension"), F.col("doc_currency"))["minor"]
    out = out.select(
        *KEY, "issue_date", F.col("doc_currency").alias("currency"), kind.alias("doc_type"), F.when(scene.isin(*SCENARIOS), scene).otherwise("standard").alias("scenario"),
        "buyer_trn", "n_lines", F.coalesce(stated, "line_sum").alias("line_total"), F.coalesce("multi_rate", F.lit(False)).alias("multi_rate"), *names,
    )
    return out.where(F.col("doc_type").isin(*TYPES))


def _judged(numbered: DataFrame, within: tuple[str, ...]) -> tuple[DataFrame, list[tuple[Column, str, Column | None]]]:
    """Rows with ``bare`` (a document whose lines state no tax category), and the defects: when, class and the value that is shown;
    what can't be read shows none."""
    kind, scene = plain_name(F.col("doc_type")), plain_name(F.col("scenario"))
    nothing, known = F.lit(None).cast("string"), to_minor(F.col("line_net"), F.col("doc_currency"))
    first = F.col("accepted") & (F.col("n") == 1)
    typed = F.coalesce(kind.isin(*TYPES), F.lit(True))
    bare = F.bool_and(F.when(F.col("admitted"), F.col("line_tax_category").isNull())).over(Window.partitionBy(*within, *GROUP))
    return numbered.withColumn("bare", bare), [
        (~F.col("accepted"), "parse_error", None),
        (F.col("admitted") & F.col("line_number").isNotNull() & F.col("line_number").try_cast("int").isNull(), "parse_error", None),
        (F.col("conflict"), "currency_inconsistent", F.col("own_currency")),
        (F.col("admitted") & ~F.coalesce(F.col("line_unit").rlike(r"^[A-Z0-9]{2,3}\z"), F.lit(True)), "unit_code_freetext", F.col("line_unit")),
        (F.col("admitted") & F.col("line_net").isNotNull() & (known["reason"] == "unknown_currency"), "currency_inconsistent", F.col("doc_currency")),
        (first & ~typed, "parse_error", None),
        (first & typed & ~F.coalesce(scene.isin(*SCENARIOS), F.lit(True)), "identifier_inconsistent", F.col("scenario")),
        (first & typed & F.col("buyer_trn").isNull(), "trn_missing", nothing),
        (first & typed & F.coalesce("bare", F.lit(False)), "tax_category_unmapped", nothing),
    ]


def defects(numbered: DataFrame) -> DataFrame:
    """file, row_idx, defect_class and shape of each defect of rows, lines and documents. What can't be read has no shape; a
    stated line number that is no number is such a defect, and its line is numbered by position."""
    rows, kinds = _judged(numbered, ())
    values = [F.lit(None).cast("string") if value is None else value for _, _, value in kinds]
    codes = F.array(*[F.when(when, n) for n, (when, _, _) in enumerate(kinds)])
    hit = explode_codes(rows.select("file", "row_idx", *[v.alias(f"__v{n}") for n, v in enumerate(values)], codes.alias("__codes")))
    at = lambda columns: F.element_at(F.array(*columns), F.col("__code") + 1)
    value = at([F.col(f"__v{n}") for n in range(len(kinds))])
    shape = F.when(at([F.lit(shown is not None) for _, _, shown in kinds]), value_shape(value))  # for those that are there alone
    return hit.select("file", "row_idx", at([F.lit(name) for _, name, _ in kinds]).alias("defect_class"), shape.alias("shape"))


def count_defects(numbered: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``n_defects``, how many ``defects`` a row has; nothing is exchanged or exploded for it."""
    rows, kinds = _judged(numbered, within)
    return rows.withColumn("n_defects", reduce(Column.__add__, [F.when(when, 1).otherwise(0) for when, _, _ in kinds]))


def register(found: DataFrame, run: str = "file") -> DataFrame:
    """One row per run and class: count and the shape that was seen first."""
    return found.groupBy(run, "defect_class").agg(F.count(F.lit(1)).alias("n"), F.min_by("shape", F.struct("row_idx", F.col("shape.regex_class"))).alias("first_shape"))


def doc_hash(numbered: DataFrame) -> DataFrame:
    """SHA-256 of each document's values as a JSON array with its lines nested, in a fixed order."""
    text = lambda c: F.coalesce(F.to_json(F.array(c.cast("string"))), F.lit("[null]"))
    net = to_minor(F.col("line_net"), F.col("doc_currency"))["minor"]
    line = F.concat(F.lit("["), F.concat_ws(",", *[text(c) for c in (F.col("line"), F.col("line_description"), F.col("line_quantity"), _unit(), net, F.col("line_tax_category"))]), F.lit("]"))
    items = F.sort_array(F.collect_list(F.when(F.col("admitted"), F.struct("line", "row_idx", line.alias("text"))))).alias("items")
    body = F.concat(F.lit("["), F.concat_ws(",", *[text(F.col(c)) for c in ("invoice_number", "issue_date", "currency", "doc_type", "scenario", "buyer_trn", "line_total")]), F.lit(",["), F.array_join("items.text", ","), F.lit("]]"))
    return _assembled(numbered, items).select(*KEY, F.sha2(body, 256).alias("doc_hash"))
