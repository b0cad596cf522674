"""Queries over files that Spark writes from the given tables and reads back, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.fixtures import DUCK_WITH
from .sources.tabular import EXPORT, export_rows, read_csv, resolve_headers, write_csv
from .streaming.sinks import shared_folder

ROWS_A_FILE = 4000  # keys of orders
#: Columns of the export that each kind of file has, under its own spellings and in its own order; an unknown one among them.
LAYOUTS = (
    {"Invoice Number": "Invoice Number", "Issue-Date": "Issue-Date", "CURRENCY": "CURRENCY", "Item.Name": "Item.Name", "qty": "qty", "line amount": "line amount", "VAT-Rate": "VAT-Rate"},
    {"GST Rate": "VAT-Rate", "line_total": "line amount", "Description": "Item.Name", "Notes, if any": "uom", "Currency Code": "CURRENCY", "date": "Issue-Date", "Voucher No.": "Invoice Number"},
    {"BT-1": "Invoice Number", "Document Number": "BT-106", "bt2": "Issue-Date", "BT-131": "line amount"},
)
FOUND = ("invoice_number", "issue_date", "currency", "line_description", "line_quantity", "line_net", "line_tax_rate")


def _as_files(rows: DataFrame) -> DataFrame:
    fields = lambda layout: F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for name, c in layout.items()])
    number = F.floor(F.floor(F.col("row_idx") / 1000) / ROWS_A_FILE).cast("int")
    kind = F.pmod("part", F.lit(len(LAYOUTS)))
    chosen: Column = F.coalesce(*[F.when(kind == i, fields(layout)) for i, layout in enumerate(LAYOUTS)])
    return rows.withColumn("part", number).select(F.col("part").alias("file"), "row_idx", chosen.alias("fields"))


def csv_by_header(spark: SparkSession, d: str) -> DataFrame:
    """The export as CSV files with unlike headers, read back by the header of each."""
    path = shared_folder(spark, "csv-export")
    write_csv(_as_files(export_rows(spark, d)), path)
    rows = resolve_headers(read_csv(spark, path))
    return rows.select(F.regexp_extract("file", r"file=(\d+)/", 1).cast("int").alias("part"), "row_idx", *FOUND)


QUERIES = (csv_by_header,)


def oracles() -> dict[str, str]:
    kind = f"part % {len(LAYOUTS)}"
    value = lambda c: f"nullif(trim(CAST({c} AS VARCHAR)), '')"
    first = lambda c: f"CASE WHEN {kind} < 2 THEN {value(c)} END"
    columns = [
        # of two spellings in a file of the third kind, the later one wins where it is not blank
        f"CASE WHEN {kind} = 2 THEN coalesce({value(chr(34) + 'BT-106' + chr(34))}, {value(chr(34) + 'Invoice Number' + chr(34))}) ELSE {value(chr(34) + 'Invoice Number' + chr(34))} END", value('"Issue-Date"'),
        first('"CURRENCY"'), first('"Item.Name"'), f"CASE WHEN {kind} = 0 THEN {value('qty')} END", value('"line amount"'), first('"VAT-Rate"'),
    ]
    source = EXPORT.replace("{invoices}", "invoices").replace("{rows}", "line_rows")
    return {
        "csv_by_header": f"{DUCK_WITH}, raw AS ({source}), p AS (SELECT *, CAST(row_idx // 1000 // {ROWS_A_FILE} AS INT) AS part FROM raw) "
                         f"SELECT part, row_number() OVER (PARTITION BY part ORDER BY row_idx) - 1 AS row_idx, {', '.join(f'{c} AS {n}' for c, n in zip(columns, FOUND))} FROM p",
    }
