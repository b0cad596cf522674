"""CSV exports: header spellings, accepted rows, and the order tables written as such an export."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fixtures import invoice_rows

# Accepted spellings of each column, compared in lower case without spaces, hyphens, underscores and dots.
ALIASES = {
    "invoice_number": ("invoicenumber", "invoiceno", "documentnumber", "voucherno", "bt1"), "issue_date": ("issuedate", "invoicedate", "date", "bt2"), "doc_type": ("doctype", "documenttype", "type"), "scenario": ("scenario", "supplytype"),
    "currency": ("currency", "currencycode", "bt5"), "buyer_name": ("buyername", "customername", "partyname", "bt44"), "buyer_trn": ("buyertrn", "customertrn", "buyervatid", "customergstin", "bt48"),
    "seller_trn": ("sellertrn", "suppliertrn", "companytrn", "companygstin", "bt31"), "predecessor_ref": ("predecessorref", "originalinvoice", "referenceinvoice", "bt25"), "line_extension": ("lineextensionamount", "netamount", "subtotal", "bt106"),
    "tax_amount": ("taxamount", "vatamount", "gstamount", "bt110"), "payable": ("payableamount", "grandtotal", "invoicetotal", "total", "bt115"), "line_number": ("linenumber", "lineno", "srno"), "line_description": ("linedescription", "itemname", "description", "bt153"),
    "line_quantity": ("linequantity", "quantity", "qty", "bt129"), "line_unit": ("lineunitcode", "unitcode", "uom", "unit", "bt130"), "line_net": ("linenetamount", "lineamount", "linetotal", "bt131"),
    "line_tax_category": ("linetaxcategory", "taxcategory", "taxcategorycode", "bt151"), "line_tax_rate": ("linetaxrate", "taxrate", "vatrate", "gstrate", "bt152"),
}

#: The export of the order tables: one row per line, with defects by key. One text for Spark and DuckDB.
EXPORT = """
SELECT CAST(i.k % 7 AS INT) AS file, i.k * 1000 + l.line AS row_idx, i.id AS "Invoice Number", i.issue_date AS "Issue-Date",
       CASE WHEN i.k % 139 = 0 THEN 'Proforma' WHEN i.k % 2 = 0 THEN NULL WHEN i.root = 'CreditNote' THEN 'Credit Note' ELSE 'invoice' END AS doc_type,
       CASE WHEN i.k % 11 = 0 THEN 'Zero-Rated' WHEN i.k % 149 = 0 THEN 'barter' END AS "Supply Type",
       CASE WHEN (i.k + l.line) % 23 = 0 THEN 'USD' WHEN i.k % 5 = 0 THEN ' ' ELSE upper(i.currency) END AS "CURRENCY", i.buyer_trn AS "Buyer TRN",
       CASE WHEN i.k % 3 = 0 THEN i.line_total END AS "BT-106", CASE WHEN (i.k + l.line) % 157 = 0 THEN 'x' WHEN l.line % 2 = 0 THEN CAST(l.line AS VARCHAR(10)) END AS "line_no",
       CASE WHEN (i.k + l.line) % 17 = 0 THEN '' ELSE l.item_name END AS "Item.Name", CASE WHEN (i.k + l.line) % 17 = 0 THEN NULL ELSE '1' END AS qty,
       l.unit AS uom, CASE WHEN (i.k + l.line) % 17 = 0 THEN NULL ELSE l.amount END AS "line amount", CASE WHEN i.k % 151 = 0 THEN NULL ELSE l.tax_category END AS tax_category,
       CASE WHEN l.line % 3 = 0 THEN '5' WHEN i.k % 2 = 0 THEN '0' END AS "VAT-Rate"
FROM {invoices} i JOIN {rows} l ON i.k = l.k
"""


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export's rows; each invoice's fields are on its lines already, so lines are read and exchanged once."""
    return export_of(invoice_rows(spark, sf_dir))


def export_of(rows: DataFrame, *keep: str) -> DataFrame:
    """The same of rows that are there already, beside their own columns ``keep``."""
    text = re.sub(r"\b[il]\.", "x.", EXPORT.replace("{invoices} i JOIN {rows} l ON i.k = l.k", "{rows} x")).replace('"', "`")
    return rows.sparkSession.sql(text.replace("SELECT ", f"SELECT {''.join(f'x.{c}, ' for c in keep)}", 1), rows=rows)


FIELDS = "array<struct<name:string,value:string>>"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files: ``file``, their position ``row_idx`` in it from 0, and ``fields``, the pairs of name and value that the
    file's own header gives (``FIELDS``). Files may have other columns in another order; ragged rows and empty lines are allowed,
    values behind the header's last name have none and are left out, a byte-order mark is dropped. A header's names hold no line
    break. A file is read by one task, so its rows keep their order."""
    first_lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    first_lines = first_lines.where(F.col("at") == 0).where(F.trim("value") != "").groupBy("file").agg(F.min_by("value", "id").alias("header"))
    width = (first_lines.agg(F.max(F.regexp_count("header", F.lit(",")))).first()[0] or 0) + 1  # of the widest header, at most
    options = {"header": False, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "mode": "PERMISSIVE"}
    rows = spark.read.options(**options).schema(", ".join(f"c{i} string" for i in range(width))).csv(path)
    order = Window.partitionBy("file").orderBy("id")
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"), F.array(*[f"c{i}" for i in range(width)]).alias("values"))
    rows = rows.withColumns({"names": F.first("values").over(order), "row_idx": (F.row_number().over(order) - 2).cast("long")}).where("row_idx >= 0")
    pairs = F.zip_with("names", "values", lambda n, v: F.struct(F.when(n.startswith("\ufeff"), F.substring(n, 2, 1 << 30)).otherwise(n).alias("name"), v.alias("value")))
    return rows.select("file", "row_idx", F.filter(pairs, lambda x: x["name"].isNotNull()).alias("fields"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """file and value: the lines of ``write_csv``, those of a file together and in order."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    text = lambda part: F.array_join(F.transform("fields", lambda x: F.coalesce(quote(x[part]), F.lit(""))), ",")
    head = F.row_number().over(Window.partitionBy("file").orderBy("row_idx")) == 1
    rows = rows.repartition("file")  # before the window, which then needs no exchange of its own
    lines = rows.select("file", F.when(head, F.concat_ws("\n", text("name"), text("value"))).otherwise(text("value")).alias("value"), "row_idx")
    return lines.sortWithinPartitions("file", "row_idx").drop("row_idx")


def write_csv(rows: DataFrame, path: str) -> None:
    """``rows`` (file, row_idx and ``fields`` as ``read_csv`` gives them) as one CSV file for each ``file``, in a folder of its
    own, whose header is the names of its first row."""
    csv_lines(rows).write.partitionBy("file").text(path)


def file_defects(spark: SparkSession, path: str) -> DataFrame:
    """file, source_ref and defect_class of files that give no rows: not UTF-8 (``file``), or without a header (``header``)."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"))
    broken = ~F.is_valid_utf8("text")
    blank = F.btrim("text", F.lit("\ufeff \t\r\n,")) == ""
    ref = F.when(broken, "file").when(blank, "header")
    found = files.select("file", ref.alias("source_ref"), F.lit("parse_error").alias("defect_class")).where("source_ref is not null")
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)  # a scan leaves out files of no bytes, so these come from the listing
    statuses = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    empty = [(x.getPath().toString(), "header", "parse_error") for x in statuses if x.isFile() and x.getLen() == 0]
    return found.unionByName(spark.createDataFrame(empty, found.schema))


def read_golden(spark: SparkSession, path: str, expectation: str) -> DataFrame:
    """Cases under ``path``: profile (the folder), name, the document's text and the expectation (``expectation``: its DDL) of
    each pair of NAME.xml and NAME.expected.json; a document without an expectation, or the reverse, has NULLs there."""
    at = lambda c, ending: (F.element_at(F.split(c, "/"), -2).alias("profile"), F.regexp_replace(F.element_at(F.split(c, "/"), -1), ending, "").alias("name"))
    docs = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").text(path).select(*at(F.input_file_name(), r"\.xml$"), F.col("value").alias("xml"))
    files = spark.read.schema(expectation).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.expected.json").json(path)
    return docs.join(files.select(*at(F.input_file_name(), r"\.expected\.json$"), F.struct("*").alias("expected")), ["profile", "name"], "full_outer")


def resolve_headers(rows: DataFrame, keep: tuple[str, ...] = ("file", "row_idx")) -> DataFrame:
    """``keep`` and the canonical columns; of several spellings the last that is not blank wins; blanks become NULL. The
    spellings are the names in ``fields`` where the rows have such a column, or else the columns."""
    if "fields" in rows.columns and rows.schema["fields"].dataType.simpleString() == FIELDS:
        return _resolve_fields(rows, keep)
    known = {alias: key for key, names in ALIASES.items() for alias in names}
    found: dict[str, list[str]] = {}
    for name in rows.columns:
        plain = name.lower().translate({ord(c): None for c in " \t_-."})
        if name not in keep and plain in known:
            found.setdefault(known[plain], []).insert(0, name)
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    value = lambda name: F.nullif(F.trim(quoted(name).cast("string")), F.lit(""))
    columns = [F.coalesce(*map(value, found[k]), F.lit(None)).cast("string").alias(k) if k in found else F.lit(None).cast("string").alias(k) for k in ALIASES]
    return rows.select(*keep, *columns)


def _resolve_fields(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    spelling = F.create_map(*[F.lit(x) for key, names in ALIASES.items() for alias in names for x in (alias, key)])
    known = F.transform("fields", lambda x: F.struct(F.try_element_at(spelling, F.lower(F.translate(x["name"], " \t_.-", ""))).alias("key"), F.nullif(F.trim(x["value"]), F.lit("")).alias("value")))
    found = rows.select(*keep, F.filter(known, lambda x: x["key"].isNotNull() & x["value"].isNotNull()).alias("found"))
    at = lambda k: F.try_element_at(F.filter("found", lambda x: x["key"] == k), F.lit(-1))["value"]
    return found.select(*keep, *[at(k).alias(k) for k in ALIASES])
