"""Accounting vouchers: a scan of XML exports, accepted vouchers as documents with lines, and their defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import exponent, to_minor, to_minor_each
from ..functions.shape import value_shape

# Voucher types that are documents, and the tags of tax registrations in the order in which they count.
TYPES = {"sales": "invoice", "credit note": "credit_note", "debit note": "debit_note"}
PARTY_TRN = ("PARTYGSTIN", "PARTYVATTINNUMBER", "VATTINNUMBER", "PARTYTINNUMBER")
COMPANY_TRN = ("COMPANYGSTIN", "COMPANYVATTINNUMBER", "CMPVATTINNUMBER")
FIELDS = ("VOUCHERTYPENAME", "VOUCHERNUMBER", "DATE", "EFFECTIVEDATE", "CURRENCYNAME", "PARTYLEDGERNAME", "PARTYNAME", "REFERENCE", *PARTY_TRN, *COMPANY_TRN)
ITEMS, LEDGERS = "ALLINVENTORYENTRIES.LIST", "ALLLEDGERENTRIES.LIST"
ITEM = "array<struct<STOCKITEMNAME:string,BILLEDQTY:string,ACTUALQTY:string,AMOUNT:string,RATEOFVAT:string,GSTRATE:string>>"
SCHEMA = ", ".join(f"{f} string" for f in FIELDS) + f", `{ITEMS}` {ITEM}, `{LEDGERS}` array<struct<LEDGERNAME:string,AMOUNT:string>>, _corrupt_record string"


def text(c: Column) -> Column:
    """Trimmed; blank is absent."""
    return F.nullif(F.btrim(c, F.lit(" \t\r\n")), F.lit(""))


def compact_date(c: Column) -> Column:
    """``YYYYMMDD`` or ISO as ISO; anything else is no date."""
    return F.when(c.rlike(r"^\d{8}\z"), F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")).when(c.rlike(r"^\d{4}-\d{2}-\d{2}\z"), c)


def split_quantity(c: Column) -> Column:
    """struct<quantity, unit>: ``10 Nos`` is 10 and Nos; what does not begin with a number is neither."""
    form = r"^\s*([+-]?[\d.,]+)\s*(.*)$"
    some = c.rlike(form)
    return F.struct(F.when(some, F.regexp_extract(c, form, 1)).alias("quantity"), F.when(some, text(F.regexp_extract(c, form, 2))).alias("unit"))


def magnitude(c: Column) -> Column:
    """Without one leading minus: sales stand as credits."""
    return F.regexp_replace(F.trim(c), "^-", "")


def scan(texts: DataFrame, xml: str = "xml") -> DataFrame:
    """Every VOUCHER of each text (file, ``xml``) at any depth, with its position in the file; a text without any, or that
    is no XML, has one row with a NULL voucher. Texts are cut at the voucher element, so a file is never one row of rows."""
    body = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<VOUCHER(?=[\s>/])(?:[^>]*/>|.*?</VOUCHER>)"), F.lit(0))
    rows = texts.select("file", F.posexplode_outer(F.when(F.size(body) > 0, body)).alias("voucher_no", "text"))
    options = {"ignoreSurroundingSpaces": "true", "columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}
    once = F.explode(F.array(F.when(F.col("text").isNotNull(), F.from_xml("text", SCHEMA, options)))).alias("v")  # exploded: parsed once, not once a field
    return rows.select("file", "voucher_no", once)


def accept(vouchers: DataFrame) -> DataFrame:
    """Vouchers with doc_type, invoice_number, issue_date and ``accepted`` (all three known)."""
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    kind = F.try_element_at(known, F.lower(F.coalesce(text(F.col("v.VOUCHERTYPENAME")), F.lit(""))))
    date = compact_date(F.coalesce(text(F.col("v.DATE")), text(F.col("v.EFFECTIVEDATE"))))
    out = vouchers.withColumns({"doc_type": kind, "invoice_number": text(F.col("v.VOUCHERNUMBER")), "issue_date": date})
    return out.withColumn("accepted", F.col("doc_type").isNotNull() & F.col("invoice_number").isNotNull() & F.col("issue_date").isNotNull())


def _known(accepted: DataFrame, currency: str) -> DataFrame:
    """``accepted`` with the values of documents as columns: each is named once and then used, so it is evaluated once. Of a
    voucher that is not accepted they are not read."""
    first = lambda tags: F.coalesce(*[text(F.col(f"v.{t}")) for t in tags])
    rows = accepted.withColumns({
        "currency": F.coalesce(text(F.col("v.CURRENCYNAME")), F.lit(currency)), "buyer_name": F.coalesce(text(F.col("v.PARTYLEDGERNAME")), text(F.col("v.PARTYNAME"))),
        "buyer_trn": first(PARTY_TRN), "seller_trn": first(COMPANY_TRN), "predecessor_ref": text(F.col("v.REFERENCE")),
        "items": F.coalesce(F.when(F.col("accepted"), F.col("v")[ITEMS]), F.array().cast(ITEM)), "ledgers": F.coalesce(F.col("v")[LEDGERS], F.array().cast("array<struct<LEDGERNAME:string,AMOUNT:string>>")),
    })
    party = F.get(F.filter("ledgers", lambda e: text(e["LEDGERNAME"]).eqNullSafe(F.col("buyer_name"))), F.lit(0))
    rows = rows.withColumns({
        "digits": exponent(F.col("currency")), "paid": magnitude(text(party["AMOUNT"])), "n_lines": F.size("items"), "n_ledgers": F.size("ledgers"),
        "amounts": F.transform("items", lambda x: magnitude(text(x["AMOUNT"]))), "rates": F.transform("items", lambda x: F.coalesce(text(x["RATEOFVAT"]), text(x["GSTRATE"]))),
        "quantities": F.transform(F.transform("items", lambda x: F.coalesce(text(x["BILLEDQTY"]), text(x["ACTUALQTY"]))), split_quantity),
    })
    return rows.withColumns({"minors": to_minor_each(F.col("amounts"), F.col("digits")), "payable": to_minor(F.col("paid"), F.col("currency"))})


def documents(accepted: DataFrame, currency: str = "AED") -> DataFrame:
    """One row per accepted voucher, with its lines. The line sum is all or nothing; tax is never derived; the payable
    amount is that of the ledger entry named like the party; more ledger entries than lines and party mean allowances."""
    rows = _known(accepted.where("accepted"), currency)

    def line(x: Column, i: Column) -> Column:
        quantity = F.get("quantities", i)
        return F.struct(
            (i + 1).alias("line"), text(x["STOCKITEMNAME"]).alias("description"), quantity["quantity"].alias("quantity"), quantity["unit"].alias("unit_text"),
            F.get("minors", i)["minor"].alias("minor"), F.get("rates", i).alias("rate"),
        )

    whole = (F.col("n_lines") > 0) & F.forall("minors", lambda x: x["minor"].isNotNull())
    total = F.when(whole, F.aggregate("minors", F.lit(0).cast("long"), lambda a, x: a + x["minor"]))
    return rows.select(
        "file", "voucher_no", "doc_type", F.lit("standard").alias("scenario"), "invoice_number", "issue_date", "currency", "buyer_name", "buyer_trn", "seller_trn", "predecessor_ref",
        total.alias("line_total"), F.lit(None).cast("long").alias("tax_amount"), F.col("payable.minor").alias("payable"), F.col("payable.reason").alias("payable_reason"),
        (F.col("n_ledgers") > F.col("n_lines") + 1).alias("has_allowance"), (F.size(F.array_distinct(F.array_compact("rates"))) > 1).alias("multi_rate"), "n_lines", F.transform("items", line).alias("lines"),
    )


def defects(accepted: DataFrame, docs: DataFrame | None = None, currency: str = "AED") -> DataFrame:
    """file, source_ref, defect_class and shape: files and vouchers that can't be read have no shape. All defects of a voucher
    come from its own row, so vouchers are read once; ``docs``, which callers may give, would have them read again and is not used."""
    at = F.concat(F.lit("voucher["), F.col("voucher_no").cast("string"), F.lit("]"))
    nothing = F.lit(None).cast("string")
    of = lambda when, name, v, ref, shaped=True: F.when(when, F.struct(ref.alias("source_ref"), F.lit(name).alias("defect_class"), v.alias("value"), F.lit(shaped).alias("shaped")))
    ok = F.col("accepted")
    one = F.array(
        of(~ok, "parse_error", nothing, F.coalesce(at, F.lit("file")), False), of(ok & F.col("buyer_trn").isNull(), "trn_missing", nothing, at),
        of(ok & (F.col("payable.reason") == "unknown_currency"), "currency_inconsistent", F.col("currency"), at), of(ok & (F.col("n_lines") > 0), "tax_category_unmapped", nothing, at),
    )
    unit = lambda q, i: of(q["unit"].isNotNull(), "unit_code_freetext", q["unit"], F.concat(F.col("at"), F.lit(".line["), i.cast("string"), F.lit("]")))
    rows = _known(accepted, currency).select("file", at.alias("at"), one.alias("one"), "quantities")
    rows = rows.select("file", F.explode(F.array_compact(F.concat("one", F.transform("quantities", unit)))).alias("x")).select("file", "x.*")
    return rows.select("file", "source_ref", "defect_class", F.when(F.col("shaped"), value_shape(F.col("value"))).alias("shape"))
