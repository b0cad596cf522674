"""UBL texts: a serialiser (an absent term is omitted, never emptied) and a scan with a fixed schema.

The scan gives every business term of a document, its lines and its tax subtotals. A text that is no XML, has another
root, or repeats an element of which a rule takes one, can't be judged: it is ``refused`` with the reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from ..functions.text import apart, to_decimal, xml_escape
from ..operators.evaluate import OPEN, node_findings, weight
from ..plans.rules import DEFAULT, Rule, check
from . import plain

cloudpickle.register_pickle_by_value(plain)  # the scan travels to the executors, which need not have this package

AMOUNT = "struct<_VALUE:string,_currencyID:string>"
PARTY = "struct<Party:struct<PostalAddress:struct<Country:struct<IdentificationCode:string>>,PartyTaxScheme:array<struct<CompanyID:string>>,PartyLegalEntity:struct<RegistrationName:string>>>"
CATEGORY = "struct<ID:string,Percent:string>"
QUANTITY = "struct<_VALUE:string,_unitCode:string>"
LINE = f"struct<ID:string,InvoicedQuantity:{QUANTITY},CreditedQuantity:{QUANTITY},LineExtensionAmount:{AMOUNT},Item:struct<Name:string,ClassifiedTaxCategory:{CATEGORY}>,Price:struct<PriceAmount:{AMOUNT}>>"
TOTALS = ("LineExtensionAmount", "AllowanceTotalAmount", "ChargeTotalAmount", "TaxExclusiveAmount", "TaxInclusiveAmount", "PrepaidAmount", "PayableAmount")
TEXTS = ("CustomizationID", "ProfileID", "ID", "IssueDate", "DueDate", "InvoiceTypeCode", "CreditNoteTypeCode", "Note", "DocumentCurrencyCode", "TaxCurrencyCode", "BuyerReference")
SCHEMA = (
    ", ".join(f"{x} string" for x in TEXTS)
    + ", OrderReference struct<ID:string>, BillingReference struct<InvoiceDocumentReference:struct<ID:string,IssueDate:string>>"
    + f", AccountingSupplierParty {PARTY}, AccountingCustomerParty {PARTY}"
    + f", TaxTotal array<struct<TaxAmount:{AMOUNT},TaxSubtotal:array<struct<TaxableAmount:{AMOUNT},TaxAmount:{AMOUNT},TaxCategory:{CATEGORY}>>>>"
    + f", LegalMonetaryTotal struct<{','.join(f'{x}:{AMOUNT}' for x in TOTALS)}>"
    + f", InvoiceLine array<{LINE}>, CreditNoteLine array<{LINE}>, _corrupt_record string"
)
OPTIONS = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}
LINES = "array<struct<line:int,id:string,amount:string,price:string,tax_category:string,percent:string,item_name:string,quantity:string,unit:string>>"
SUBTOTALS = "array<struct<taxable:string,tax:string,category:string,percent:string>>"
HEAD = plain.HEAD
SPACES = 'xmlns="urn:oasis:names:specification:ubl:schema:xsd:{0}-2" xmlns:cac="urn:oasis:names:specification:ubl:schema:xsd:CommonAggregateComponents-2" xmlns:cbc="urn:oasis:names:specification:ubl:schema:xsd:CommonBasicComponents-2"'


def _leaf(name: str, c: Column, attribute: str = "", value: Column | None = None) -> Column:
    """An element of text; nothing where the text is absent. ``attribute`` with ``value`` where that is there."""
    extra = F.lit("") if value is None else F.coalesce(F.concat(F.lit(f' {attribute}="'), xml_escape(value), F.lit('"')), F.lit(""))
    return F.coalesce(F.concat(F.lit(f"<cbc:{name}"), extra, F.lit(">"), xml_escape(c), F.lit(f"</cbc:{name}>")), F.lit(""))


def _group(name: str, *parts: Column, there: Column | None = None) -> Column:
    """An element of elements; nothing where all of them are absent. The parts are named once, as each mention is evaluated anew
    and groups are nested; their texts are escaped, so that the empty element can only be this one. ``there`` says the same of the
    values beforehand and spares the search."""
    start, end = f"<cac:{name}>", f"</cac:{name}>"
    if there is not None:
        return F.when(there, F.concat(F.lit(start), *parts, F.lit(end))).otherwise("")
    return F.replace(F.concat(F.lit(start), *parts, F.lit(end)), F.lit(start + end), F.lit(""))


def _any(*values: Column) -> Column:
    return reduce(Column.__or__, [v.isNotNull() for v in values])


def _party(name: str, trn: Column, legal: Column, country: Column) -> Column:
    address = _group("PostalAddress", _group("Country", _leaf("IdentificationCode", country), there=_any(country)), there=_any(country))
    party = _group("Party", address, _group("PartyTaxScheme", _leaf("CompanyID", trn), there=_any(trn)), _group("PartyLegalEntity", _leaf("RegistrationName", legal), there=_any(legal)), there=_any(trn, legal, country))
    return _group(name, party, there=_any(trn, legal, country))


def group_lines(lines: DataFrame, *more: Column) -> DataFrame:
    """k, the texts of an invoice's lines in their order (items: line, xml and subtotal) and the aggregates ``more``. What hangs on the
    invoice is left open by marks that no escaped text holds: <l>, <q> and <c>."""
    amount = F.coalesce(F.concat(F.lit("<cbc:LineExtensionAmount<c>>"), xml_escape(F.col("amount")), F.lit("</cbc:LineExtensionAmount>")), F.lit(""))
    name, tax = F.col("item_name"), F.col("tax_category")
    body = (_leaf("ID", F.col("line").cast("string")), _leaf("<q>", F.col("quantity").cast("string"), "unitCode", F.col("unit")), amount, _group("Item", _leaf("Name", name), _group("ClassifiedTaxCategory", _leaf("ID", tax), there=_any(tax)), there=_any(name, tax)))
    item = F.struct(apart(F.col("line")).alias("line"), F.concat(F.lit("<cac:<l>>"), *body, F.lit("</cac:<l>>")).alias("xml"), _group("TaxSubtotal", _group("TaxCategory", _leaf("ID", tax), there=_any(tax)), there=_any(tax)).alias("subtotal"))
    return lines.select("*", item.alias("item")).groupBy("k").agg(F.sort_array(F.collect_list("item")).alias("items"), *more)


def to_ubl(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """k and xml of every invoice. A credit note switches the names of its type, lines and quantities; totals that are
    not known are omitted; a tax subtotal stands for each tax category of the lines."""
    return document_texts(invoices.join(group_lines(lines), "k", "left"))


def document_texts(joined: DataFrame) -> DataFrame:
    """k and xml of invoices that carry their ``items``, as ``group_lines`` gives them."""
    joined = joined.withColumns({c: F.lit(None).cast("string") for c in ("prepaid", "buyer_ref") if c not in joined.columns})
    credit, money = F.col("root") == "CreditNote", F.col("currency")
    subtotals = F.coalesce(F.array_join(F.array_distinct("items.subtotal"), ""), F.lit(""))
    lines = F.replace(F.coalesce(F.array_join("items.xml", ""), F.lit("")), F.lit("<l>"), F.when(credit, "CreditNoteLine").otherwise("InvoiceLine"))
    lines = F.replace(lines, F.lit("<q>"), F.when(credit, "CreditedQuantity").otherwise("InvoicedQuantity"))
    lines = F.replace(lines, F.lit("<c>"), F.coalesce(F.concat(F.lit(' currencyID="'), xml_escape(money), F.lit('"')), F.lit("")))
    kind = F.when(credit, _leaf("CreditNoteTypeCode", F.col("type_code"))).otherwise(_leaf("InvoiceTypeCode", F.col("type_code")))
    amount = lambda name, c: _leaf(name, F.col(c), "currencyID", money)
    space = F.when(credit, SPACES.format("CreditNote")).otherwise(SPACES.format("Invoice"))
    xml = F.concat(
        F.lit(HEAD + "<"), "root", F.lit(" "), space, F.lit(">"), _leaf("CustomizationID", F.col("customization_id")), _leaf("ProfileID", F.col("profile_id")), _leaf("ID", F.col("id")), _leaf("IssueDate", F.col("issue_date")),
        _leaf("DueDate", F.col("due_date")), kind, _leaf("DocumentCurrencyCode", money), _leaf("BuyerReference", F.col("buyer_ref")), _group("OrderReference", _leaf("ID", F.col("order_ref")), there=_any(F.col("order_ref"))),
        _group("BillingReference", _group("InvoiceDocumentReference", _leaf("ID", F.col("predecessor_ref")), there=_any(F.col("predecessor_ref"))), there=_any(F.col("predecessor_ref"))),
        _party("AccountingSupplierParty", F.col("seller_trn"), F.col("seller_name"), F.col("seller_country")), _party("AccountingCustomerParty", F.col("buyer_trn"), F.col("buyer_name"), F.col("buyer_country")),
        _group("TaxTotal", amount("TaxAmount", "tax_total"), subtotals),
        _group("LegalMonetaryTotal", amount("LineExtensionAmount", "line_total"), amount("TaxExclusiveAmount", "tax_exclusive"), amount("TaxInclusiveAmount", "tax_inclusive"), amount("PrepaidAmount", "prepaid"), amount("PayableAmount", "payable")),
        lines, F.lit("</"), apart(F.col("root")), F.lit(">"),
    )
    return joined.select("k", xml.alias("xml"))


def read_ubl(spark: SparkSession, path: str) -> DataFrame:
    """k (the file's path) and xml of every file under ``path``."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("k"), F.col("value").alias("xml"))


def _terms() -> dict[str, Column]:
    d = lambda path: F.col(f"d.{path}")
    value = lambda path: F.when(d(path).isNotNull(), F.coalesce(d(f"{path}._VALUE"), F.lit("")))  # noqa: E731  NULL: absent, '': empty
    trn = lambda side: F.try_element_at(d(f"{side}.Party.PartyTaxScheme"), F.lit(1))["CompanyID"]
    seller, buyer = "AccountingSupplierParty", "AccountingCustomerParty"
    tax = F.try_element_at(d("TaxTotal"), F.lit(1))["TaxAmount"]
    totals = dict(zip(("BT-106", "BT-107", "BT-108", "BT-109", "BT-112", "BT-113", "BT-115"), TOTALS))
    return {
        "BT-1": d("ID"), "BT-2": d("IssueDate"), "BT-3": F.when(F.col("root") == "CreditNote", d("CreditNoteTypeCode")).otherwise(d("InvoiceTypeCode")), "BT-5": d("DocumentCurrencyCode"), "BT-6": d("TaxCurrencyCode"), "BT-9": d("DueDate"), "BT-10": d("BuyerReference"),
        "BT-13": d("OrderReference.ID"), "BT-22": d("Note"), "BT-25": d("BillingReference.InvoiceDocumentReference.ID"), "BT-26": d("BillingReference.InvoiceDocumentReference.IssueDate"),
        "BT-27": d(f"{seller}.Party.PartyLegalEntity.RegistrationName"), "BT-31": trn(seller), "BT-40": d(f"{seller}.Party.PostalAddress.Country.IdentificationCode"),
        "BT-44": d(f"{buyer}.Party.PartyLegalEntity.RegistrationName"), "BT-48": trn(buyer), "BT-55": d(f"{buyer}.Party.PostalAddress.Country.IdentificationCode"),
        "BT-110": F.when(tax.isNotNull(), F.coalesce(tax["_VALUE"], F.lit(""))), **{term: value(f"LegalMonetaryTotal.{name}") for term, name in totals.items()},
    }


#: The business terms that ``parse_ubl`` gives.
TERMS = plain.TERMS


def parse_ubl(texts: DataFrame) -> DataFrame:
    """k, root, terms (map of business terms), customization_id, profile_id, lines, subtotals and refused (malformed, root,
    repeated or NULL) of each text (k, xml). ``from_xml`` reads every text that the quick scan left; of the others it gets NULL."""
    schema = StructType([texts.schema["k"], *(StructField(x, StringType()) for x in ("xml", "root", *plain.FIELDS)), StructField("lines", DataType.fromDDL(LINES)), StructField("subtotals", DataType.fromDDL(SUBTOTALS))])
    quick = texts.select("k", "xml").mapInArrow(plain.scan, schema)
    once = F.explode(F.array(F.from_xml("xml", SCHEMA, OPTIONS))).alias("d")  # exploded: each text is parsed once, not once a field
    name = F.regexp_extract("xml", r"^\s*(?:<\?[^>]*>\s*|<!--.*?-->\s*)*<(?:[\w.-]+:)?([\w.-]+)", 1)
    parsed = quick.select("k", F.coalesce("root", name).alias("root"), F.col("root").isNotNull().alias("plain"), *[F.col(f"`{x}`") for x in plain.FIELDS], F.col("lines").alias("plain_lines"), F.col("subtotals").alias("plain_subtotals"), once)
    credit = F.col("root") == "CreditNote"
    amount = lambda x: F.when(x.isNotNull(), F.coalesce(x["_VALUE"], F.lit("")))

    def line(x: Column, i: Column) -> Column:
        quantity = F.when(credit, x["CreditedQuantity"]).otherwise(x["InvoicedQuantity"])
        return F.struct(
            (i + 1).alias("line"), x["ID"].alias("id"), amount(x["LineExtensionAmount"]).alias("amount"), amount(x["Price"]["PriceAmount"]).alias("price"), x["Item"]["ClassifiedTaxCategory"]["ID"].alias("tax_category"),
            x["Item"]["ClassifiedTaxCategory"]["Percent"].alias("percent"), x["Item"]["Name"].alias("item_name"), quantity["_VALUE"].alias("quantity"), quantity["_unitCode"].alias("unit"),
        )

    lines = F.transform(F.when(credit, F.col("d.CreditNoteLine")).otherwise(F.col("d.InvoiceLine")), line)
    each = F.flatten(F.transform("d.TaxTotal", lambda t: F.coalesce(t["TaxSubtotal"], F.array().cast(f"array<struct<TaxableAmount:{AMOUNT},TaxAmount:{AMOUNT},TaxCategory:{CATEGORY}>>"))))
    subtotals = F.transform(each, lambda x: F.struct(amount(x["TaxableAmount"]).alias("taxable"), amount(x["TaxAmount"]).alias("tax"), x["TaxCategory"]["ID"].alias("category"), x["TaxCategory"]["Percent"].alias("percent")))
    repeated = (F.size("d.TaxTotal") > 1) | (F.size("d.AccountingSupplierParty.Party.PartyTaxScheme") > 1) | (F.size("d.AccountingCustomerParty.Party.PartyTaxScheme") > 1)
    refused = F.when(F.col("plain"), None).when(F.col("d").isNull() | F.col("d._corrupt_record").isNotNull(), "malformed").when(~F.col("root").isin("Invoice", "CreditNote"), "root").when(F.coalesce(repeated, F.lit(False)), "repeated")
    terms = F.create_map(*[x for term, c in _terms().items() for x in (F.lit(term), F.coalesce(f"`{term}`", c))])
    either = lambda quick, c, kind: F.when(F.col("plain"), F.col(quick)).otherwise(F.coalesce(c, F.array().cast(kind)))
    return parsed.select(
        "k", "root", terms.alias("terms"), F.coalesce("customization_id", "d.CustomizationID").alias("customization_id"), F.coalesce("profile_id", "d.ProfileID").alias("profile_id"),
        either("plain_lines", lines, LINES).alias("lines"), either("plain_subtotals", subtotals, SUBTOTALS).alias("subtotals"), refused.alias("refused"),
    )


#: The field that each business term is to the rules.
FIELDS = {
    "BT-1": "id", "BT-2": "issue_date", "BT-3": "type_code", "BT-5": "currency", "BT-9": "due_date", "BT-10": "buyer_ref", "BT-13": "order_ref", "BT-25": "predecessor_ref", "BT-27": "seller_name", "BT-31": "seller_trn", "BT-40": "seller_country",
    "BT-44": "buyer_name", "BT-48": "buyer_trn", "BT-55": "buyer_country", "BT-106": "line_total", "BT-109": "tax_exclusive", "BT-110": "tax_total", "BT-112": "tax_inclusive", "BT-113": "prepaid", "BT-115": "payable",
}


def _documents(parsed: DataFrame) -> DataFrame:
    """One row per document: the fields that rules name, and its judged elements as the array ``nodes``."""
    none = F.lit(None).cast("string")
    node = lambda grain, i, amount, category, unit, name: F.struct(F.lit(grain).alias("grain"), i.cast("int").alias("node"), amount.alias("amount"), category.alias("tax_category"), unit.alias("unit"), name.alias("item_name"))
    all_nodes = F.concat(
        F.array(node("document", F.lit(0), none, none, none, none)), F.transform("lines", lambda x: node("line", x["line"], x["amount"], x["tax_category"], x["unit"], x["item_name"])),
        F.transform("subtotals", lambda x, i: node("subtotal", i + 1, none, x["category"], none, none)),
    )
    all_nodes = F.when(F.col("refused").isNull(), all_nodes).otherwise(F.array(node("refused", F.lit(0), none, none, none, none)))
    total = F.aggregate("lines", F.lit(0).cast("decimal(38,9)"), lambda a, x: (a + F.coalesce(to_decimal(x["amount"]), F.lit(0).cast("decimal(38,9)"))).cast("decimal(38,9)"))
    fields = [F.col("terms")[term].alias(name) for term, name in FIELDS.items()]
    return parsed.select("k", "root", "refused", "customization_id", "profile_id", F.size("lines").alias("n_lines"), total.alias("line_sum"), *fields, all_nodes.alias("nodes"))


def nodes(parsed: DataFrame) -> DataFrame:
    """One row per judged element of each document: the document, its lines and tax subtotals, each with the document's fields.
    grain, node: what it is and its position. A refused document has one row of grain ``refused``, with the reason."""
    docs = _documents(parsed)
    return docs.select(*[c for c in docs.columns if c != "nodes"], F.explode("nodes").alias("x")).select("*", "x.*").drop("x")


#: Stands for the refusal of a document: it never has an answer.
REFUSAL = Rule("refused", "refused", "fatal", None, "parse_error", None, lambda: F.lit(None).cast("boolean"), "a document that can be read")


def judge(texts: DataFrame, rules: list[Rule] = DEFAULT) -> DataFrame:
    """k, root, rule_id, grain, node, outcome and message of each finding; a refused document has one row of outcome ``no_verdict``,
    whose rule_id is NULL and whose message is the reason."""
    found = node_findings(nodes(parse_ubl(texts)), rules, keep=("root", "refused"), refusal=REFUSAL)
    grain = F.when(F.col("refused").isNull(), F.col("grain")).otherwise("document")
    return found.select("k", "root", F.when(F.col("refused").isNull(), F.col("rule_id")).alias("rule_id"), grain.alias("grain"), "node", "outcome", F.coalesce("refused", "message").alias("message"))


def tally(texts: DataFrame, rules: list[Rule] = DEFAULT) -> DataFrame:
    """One row: texts, ``findings`` with a verdict and those without one (``open``, refused documents among them), as ``judge`` gives
    them. A document's own rules are weighed before its elements are exploded, so that these carry no field of it."""
    check(rules)
    own = F.when(F.col("refused").isNull(), weight(rules, "document")).otherwise(F.lit(OPEN))
    each = _documents(parse_ubl(texts)).select(own.alias("own"), F.explode("nodes").alias("x")).select("own", "x.*")
    whole = lambda grain: grain.isin("document", "refused")
    found = each.select(whole(apart(F.col("grain"))).alias("whole"), F.when(whole(F.col("grain")), F.col("own")).when(F.col("grain") == "line", weight(rules, "line")).otherwise(weight(rules, "subtotal")).alias("w"))
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("w") % OPEN, F.floor(F.col("w") / OPEN))]
    return found.agg(F.count_if("whole").alias("texts"), sums[0].alias("findings"), sums[1].alias("open"))


GOOD = {
    "k": 1, "root": "Invoice", "customization_id": "c", "profile_id": "p", "id": "A-1", "issue_date": "2026-07-01", "due_date": "2026-07-31", "type_code": "380", "currency": "AED", "buyer_ref": "r", "order_ref": "o", "predecessor_ref": None,
    "seller_name": "s", "seller_trn": "1" * 15, "seller_country": "AE", "buyer_name": "b", "buyer_trn": "2" * 15, "buyer_country": "AE", "tax_total": "0.05", "line_total": "1.00", "tax_exclusive": "1.00", "tax_inclusive": "1.05", "prepaid": None, "payable": "1.05",
}


def self_test(spark: SparkSession, rules: list[Rule] = DEFAULT) -> None:
    """Raise unless a known-good document, written and read back, passes without a finding."""
    schema = ", ".join(f"{c} {'long' if c == 'k' else 'string'}" for c in GOOD)
    lines = spark.createDataFrame([(1, 1, "1.00", "item", "S", "H87", "1")], "k long, line int, amount string, item_name string, tax_category string, unit string, quantity string")
    found = judge(to_ubl(spark.createDataFrame([tuple(GOOD.values())], schema), lines), rules).collect()
    if found:
        raise ValueError("self-test failed: " + ", ".join(sorted(str(r.rule_id) for r in found)))
