"""A quick scan of plain UBL texts. Most texts differ in their values, not in their tags: a sequence of tags is checked once
and gives the places of its values, by which every text with the same tags is read.

Plain is a text whose reading leaves nothing open: elements well nested, no element of which one is taken twice, no text between
elements, no references, comments, sections or instructions, nothing that a parser normalises or refuses. Any other text is
left to ``from_xml``; the scan says of none that it is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa

TERMS = ("BT-1", "BT-2", "BT-3", "BT-5", "BT-6", "BT-9", "BT-10", "BT-13", "BT-22", "BT-25", "BT-26", "BT-27", "BT-31", "BT-40", "BT-44", "BT-48", "BT-55", "BT-110", "BT-106", "BT-107", "BT-108", "BT-109", "BT-112", "BT-113", "BT-115")
FIELDS = (*TERMS, "customization_id", "profile_id")
LINE = ("id", "amount", "price", "tax_category", "percent", "item_name", "quantity")
SUBTOTAL = ("taxable", "tax", "category", "percent")
KINDS = ("Invoice", "CreditNote")
NAME = r"(?:[A-Za-z_][A-Za-z0-9_.-]*:)?([A-Za-z_][A-Za-z0-9_.-]*)"
TAG = re.compile(NAME + r'((?: [A-Za-z_][A-Za-z0-9_.:-]*="[^"]*")*)')
ATTRIBUTE = re.compile(r' ([A-Za-z_][A-Za-z0-9_.:-]*)="([^"]*)"')
HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
USUAL = bytes(range(32, 127)) + b"\n\t"
PLANS = 4096  # kept at most, of headers and of lines each
AMOUNTS = {"LineExtensionAmount", "AllowanceTotalAmount", "ChargeTotalAmount", "TaxExclusiveAmount", "TaxInclusiveAmount", "PrepaidAmount", "PayableAmount", "TaxAmount", "TaxableAmount", "PriceAmount"}
SKIPPED, MANY = object(), "TaxSubtotal"


def _party(trn: str, name: str, country: str) -> dict:
    return {"Party": {"PostalAddress": {"Country": {"IdentificationCode": country}}, "PartyTaxScheme": {"CompanyID": trn}, "PartyLegalEntity": {"RegistrationName": name}}}


def _tree(kind: str) -> dict:
    """The elements of a document that are read, down to the field that each is. Lines are cut off before; here they are SKIPPED
    as elements of the other kind are, but one that stands in the header makes a text not plain."""
    totals = dict(zip(("LineExtensionAmount", "AllowanceTotalAmount", "ChargeTotalAmount", "TaxExclusiveAmount", "TaxInclusiveAmount", "PrepaidAmount", "PayableAmount"), TERMS[18:]))
    return {
        "CustomizationID": "customization_id", "ProfileID": "profile_id", "ID": "BT-1", "IssueDate": "BT-2", "DueDate": "BT-9", f"{kind}TypeCode": "BT-3", "Note": "BT-22", "DocumentCurrencyCode": "BT-5", "TaxCurrencyCode": "BT-6", "BuyerReference": "BT-10",
        "OrderReference": {"ID": "BT-13"}, "BillingReference": {"InvoiceDocumentReference": {"ID": "BT-25", "IssueDate": "BT-26"}}, "AccountingSupplierParty": _party("BT-31", "BT-27", "BT-40"), "AccountingCustomerParty": _party("BT-48", "BT-44", "BT-55"),
        "TaxTotal": {"TaxAmount": "BT-110", MANY: {"TaxableAmount": "taxable", "TaxAmount": "tax", "TaxCategory": {"ID": "category", "Percent": "percent"}}}, "LegalMonetaryTotal": totals,
        "_corrupt_record": None, "InvoiceLine": None, "CreditNoteLine": None,
    }


def _line_tree(kind: str) -> dict:
    quantity = "InvoicedQuantity" if kind == "Invoice" else "CreditedQuantity"
    return {"ID": "id", "LineExtensionAmount": "amount", "Price": {"PriceAmount": "price"}, "Item": {"Name": "item_name", "ClassifiedTaxCategory": {"ID": "tax_category", "Percent": "percent"}}, quantity: "quantity"}


class Plan:
    """Where the values of a sequence of tags are in a text that is cut at its tags; None has no value (``parts`` ends with it)."""

    def __init__(self, form: str, gaps: list[int], fields: list[int], subtotals: list[list[int]], unit: str | None):
        at = [*fields, *(place for x in subtotals for place in x)]
        self.form, self.gaps, self.values, self.subtotals, self.unit = form, itemgetter(*gaps, -1, -1), itemgetter(*at), len(subtotals), unit


def _plan(tags: list[str], root: str, tree: dict, names: tuple[str, ...]) -> Plan | None:
    """The plan of one element with all that it holds; None unless it is plain."""
    fields, subtotals, gaps, unit = dict.fromkeys(names, -1), [], [], None
    open_: list[tuple] = [("", {root: tree}, set())]
    for i, tag in enumerate(tags):
        raw, inside, seen = open_[-1]
        if tag.startswith("/"):
            if len(open_) == 1 or tag[1:] != raw:
                return None
            open_.pop()
            if open_[-1][1] is not SKIPPED:
                gaps.append(2 * i + 2)
            continue
        m = TAG.fullmatch(tag)
        if not m or (i and len(open_) == 1):
            return None
        name, attributes = m[1], ATTRIBUTE.findall(m[2])
        if len({a for a, _ in attributes}) < len(attributes) or isinstance(inside, str):
            return None
        child = SKIPPED
        if inside is not SKIPPED:
            child = inside.get(name, SKIPPED)
            if child is SKIPPED and name.lower() in {x.lower() for x in inside}:
                return None
            if child is not SKIPPED and name in seen and name != MANY or child is None:
                return None
            seen.add(name)
        if isinstance(child, dict):
            if any(a.split(":")[0] != "xmlns" or i for a, _ in attributes):
                return None
            gaps.append(2 * i + 2)
            if name == MANY:
                subtotals.append(dict.fromkeys(SUBTOTAL, -1))
        elif child is not SKIPPED:
            known = {"unitCode"} if child == "quantity" else {"currencyID"} if name in AMOUNTS else {"schemeID", "schemeAgencyID", "listID", "listAgencyID", "languageID"}
            if not {a for a, _ in attributes} <= known:
                return None
            if child == "quantity":
                unit = dict(attributes).get("unitCode")
            (subtotals[-1] if any(x[0].endswith(MANY) for x in open_) else fields)[child] = 2 * i + 2
        open_.append((tag.split(" ", 1)[0], child, set()))
    if len(open_) > 1 or not tags:
        return None
    return Plan("<%s>%s" * len(tags), gaps, list(fields.values()), [list(x.values()) for x in subtotals], unit)


class Scan:
    """Reads texts one by one; what they hold is kept flat, in the order of ``FIELDS``, ``LINE`` and ``SUBTOTAL``."""

    def __init__(self):
        self.headers: dict = {}
        self.lines: dict = {}
        self.start()

    def start(self) -> None:
        self.root, self.fields, self.left = [], [], []
        self.line_at, self.line_values, self.units, self.subtotal_at, self.subtotal_values = [0], [], [], [0], []

    def _part(self, text: str, plans: dict, tree, names: tuple[str, ...], blanks: bool):
        """Plan and values of an element's text; None unless it is plain."""
        parts = text.replace(">", "<").split("<")
        tags = parts[1::2]
        key = "<".join(tags)
        if key in plans:
            plan = plans[key]
        else:
            if len(plans) >= PLANS:
                plans.clear()
            m = TAG.fullmatch(tags[0]) if tags else None
            plan = plans[key] = _plan(tags, m[1], tree(m[1]), names) if m and tree(m[1]) else None
        if plan is None or len(parts) != 2 * len(tags) + 1 or plan.form % tuple(parts[1:]) != text:
            return None
        parts.append("")
        if "".join(plan.gaps(parts)).strip(" \n\t"):
            return None
        parts[-1] = None
        values = plan.values(parts)
        if blanks and any(v and not v.strip(" \n\t") for v in values):  # which elements keep white space alone is the parser's to say
            return None
        return plan, values

    def read(self, xml: str | None) -> bool:
        """Whether the text is plain; if so, what it holds is kept."""
        if xml is None or "&" in xml or not xml.encode().translate(None, USUAL).decode().isprintable():
            return False
        if xml.startswith(HEAD):
            xml = xml[len(HEAD):]
        xml = xml.strip(" \n\t")
        blanks = "> " in xml or "\n" in xml or "\t" in xml
        end = xml.rfind("</")
        root = xml[end + 2:-1]
        kind = root.rsplit(":", 1)[-1]
        if kind not in KINDS:
            return False
        start = f"<cac:{kind}Line>"
        head, *lines = xml[:end].split(start)
        found = self._part(head + xml[end:], self.headers, lambda name: _tree(kind) if name == kind else None, FIELDS, blanks)
        if found is None:
            return False
        plan, values = found
        each, units = [], []
        for line in lines:
            found = self._part(start + line, self.lines, lambda name: _line_tree(kind), LINE, blanks)
            if found is None:
                return False
            each += found[1]
            units.append(found[0].unit)
        self.root.append(kind)
        self.fields += values[:len(FIELDS)]
        self.line_values += each
        self.units += units
        self.subtotal_values += values[len(FIELDS):]
        self.line_at.append(len(self.units))
        self.subtotal_at.append(self.subtotal_at[-1] + plan.subtotals)
        return True

    def skip(self) -> None:
        self.root.append(None)
        self.fields += (None,) * len(FIELDS)
        self.line_at.append(len(self.units))
        self.subtotal_at.append(self.subtotal_at[-1])


def _columns(flat: list, names: tuple[str, ...]) -> dict[str, pa.Array]:
    return {name: pa.array(flat[i::len(names)], pa.string()) for i, name in enumerate(names)}


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, root, ``FIELDS``, lines and subtotals of plain texts; of others ``xml`` as it is, with a root that is NULL."""
    texts = Scan()
    for batch in batches:
        texts.start()
        left = []
        for xml in batch.column("xml").to_pylist():
            plain = texts.read(xml)
            left.append(None if plain else xml)
            if not plain:
                texts.skip()
        line = _columns(texts.line_values, LINE)
        line["quantity"] = pa.array([x or None for x in texts.line_values[len(LINE) - 1::len(LINE)]], pa.string())
        line["unit"] = pa.array(texts.units, pa.string())
        number = [n + 1 for a, b in zip(texts.line_at, texts.line_at[1:]) for n in range(b - a)]
        line = {"line": pa.array(number, pa.int32()), **line}
        subtotal = _columns(texts.subtotal_values, SUBTOTAL)
        nested = lambda at, columns: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))
        columns = {"k": batch.column("k"), "xml": pa.array(left, pa.string()), "root": pa.array(texts.root, pa.string()), **_columns(texts.fields, FIELDS), "lines": nested(texts.line_at, line), "subtotals": nested(texts.subtotal_at, subtotal)}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
