"""The rule pack: each rule is data plus a column predicate that says when it holds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.codelists import LISTS, CodeList
from ..functions.text import edged, filled, is_date, is_decimal, to_date, to_decimal

SEVERITIES = ("fatal", "error", "warning")


@dataclass(frozen=True)
class Rule:
    id: str
    grain: str  # document, line or subtotal
    severity: str
    term: str | None
    failure: str
    value: str | None  # column whose shape a finding shows
    holds: Callable[[], Column]
    expected: str
    code_list: str | None = None  # the list that the rule looks its value up in
    report: bool = False  # fires when its predicate is true, not when it is false

    def satisfied(self) -> Column:
        return ~self.holds() if self.report else self.holds()


def _present(name: str) -> Callable[[], Column]:
    return lambda: filled(F.col(name))


def _form(name: str, pattern: str, absent: bool = True) -> Callable[[], Column]:
    return lambda: (F.col(name).isNull() if absent else F.lit(False)) | F.coalesce(F.col(name), F.lit("")).rlike(pattern)


def _cents(name: str) -> Callable[[], Column]:
    return _form(name, r"^-?[0-9]+(\.[0-9]{1,2})?\z")


def _listed(name: str, codes: tuple[str, ...]) -> Callable[[], Column]:
    return lambda: ~filled(F.col(name)) | F.col(name).isin(*codes)


def _equal(left: str, right: Callable[[], Column], *needed: str) -> Callable[[], Column]:
    def holds() -> Column:
        known = is_decimal(F.col(left))
        for n in needed:
            known = known & is_decimal(F.col(n))
        return ~known | (to_decimal(F.col(left)) == right())

    return holds


def _trn(name: str) -> Callable[[], Column]:
    return lambda: ~filled(F.col(name)) | edged(F.col(name)).rlike(r"^[0-9]{15}\z")


def _due() -> Column:
    both = is_date(F.col("due_date")) & is_date(F.col("issue_date"))
    return ~both | (to_date(F.col("due_date")) >= to_date(F.col("issue_date")))


D, L, S = "document", "line", "subtotal"


def core(lists: dict[str, CodeList] = LISTS) -> list[Rule]:
    """The rules that every profile has, with ``lists`` inlined."""
    types, currencies, units, taxes = (lists[x].codes for x in ("UNCL1001", "ISO4217", "UNECE_REC20", "UNTDID5305"))
    return [
        Rule("R-001", D, "fatal", "BT-1", "missing_mandatory", "id", _present("id"), "an invoice number"),
        Rule("R-002", D, "fatal", "BT-2", "missing_mandatory", "issue_date", _present("issue_date"), "an issue date"),
        Rule("R-003", D, "error", "BT-2", "date_logic", "issue_date", lambda: ~filled(F.col("issue_date")) | is_date(F.col("issue_date")), "an ISO date"),
        Rule("R-004", D, "error", "BT-3", "missing_mandatory", "type_code", _present("type_code"), "a type code"),
        Rule("R-005", D, "warning", "BT-3", "invalid_code", "type_code", _listed("type_code", types), "a listed type code", "UNCL1001"),
        Rule("R-006", D, "fatal", "BT-5", "format_mismatch", "currency", _form("currency", r"^[A-Z]{3}\z", False), "three capital letters"),
        Rule("R-007", D, "warning", "BT-5", "invalid_code", "currency", lambda: ~F.coalesce(F.col("currency"), F.lit("")).rlike(r"^[A-Z]{3}\z") | F.col("currency").isin(*currencies), "a listed currency", "ISO4217"),
        Rule("R-008", D, "fatal", "BT-27", "missing_mandatory", "seller_name", _present("seller_name"), "a seller name"),
        Rule("R-009", D, "fatal", "BT-44", "missing_mandatory", "buyer_name", _present("buyer_name"), "a buyer name"),
        Rule("R-010", D, "fatal", "BG-25", "cardinality", None, lambda: F.col("n_lines") >= 1, "at least one line"),
        Rule("R-011", D, "fatal", "BT-106", "arithmetic_mismatch", "line_total", _equal("line_total", lambda: F.col("line_sum").cast("decimal(38,9)")), "the sum of the line amounts"),
        Rule("R-012", D, "fatal", "BT-112", "arithmetic_mismatch", "tax_inclusive", _equal("tax_inclusive", lambda: to_decimal(F.col("tax_exclusive")) + to_decimal(F.col("tax_total")), "tax_exclusive", "tax_total"), "the total without tax plus tax"),
        Rule("R-013", D, "fatal", "BT-115", "missing_mandatory", "payable", _present("payable"), "an amount due"),
        Rule("R-014", D, "error", "BT-106", "rounding", "line_total", _cents("line_total"), "at most two decimals"),
        Rule("R-015", D, "error", "BT-110", "rounding", "tax_total", _cents("tax_total"), "at most two decimals"),
        Rule("R-016", L, "fatal", "BT-131", "missing_mandatory", "amount", _present("amount"), "a line amount"),
        Rule("R-017", L, "fatal", "BT-151", "missing_mandatory", "tax_category", _present("tax_category"), "a tax category"),
        Rule("R-018", L, "fatal", "BT-151", "invalid_code", "tax_category", _listed("tax_category", taxes), "a listed tax category", "UNTDID5305"),
        Rule("R-019", L, "error", "BT-130", "invalid_code", "unit", _form("unit", r"^[A-Z0-9]{1,3}\z"), "one to three capitals or digits"),
        Rule("R-020", L, "warning", "BT-130", "invalid_code", "unit", lambda: ~F.coalesce(F.col("unit"), F.lit("")).rlike(r"^[A-Z0-9]{1,3}\z") | F.col("unit").isin(*units), "a listed unit", "UNECE_REC20"),
        Rule("R-021", L, "error", "BT-153", "missing_mandatory", "item_name", _present("item_name"), "an item name"),
        Rule("R-022", D, "fatal", "BT-25", "cross_field_dependency", "predecessor_ref", lambda: (F.col("root") != "CreditNote") | filled(F.col("predecessor_ref")), "a preceding invoice"),
        Rule("R-023", D, "error", "BT-9", "date_logic", "due_date", _due, "a due date on or after the issue date"),
        Rule("R-024", S, "fatal", "BT-118", "invalid_code", "tax_category", _listed("tax_category", taxes), "a listed tax category", "UNTDID5305"),
        Rule("R-025", D, "error", "BT-115", "arithmetic_mismatch", "payable", _equal("payable", lambda: to_decimal(F.col("tax_inclusive")) - F.coalesce(to_decimal(F.col("prepaid")), F.lit(0).cast("decimal(38,9)")), "tax_inclusive"), "the total with tax less prepaid"),
        Rule("R-026", D, "error", "BT-40", "identifier_invalid", "seller_country", _form("seller_country", r"^[A-Z]{2}\z"), "two capital letters"),
    ]


CORE = core()
NATIONAL = [
    Rule("R-040", D, "fatal", "BT-31", "missing_mandatory", "seller_trn", _present("seller_trn"), "a seller tax number"),
    Rule("R-041", D, "fatal", "BT-48", "missing_mandatory", "buyer_trn", _present("buyer_trn"), "a buyer tax number"),
    Rule("R-042", D, "fatal", "BT-48", "identifier_invalid", "buyer_trn", _trn("buyer_trn"), "15 digits"),
    Rule("R-043", D, "fatal", "BT-31", "identifier_invalid", "seller_trn", _trn("seller_trn"), "15 digits"),
    Rule("R-044", D, "error", None, "missing_mandatory", "customization_id", _present("customization_id"), "a customization id"),
    Rule("R-045", D, "error", "BT-55", "missing_mandatory", "buyer_country", _present("buyer_country"), "a buyer country"),
]
NETWORK = [
    Rule("R-060", D, "fatal", None, "missing_mandatory", "customization_id", _present("customization_id"), "a customization id"),
    Rule("R-061", D, "fatal", None, "missing_mandatory", "profile_id", _present("profile_id"), "a profile id"),
    Rule("R-062", D, "error", "BT-10", "cross_field_dependency", "buyer_ref", lambda: filled(F.col("buyer_ref")) | filled(F.col("order_ref")), "a buyer or order reference"),
]
ALL = [*CORE, *NATIONAL, *NETWORK]
# The rules of each profile, and the profiles that are under quarantine.
PROFILES = {"en16931": (), "pint-ae": tuple(NATIONAL), "peppol-bis-3.0": tuple(NETWORK)}
QUARANTINED = {"peppol-bis-3.0"}


def pack(profile: str, lists: dict[str, CodeList] = LISTS, quarantined: bool = False) -> list[Rule]:
    """The rules of a profile, its own first. A profile under quarantine is refused unless ``quarantined`` is set."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}")
    if profile in QUARANTINED and not quarantined:
        raise ValueError(f"profile {profile} is under quarantine")
    rules = [*PROFILES[profile], *core(lists)]
    check(rules, lists)
    return rules


def check(rules: list[Rule], lists: dict[str, CodeList] = LISTS) -> None:
    """Refuse a pack with duplicate ids, unknown severities or a partial list that denies."""
    ids = [r.id for r in rules]
    if len(ids) != len(set(ids)):
        raise ValueError("duplicate rule id")
    for r in rules:
        if r.severity not in SEVERITIES or not r.expected:
            raise ValueError(f"{r.id}: unknown severity or no description")
        if r.code_list and r.severity != "warning" and not lists[r.code_list].may_deny():
            raise ValueError(f"{r.id}: a partial code list may not deny")


DEFAULT = pack("pint-ae")
