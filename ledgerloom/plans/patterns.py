"""Patterns: which elements a rule judges, and in which order. A pattern's contexts are tried in turn; the first that
matches an element claims it, and only the rules of that context judge it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import PROFILES, Rule

D, L, S = "document", "line", "subtotal"


@dataclass(frozen=True)
class Context:
    name: str
    grain: str
    rules: tuple[str, ...]
    matches: Callable[[], Column] = lambda: F.lit(True)  # NULL: cannot be decided for this element


@dataclass(frozen=True)
class Pattern:
    name: str
    contexts: tuple[Context, ...]


# The order of patterns and of the rules in each.
CORE = (
    Pattern("core-header", (Context("document", D, ("R-001", "R-002", "R-003", "R-004", "R-005", "R-006", "R-007", "R-008", "R-009", "R-010", "R-013", "R-026")),)),
    Pattern("core-arithmetic", (Context("document", D, ("R-011", "R-012", "R-025", "R-014", "R-015", "R-023")),)),
    Pattern("core-creditnote", (Context("credit note", D, ("R-022",), lambda: F.col("root") == "CreditNote"),)),
    Pattern("core-lines", (Context("line", L, ("R-016", "R-017", "R-018", "R-019", "R-020", "R-021")),)),
    Pattern("core-subtotals", (Context("subtotal", S, ("R-024",)),)),
)
NATIONAL = (Pattern("national-identifiers", (Context("document", D, ("R-040", "R-041", "R-042", "R-043", "R-044", "R-045")),)),)
NETWORK = (Pattern("network-identification", (Context("document", D, ("R-060", "R-061", "R-062")),)),)
BY_PROFILE = {"en16931": CORE, "pint-ae": (*NATIONAL, *CORE), "peppol-bis-3.0": (*NETWORK, *CORE)}


def patterns(profile: str) -> tuple[Pattern, ...]:
    """The patterns of a profile, its own first."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}")
    return BY_PROFILE[profile]


def check_patterns(of: tuple[Pattern, ...], rules: list[Rule]) -> None:
    """Refuse patterns that repeat a name, place a rule twice or at another grain than its own, or leave one out."""
    known, placed = {r.id: r for r in rules}, [(c, r) for p in of for c in p.contexts for r in c.rules]
    if len({p.name for p in of}) != len(of):
        raise ValueError("duplicate pattern")
    for c, r in placed:
        if r not in known:
            raise ValueError(f"{r}: unknown rule")
        if known[r].grain != c.grain:
            raise ValueError(f"{r}: judges a {known[r].grain}, not a {c.grain}")
    if len(placed) != len({r for _, r in placed}):
        raise ValueError("a rule stands in two contexts")
    if missing := set(known) - {r for _, r in placed}:
        raise ValueError(f"{min(missing)}: in no pattern")
