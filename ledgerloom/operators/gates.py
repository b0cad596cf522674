"""Gates before validation: mapped terms, confirmation, spec usability, and checks of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Business terms that a mapping must cover.
MANDATORY = ("BT-1", "BT-2", "BT-5", "BT-31", "BT-44", "BT-48", "BT-106", "BT-112")
# Terms that each scenario requires.
REQUIRED = {"standard": ("BT-48", "BT-31", "BT-151"), "reverse_charge": ("BT-48", "BT-31", "BT-121"), "designated_zone": ("BT-48", "BT-31", "BT-121", "BT-20"), "export": ("BT-31", "BT-151")}


def present_terms(terms: dict[str, Column]) -> Column:
    """Terms whose value is there and not blank, in the order given."""
    return F.array_compact(F.array(*[F.when(F.trim(c) != "", F.lit(t)) for t, c in terms.items()]))


def presence(mapping: Column, terms: dict[str, Column]) -> Column:
    """For each mapped term (map of term to the path it comes from) its source and whether the document has it; ``terms`` tells
    which terms are there, and a term that it does not know is not."""
    known = F.create_map(*[x for t, there in terms.items() for x in (F.lit(t), F.coalesce(there, F.lit(False)))])
    return F.transform_values(mapping, lambda term, path: F.struct(path.alias("source"), F.coalesce(F.try_element_at(known, term), F.lit(False)).alias("present")))


def confirm(profiles: DataFrame, at: Column) -> DataFrame:
    """Profiles (mapped: its terms) that may be confirmed, with ``confirmed_at``; one with gaps is refused. Rows are appended,
    never edited."""
    return profiles.where(F.size(mandatory_gaps(F.col("mapped"))) == 0).withColumn("confirmed_at", at)


def mandatory_gaps(mapped: Column) -> Column:
    return F.array_except(F.array(*map(F.lit, MANDATORY)), F.coalesce(mapped, F.array().cast("array<string>")))


def gate(mapped: Column, confirmed_at: Column) -> Column:
    """usable, or why a profile is refused."""
    return F.when(mapped.isNull(), "missing").when(confirmed_at.isNull(), "unconfirmed").when(F.size(mandatory_gaps(mapped)) > 0, "gaps").otherwise("usable")


def spec_gate(quarantined: Column, version: Column, wanted: Column, allow_unresolved: bool = False) -> Column:
    """usable, or why a specification is refused."""
    return F.when(quarantined, "quarantined").when(version.isNull(), "usable" if allow_unresolved else "unresolved").when(version != wanted, "version_mismatch").otherwise("usable")


def scenario_gaps(scenario: Column, present: Column) -> Column:
    """Terms that the scenario requires and the document lacks; an unknown scenario requires none."""
    none = F.array().cast("array<string>")
    need = none
    for name, terms in REQUIRED.items():
        need = F.when(scenario == name, F.array(*map(F.lit, terms))).otherwise(need)
    return F.array_except(need, present)


def orphans(found: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows that refer to a key that is not listed; a load is held while there are any."""
    return found.join(listed.select(key), key, "left_anti")


def next_version(new: DataFrame, existing: DataFrame, key: list[str], order: str) -> DataFrame:
    """``new`` numbered on from the greatest version of each key."""
    top = existing.groupBy(*key).agg(F.max("version").alias("top"))
    w = Window.partitionBy(*key).orderBy(order)
    return new.join(top, key, "left").withColumn("version", F.coalesce("top", F.lit(0)) + F.row_number().over(w)).drop("top")


def until_first_error(found: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Findings without warnings, up to and including the first of each document."""
    w = Window.partitionBy(key).orderBy(*order)
    return found.where("severity <> 'warning'").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def claimed(matches: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of several contexts of a pattern that match a node (``key``: document, pattern and node), the first claims it."""
    w = Window.partitionBy(*key).orderBy(order)
    return matches.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
