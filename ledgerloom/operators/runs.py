"""Work on runs: dispatch of files, claims, identifiers, statuses, catalogues, balances and the result of an audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.rules import QUARANTINED, Rule
from .evaluate import failing, mask_counts

# Statuses of a run in order, identifiers of the profiles that have them, scenario keys of entities,
# least sizes of a balanced set of cases.
STATUSES = ("received", "normalising", "mapping", "validating", "reporting", "complete", "failed")
IDENTIFIERS = {
    ("pint-ae", "billing"): ("urn:peppol:pint:billing-1@ae-1", "urn:peppol:bis:billing"),
    ("pint-ae", "selfbilling"): ("urn:peppol:pint:selfbilling-1@ae-1", "urn:peppol:bis:selfbilling"),
}
SCENARIO_KEYS = {"standard": "standard", "zeroRated": "zero_rated", "exempt": "exempt", "reverseCharge": "reverse_charge", "designatedZone": "designated_zone", "export": "export"}
LEAST_CASES, LEAST_FAILING = 60, 30
OUTCOMES = ("pass", "warn", "fail", "no_verdict")


def detect_format(vendor: Column, mime: Column, filename: Column) -> Column:
    """tally_xml, xlsx or csv; the vendor decides first. NULL: no extractor, the file is refused."""
    name = F.lower(filename)
    said = lambda word: F.coalesce(F.contains(mime, F.lit(word)), F.lit(False)) | F.coalesce(F.endswith(name, F.lit(f".{word}")), F.lit(False))
    sheet = F.coalesce(F.contains(mime, F.lit("spreadsheet")), F.lit(False)) | F.coalesce(F.endswith(name, F.lit(".xlsx")), F.lit(False))
    return F.when(vendor == "tally", "tally_xml").when(sheet, "xlsx").when(said("csv"), "csv").when(said("xml"), "tally_xml")


def claims(runs: DataFrame, executions: DataFrame, as_of: Column) -> DataFrame:
    """What each run may do: ``claim`` (new, failed, or its lease has ended), ``skip`` (completed) or ``held``, and the
    attempt that a claim would be. executions (run, status, attempt, lease_until): the latest attempt of each run counts."""
    last = executions.withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy(F.col("attempt").desc()))).where("n = 1").drop("n")
    both = runs.join(last, "run", "left")
    held = (F.col("status") == "running") & (F.col("lease_until") >= as_of)
    action = F.when(F.col("status") == "completed", "skip").when(held, "held").otherwise("claim")
    return both.select(*runs.columns, action.alias("action"), (F.coalesce("attempt", F.lit(0)) + 1).cast("int").alias("attempt"))


def spec_identifiers(profile: Column, doc_type: Column) -> Column:
    """struct<customization_id, profile_id> of a document; NULL where the profile's are unresolved: such a document is refused."""
    process = F.when(doc_type == "self_billed", "selfbilling").otherwise("billing")
    out = F.lit(None).cast("struct<customization_id:string,profile_id:string>")
    for (name, kind), (customization, profile_id) in IDENTIFIERS.items():
        out = F.when((profile == name) & (process == kind), F.struct(F.lit(customization).alias("customization_id"), F.lit(profile_id).alias("profile_id"))).otherwise(out)
    return out


def run_status(log: DataFrame, run: str, at: str, seq: str) -> DataFrame:
    """The latest status of each run from its appended status rows; rows of no known status are left out."""
    w = Window.partitionBy(run).orderBy(F.col(at).desc(), F.col(seq).desc())
    known = log.where(F.col("status").isin(*STATUSES))
    return known.withColumn("n", F.row_number().over(w)).where("n = 1").select(run, "status")


def resolve_entities(entities: DataFrame, tenants: DataFrame) -> DataFrame:
    """Entities with their tenant; an entity without one is no entity."""
    return entities.join(tenants, "tenant_id")


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed, each once however often it is listed."""
    return rows.join(ids.select(key), key, "left_semi")


def tenant_read(df: DataFrame, tenant: str | None, actor: str, reason: str, log: str, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant (none without a tenant); the access is appended to the log first."""
    spark = df.sparkSession
    entry = spark.createDataFrame([(tenant, actor, reason)], "tenant_id string, actor string, reason string").withColumn("at", F.current_timestamp())
    entry.write.mode("append").parquet(log)
    return df.where(F.lit(False) if tenant is None else F.col(column) == tenant)


def rule_owner(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Rule files (path) with the profile that their first folder names, NULL if the registry has none."""
    return files.withColumn("folder", F.split("path", "/")[0]).join(registry.select(F.col("spec_id").alias("folder"), F.col("spec_id").alias("owner")), "folder", "left").drop("folder")


def catalogue(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as rows: rule_id, severity, term, failure_class, context, text and its hash."""
    rows = [(r.id, r.severity, r.term, r.failure, r.grain, r.expected) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, severity string, term string, failure_class string, context string, text string").withColumn("text_hash", F.sha2("text", 256))


def scenario_keys(profile: Column) -> Column:
    """Scenarios that an entity's profile (map of key to boolean) declares; keys that name none are ignored."""
    names = F.create_map(*[F.lit(x) for pair in SCENARIO_KEYS.items() for x in pair])
    declared = F.map_keys(F.map_filter(profile, lambda k, v: v))
    return F.array_compact(F.transform(declared, lambda k: F.try_element_at(names, k)))


def outcome_counts(found: DataFrame, by: str) -> DataFrame:
    """Rows of each outcome by ``by``, zero where there are none. It counts rows, not documents."""
    return found.groupBy(by).agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in OUTCOMES])


def balance(cases: DataFrame) -> DataFrame:
    """cases, failing, passing and balanced of each profile: enough cases, enough failing ones, no fewer than pass.
    A profile under quarantine has a row apart and is never balanced."""
    quarantined = F.col("profile").isin(*QUARANTINED)
    out = cases.groupBy("profile").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("outcome") == "fail").alias("failing"), F.count_if(F.col("outcome") == "pass").alias("passing"))
    enough = (F.col("cases") >= LEAST_CASES) & (F.col("failing") >= LEAST_FAILING) & (F.col("failing") >= F.col("passing"))
    return out.select("profile", quarantined.alias("quarantined"), "cases", *[F.when(~quarantined, F.col(c)).alias(c) for c in ("failing", "passing")], (enough & ~quarantined).alias("balanced"))


def audit_results(documents: DataFrame, stored: DataFrame, defects: DataFrame, run: str) -> DataFrame:
    """One row per run: documents, rows of each outcome, distinct failing rules, defects and scenarios seen. documents: run,
    scenario; stored: run, outcome, rule_id; defects: run, n. Groups of findings are a table of their own (finding_groups)."""
    docs = documents.groupBy(run).agg(F.count(F.lit(1)).alias("documents"), F.array_join(F.array_sort(F.collect_set("scenario")), ",").alias("scenarios"))
    failing = stored.where("outcome = 'fail'").groupBy(run, "rule_id").agg(F.count(F.lit(1)).alias("n")).groupBy(run).agg(F.count(F.lit(1)).alias("failing_rules"))
    wrong = defects.groupBy(run).agg(F.sum("n").alias("defects"))
    out = docs.join(outcome_counts(stored, run), run, "left").join(failing, run, "left").join(wrong, run, "left")
    return out.fillna(0, [*OUTCOMES, "failing_rules", "defects"])


def audit_rows(rows: DataFrame, key: str, run: str, rules: list[Rule]) -> DataFrame:
    """What ``audit_results`` gives, from the rows of all documents: ``judged`` (on one row of each document that is judged),
    scenario, n_defects and the ``masks`` of ``rules``. Rows that are together by ``key`` are exchanged no more; a document
    without a finding is one ``pass``."""
    found = mask_counts(F.col("masks"), rules)
    masks = {f"__m{i}": m for i, m in enumerate(failing(F.col("masks"), rules))}
    docs = rows.groupBy(key, run).agg(
        F.count_if("judged").alias("documents"), F.max(F.when(F.col("judged"), F.col("scenario"))).alias("scenario"), F.sum("n_defects").alias("defects"),
        *[F.sum(c).alias(x) for x, c in found.items()], *[F.bit_or(m).alias(x) for x, m in masks.items()],
    )
    stored = {x: F.col("documents") * F.col(x) for x in found} | {"pass": F.when(reduce(Column.__add__, map(F.col, found)) == 0, F.col("documents")).otherwise(0)}
    out = docs.groupBy(run).agg(
        F.sum("documents").alias("documents"), F.array_join(F.array_sort(F.collect_set("scenario")), ",").alias("scenarios"), *[F.sum(stored[x]).alias(x) for x in OUTCOMES],
        reduce(Column.__add__, [F.bit_count(F.bit_or(F.when(F.col("documents") > 0, F.col(x)))) for x in masks]).cast("bigint").alias("failing_rules"), F.sum("defects").alias("defects"),
    )
    return out.where("documents > 0").fillna(0, ["failing_rules"])


def write_normalised(headers: DataFrame, lines: DataFrame, run: str, folder: str) -> DataFrame:
    """Append a run's headers and lines and its status row; gives the status row. A failed attempt's files are replaced."""
    headers.write.mode("overwrite").parquet(f"{folder}/invoice/run={run}")
    lines.write.mode("overwrite").parquet(f"{folder}/invoice_line/run={run}")
    spark = headers.sparkSession
    done = spark.read.parquet(f"{folder}/invoice/run={run}").agg(F.count(F.lit(1)).alias("doc_count")).select(F.lit(run).alias("run"), F.lit("normalising").alias("status"), "doc_count", F.current_timestamp().alias("at"))
    done.write.mode("append").parquet(f"{folder}/run_status")
    return done
