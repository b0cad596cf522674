"""Secret scans: key-shaped candidates, and a random forest that removes false positives. DataFrame functions only.

Candidates are runs of 16 or more key characters with at least one digit, found in the words of each text, and values of
any length and any characters that are quoted or assigned after a word that names a secret (``password = "..."``,
``pwd: ...``, ``secret "..."``), passphrases in quotes included. A run that holds such a name and value is left to the value; a
run inside a longer quoted value is a candidate beside it. A secret of letters alone is found only behind a name. Features:
length, character transitions, classes and distinct characters, dictionary coverage, path, assignment and the words
before and behind. The forest learns from a table of labelled findings: ``labelled`` draws one of a fixed number of rows
from kinds of secrets and of harmless values whose label the kind and its surroundings give; findings of one's own are
added to it. The corpus itself labels nothing. Candidates are found once and written to the shared folder.

Defined results: null and empty texts have no candidates; repeated rows are scanned each by itself; a candidate that
occurs several times is found each time, so ties are rows of their own; a very long text is scanned whole, in time that grows
with its length (each match carries its own surroundings, never the text); an empty table gives an empty result; other
columns are ignored, or carried along by redaction, which replaces every occurrence of a secret in its text by ``[SECRET]``
(values after a name that are under 8 characters, have a blank or no digit: those behind the same name and signs) and
leaves other texts as they are.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

CONTEXT = 120  # characters in front of a value that its features look at
CANDIDATE = r"(?=[A-Za-z_+/=-]*[0-9])[A-Za-z0-9_+/=-]{16,}"
# Words that name secrets, words that name harmless identifiers, common words.
NAMES_SECRET = "token|secret|password|passwd|pwd|apikey|api_key|api-key|access_key|auth|bearer|credential|private_key"
NAMES_OTHER = "sha1|sha256|sha512|md5|checksum|digest|commit|revision|uuid|guid|isbn|etag|hash|build|version|order|invoice|phone|fax"
COMMON = (
    "about above after again against along also always among another area around article author away back base because become been before being below best better between blog body book both build business call came card case "
    "change chapter check city class client close code comes common company config content copy could country current data date default detail different display does done down each early edit email even event every example "
    "example fact family field figure file find first follow form found free from full game general good great group hand have head health help here high home hour house human image index info inside item know large last "
    "later level life light line link list little live local long look made main make many market member message might model month more most move much must name need never news next night note nothing number office often "
    "only open order other over page part people place plan play point post power price print product profile project public quality question read real record release report result review right room same school search "
    "section server service session setting several share short show side simple site small some sound source start state still story street study style such system table take team test text than that their them then "
    "there these they thing this those through time title today together total type under until update upload user value version very view want water week well went were what when where which while white will with within "
    "without word work world would write year young your the and for"
).replace(" ", "|")
# A value of any length after a word that names a secret: lead, then the value in double quotes, in single quotes or bare.
NAMED = (rf"((?i:{NAMES_SECRET})(?:[_-][\w-]*|[0-9]*)[\"']?(?:\s*(?::=|=>|=|:)\s*|\s+(?:is\s+)?(?=[\"'])))"
         r"(?:\"((?:[^\"\\\r\n]++|\\.)++)\"|'((?:[^'\\\r\n]++|\\.)++)'|[\"']?([^\s\"']*[^\s\"'.,;:)\]}>]))")
# What stands before and behind findings. Kinds of values that either label takes are told apart by these.
SECRET_LEADS = ('token = "', "api_key=", "password:", "secret =", "auth token", "bearer", "access_key", "credential:", "aws secret", "private_key", "export API_KEY=", "--password ", 'client_secret: "', "Authorization: Bearer", "passwd=", "apikey: ")
OTHER_LEADS = ("commit", "sha1:", "md5 checksum", "file", "order", "isbn", "uuid", "version", "see http://a.example/", "in", "of", "etag:", "digest", "image", "phone", "invoice no", "src=", "the", "build", "revision")
NAMED_LEADS = ('password = "', "pwd:", "password=", 'password: "', "passwd = '", 'secret = "', "token=", 'api_key: "', 'pwd = "', "auth=")
PROSE_LEADS = ("token:", "password:", "secret:", "auth:", "The secret:", "token =", "Password:", "bearer:", 'secret "', "credential:")
SECRET_TAILS, OTHER_TAILS = ("", "do not share", "is my key", "expires soon", "in the vault"), ("", "was merged", "is the checksum", "for this file", "and so on", "pages", "of the archive")
WORDS = "correct horse battery staple violet river seven lamps open sesame sword fish winter monkey dragon sunshine master shadow flower bridge hunter admin welcome"
PROSE = "the must that required patience word minimum someone none a They it is not be should contain and your changed"


def labelled(spark: SparkSession, each: int = 48) -> DataFrame:
    """before, candidate, after and label of ``each`` findings of each kind, always the same (a few thousand rows at most)."""
    words, prose, rows = WORDS.split(), PROSE.split(), []
    for i in range(each):
        raw = lambda kind: hashlib.sha256(f"{kind}:{i}".encode()).digest()  # noqa: B023, E731
        hexes = lambda kind, n=64: raw(kind).hex()[:n]  # noqa: B023, E731
        b64 = lambda kind: base64.b64encode(raw(kind)).decode()  # noqa: B023, E731
        alnum = lambda kind, n: (b64(kind) + b64(f"{kind}'")).translate(str.maketrans("+/=", "xYz"))[:n]  # noqa: B023, E731
        digits = lambda kind, n: hexes(kind, n).translate(str.maketrans("abcdef", "012345"))  # noqa: B023, E731
        pick = lambda values, shift=0: values[(i + shift) % len(values)]  # noqa: B023, E731
        keys = [hexes("hex40", 40), hexes("hex32", 32), hexes("hex64"), b64("b64"), alnum("any", 40), alnum("short", 20), "sk_live_" + alnum("sk", 24), "ghp_" + alnum("gh", 36),
                "AKIA" + alnum("ak", 16).upper(), f"xoxb-{digits('x1', 12)}-{alnum('x2', 12)}", "eyJhbGciOi" + alnum("jwt", 40)]
        values = [pick(words) + digits("pw", 2), " ".join(pick(words, x) for x in (0, 5, 9, 13)), f"{pick(words).title()}!{digits('pz', 3)}x", alnum("pin", 8), pick(words, 3), f"{pick(words)}@{pick(words, 7)}"]
        uuid = "-".join(hexes("uuid")[x:y] for x, y in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32)))
        others = [hexes("o40", 40), hexes("o32", 32), hexes("o64"), digits("n16", 16), digits("n20", 20), digits("n24", 24), uuid, f"release-{digits('d', 4)}-{pick(words)}-{pick(words, 4)}-1", f"news/{digits('y', 4)}/{pick(words)}/{pick(words, 2)}-{pick(words, 6)}-{i}",
                  f"/usr/share/{pick(words)}/{pick(words, 8)}-2-{i}", f"section_{pick(words)}_number_{i}", pick("=-_") * 14 + "2024", f"2024-01-15T10-30-{digits('t', 2)}Z"]
        prosaic = [pick(prose), " ".join(pick(prose, x) for x in (1, 4, 6, 9, 11, 2, 7)), pick(prose, 8)]
        kinds = [(v, SECRET_LEADS, SECRET_TAILS, 1.0) for v in keys] + [(v, NAMED_LEADS, SECRET_TAILS, 1.0) for v in values] + [(v, OTHER_LEADS, OTHER_TAILS, 0.0) for v in others] + [(v, PROSE_LEADS, OTHER_TAILS, 0.0) for v in prosaic]
        rows += [(pick(leads, n), v, pick(tails, n) if (i + n) % 2 == 0 else "", label) for n, (v, leads, tails, label) in enumerate(kinds)]
    return spark.createDataFrame(rows, "before string, candidate string, after string, label double")


FEATURES = ["length", "switches", "switch_rate", "digits", "uppers", "signs", "distinct_chars", "vowels", "covered", "is_path", "is_number", "is_hex", "assigned", "quoted", "near_secret", "near_other", "secret_behind", "other_behind"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tk (hash of the text), word_no, part, candidate, before and after (the words and signs in front of it and
    behind it) and lead (of a value after a name: the name and the signs behind it). Values after a name have parts from
    0 down: -1, -2, ..."""
    return _runs(docs, id_col, text_col).withColumn("lead", F.lit(None).cast("string")).unionByName(_named(docs, id_col, text_col))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a match, which carries its own pieces of the text only; what stands before it comes from the matches before, of
    which CONTEXT // 5 always hold CONTEXT characters (the shortest match has 5)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(NAMED)).withColumn("row", F.monotonically_increasing_id())
    found = F.arrays_zip(F.split("text", NAMED, -1).alias("between"), *[F.regexp_extract_all("text", F.lit(NAMED), F.lit(i)).alias(f"g{i}") for i in range(5)])
    rows = rows.select("row", "doc_id", F.xxhash64("text").alias("tk"), F.posexplode(found).alias("j", "m")).select("row", "doc_id", "tk", "j", "m.*")
    w = Window.partitionBy("row").orderBy("j")
    gaps = lambda c: F.regexp_count(c, F.lit(r"\s+"))  # noqa: E731  no run of white space crosses from one piece to the next
    tail = F.right(F.concat("between", F.coalesce("g0", F.lit(""))), F.lit(CONTEXT))
    rows = rows.withColumns({"own": gaps(F.col("between")), "whole": gaps(F.col("between")) + gaps(F.coalesce("g0", F.lit("")))}).withColumns({
        "gaps": F.coalesce(F.sum("whole").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("own"),
        "front": F.array_join(F.collect_list(tail).over(w.rowsBetween(-(CONTEXT // 5), -1)), ""), "after": F.substring(F.coalesce(F.lead("between").over(w), F.lit("")), 1, 60),
    })
    value = F.concat("g2", "g3", "g4")
    signs = F.when(F.substring(F.col("g0"), F.length("g1") + 1, F.lit(1)).isin('"', "'"), 1).otherwise(0)
    rows = rows.where("g0 is not null").select("*", value.alias("candidate"), F.substring(F.col("g0"), F.lit(1), F.length("g1") + signs).alias("lead"))
    words = F.split(F.concat(F.right(F.concat("front", "between"), F.lit(CONTEXT)), "lead"), r"\s+")
    before = F.concat_ws(" ", F.slice(words, F.greatest(F.size(words) - 3, F.lit(1)), F.lit(4)))
    rows = rows.select("doc_id", "tk", (F.col("gaps") + gaps(F.col("lead"))).cast("int").alias("word_no"), (-1 - F.col("j")).alias("part"), "candidate", before.alias("before"), "after", "lead")
    return rows.where(~(F.col("candidate").rlike(f"^{CANDIDATE}$") & F.col("lead").rlike("[^A-Za-z0-9_+/=-]$")))  # that is a run by itself


def _runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(CANDIDATE))
    rows = rows.select("doc_id", F.xxhash64("text").alias("tk"), F.split("text", r"\s+").alias("words"))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.col("words")[i].rlike(CANDIDATE))
    first = lambda i: F.greatest(i - 3, F.lit(0))
    near = lambda i: F.struct(i.alias("word_no"), F.col("words")[i].alias("word"), F.slice("words", first(i) + 1, i - first(i)).alias("front"), F.slice("words", i + 2, F.lit(3)).alias("behind"))
    rows = rows.select("doc_id", "tk", F.explode(F.transform(at, near)).alias("x")).select("doc_id", "tk", "x.word_no", "x.word", F.concat_ws(" ", "x.front").alias("front"), F.concat_ws(" ", "x.behind").alias("behind"))
    rows = rows.select("*", F.posexplode(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))).alias("part", "candidate")).where(~F.col("candidate").rlike(NAMED))  # its value is a candidate
    before = F.concat_ws(" ", "front", F.right(F.expr("substring_index(word, candidate, 1)"), F.lit(CONTEXT)))
    after = F.concat_ws(" ", F.left(F.expr("substring(word, locate(candidate, word) + length(candidate))"), F.lit(CONTEXT)), "behind")
    return rows.select("doc_id", "tk", "word_no", "part", "candidate", before.alias("before"), after.alias("after"))


def features(found: DataFrame) -> DataFrame:
    """``found`` (candidate, before, after) with FEATURES."""
    c, low, before, after = F.col("candidate"), F.lower("candidate"), F.lower("before"), F.lower("after")
    n = F.length(c).cast("double")
    count = lambda pattern, of=c: F.regexp_count(of, F.lit(pattern)).cast("double")
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    switches = count(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[_+/=-])(?=[A-Za-z0-9])")
    return found.withColumns({
        "length": n, "switches": switches, "switch_rate": switches / n, "digits": count("[0-9]") / n, "uppers": count("[A-Z]") / n, "signs": count("[_+/=-]") / n,
        "distinct_chars": F.size(F.array_distinct(F.split(c, ""))) / F.sqrt(n), "vowels": count("[aeiou]", low) / n,
        "covered": 1 - F.length(F.regexp_replace(low, COMMON, "")) / n,
        "is_path": flag(F.col("before").rlike(r"(://|[/\\])\S*$") | (count("/") > 1)), "is_number": flag(c.rlike("^[0-9]+$")), "is_hex": flag(low.rlike("^[0-9a-f]+$")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")), "quoted": flag(before.rlike(r"[\"']$")),
        "near_secret": flag(before.rlike(NAMES_SECRET)), "near_other": flag(before.rlike(rf"\b({NAMES_OTHER})\b") & ~before.rlike(NAMES_SECRET)),
        "secret_behind": flag(after.rlike(rf"\b({NAMES_SECRET}|key|vault)\b")), "other_behind": flag(after.rlike(rf"\b({NAMES_OTHER}|file|archive|pages|merged)\b")),
    })


def train(spark: SparkSession, findings: DataFrame | None = None, trees: int = 24, depth: int = 6) -> RandomForestClassificationModel:
    """findings: labelled findings of one's own (before, candidate, after, label), beside those of ``labelled``."""
    columns = ["before", "candidate", "after", "label"]
    rows = labelled(spark).select(columns)
    if findings is not None:
        rows = rows.unionByName(findings.select("before", "candidate", "after", F.col("label").cast("double")))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(features(rows.coalesce(1).sortWithinPartitions(columns))).select("x", "label")
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7, maxMemoryInMB=64).fit(rows)


def score_findings(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """``found`` with FEATURES and ``score``, the share of trees' votes that it is a secret."""
    rows = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(features(found)))
    return rows.withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def find_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate of every text: doc_id, tk, word_no, part, candidate, score and secret (score >= threshold)."""
    found = materialize(candidates(docs, id_col, text_col), "candidates")
    rows = score_findings(found, train(docs.sparkSession, findings))
    return rows.select("doc_id", "tk", "word_no", "part", "candidate", "lead", "score", (F.col("score") >= threshold).alias("secret"))


def op4_secret_scan(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    return found.select("doc_id", F.col("word_no").cast("long"), "part", F.length("candidate").alias("n_chars"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "secret")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with secrets in ``text_col`` replaced by ``[SECRET]``."""
    found = find_secrets(docs, id_col=id_col, text_col=text_col).where("secret")
    lead, short = F.coalesce("lead", F.lit("")), F.col("lead").isNotNull() & ~F.col("candidate").rlike(r"^(?=.*[0-9])\S{8,}$")
    forms = F.when(short, F.array(lead)).when(F.col("lead").isNull(), F.array(F.lit(""))).otherwise(F.array(lead, F.lit("")))  # short ones only behind their name
    found = found.select("doc_id", "tk", "candidate", F.explode(forms).alias("lead"))
    find = F.concat("lead", "candidate")
    secrets = found.groupBy("doc_id", "tk").agg(F.array_sort(F.collect_set(F.struct((-F.length(find)).alias("n"), find.alias("find"), F.concat("lead", F.lit("[SECRET]")).alias("put")))).alias("__secrets"))
    secrets = secrets.withColumnsRenamed({"doc_id": "__of", "tk": "__tk"})
    same = F.col(id_col).eqNullSafe(F.col("__of")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__tk"))
    text = F.aggregate("__secrets", F.col(text_col), lambda t, s: F.replace(t, s["find"], s["put"]))
    return docs.join(secrets, same, "left").withColumn(text_col, F.when(F.col("__secrets").isNotNull(), text).otherwise(F.col(text_col))).select(*docs.columns)
