import re

from pyspark.sql import functions as F

from ledgerloom.llm.secret_scan import CANDIDATE, candidates, find_secrets, labelled, op4_secret_scan, redact_secrets, score_findings, train

TEXTS = [
    ('set password = "Tr0ub4dor3" now', 'set password = "[SECRET]" now'), ('password: "correct horse battery staple"', 'password: "[SECRET]"'), ("my pwd=S3cr!t@x.y, then", "my pwd=[SECRET], then"),
    ("pwd: hunter2x. A hunter came", "pwd: [SECRET]. A hunter came"), ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', 'token = "[SECRET]"'),
    ("authors: Smith and others", None), ("the token: the word", None), ("password: must be long", None), ("plain", None), ("", None), (None, None),
    ("merged commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff today", None), ("see http://a.example/news/2024/01/15/open-river-bridge-12 for more", None), ("order 4111111111111111 shipped", None),
]


def test_named_values(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string")
    found = {(r.doc_id, r.candidate, r.word_no) for r in candidates(docs).collect()}
    assert {(0, "Tr0ub4dor3", 3), (1, "correct horse battery staple", 1), (2, "S3cr!t@x.y", 1), (3, "hunter2x", 1)} <= found and not any(i == 5 for i, _, _ in found)
    assert sum(i == 4 for i, _, _ in found) == 1
    assert {r.doc_id: r.text for r in redact_secrets(docs).collect()} == {i: t if want is None else want for i, (t, want) in enumerate(TEXTS)}
    assert {r.doc_id for r in op4_secret_scan(docs).where("secret").collect()} == {0, 1, 2, 3, 4}


def test_runs_equal_a_plain_version(spark):
    rows = [(1, "x " + "a1" * 9 + ". y"), (2, "a" * 20), (3, "  " + "b2" * 10 + "," + "c3" * 10 + " z\n" + "b2" * 10), (4, None), (5, ""), (6, "word " * 3000 + "d4" * 40), (6, "word " * 3000 + "d4" * 40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, candidate int")
    want = sorted((i, m.group()) for i, t in rows for m in re.finditer(CANDIDATE, t or ""))
    got = candidates(docs).where("lead is null").collect()
    assert sorted((r.doc_id, r.candidate) for r in got) == want and len(want) == 6
    assert {r.after for r in got if r.doc_id == 1} == {". y"}
    assert find_secrets(docs.where("false")).count() == 0 and redact_secrets(docs).columns == docs.columns


def test_precision_and_recall(spark):
    """On findings that the forest has not seen: other values of each kind, with other words in front and behind."""
    unseen = labelled(spark, 96).exceptAll(labelled(spark)).where(F.xxhash64("candidate") % 3 == 0)
    got = score_findings(unseen, train(spark)).select("label", (F.col("score") >= 0.5).alias("secret"), "candidate", "before").collect()
    hit = sum(r.secret and r.label == 1 for r in got)
    precision, recall = hit / sum(r.secret for r in got), hit / sum(r.label == 1 for r in got)
    assert len(got) > 300 and precision > 0.95 and recall > 0.95, (len(got), precision, recall, [(r.before, r.candidate) for r in got if r.secret != (r.label == 1)][:20])


def test_findings_of_ones_own(spark):
    own = spark.createDataFrame([("ticket", f"TCK-{i:014d}x", "", 1) for i in range(200)], "before string, candidate string, after string, label int")
    docs = spark.createDataFrame([(1, "ticket TCK-00000000009999x open")], "doc_id long, text string")
    assert not find_secrets(docs).first().secret and find_secrets(docs, own).first().secret


def test_many_names_in_one_text_take_time_in_proportion(spark):
    """1 MB with 20,000 named values, and the word numbers and surroundings of a shorter one by a plain version."""
    import time

    text = " ".join(f"token=abc{i:08d}x and some words here" for i in range(20_000)) + " pwd=a,pwd=b" * 50
    begin = time.time()
    found = candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert time.time() - begin < 60 and len(found) == 20_050 and len(text) > 700_000
    assert not any(r.candidate.startswith("token=") for r in found)  # the value, not the run with its name
    short = 'x  token=abc00000001x and  pwd: "one two" \n secret "s" pwd=a,pwd=b;pwd=c end'
    got = sorted((r.word_no, r.candidate, r.before) for r in candidates(spark.createDataFrame([(1, short)], "doc_id long, text string")).where("lead is not null").collect())
    want = []
    for value, lead in (("abc00000001x", "token="), ("one two", 'pwd: "'), ("s", 'secret "'), ("a,pwd=b;pwd=c", " pwd=")):
        front = short[: short.index(lead + value) + len(lead)]
        words = re.split(r"\s+", front)
        want.append((len(words) - 1, value, " ".join(words[-4:])))
    assert got == sorted(want)
