import hashlib
import zipfile
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(300))
TEXTS = [LONG, LONG, LONG + " tail end", "short text", "", None, "x" * 70000, "  odd \n\n spaces  ", "a b", "A B", LONG.replace("w7 ", "W7 ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None)], SCHEMA).withColumn("n_words", F.lit("clash"))


def _windows(rows, k=20):
    seen, out = {}, {}
    for i, t in sorted(rows):
        w = (t or "").split()
        gone = set()
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if seen.setdefault(key, (i, s)) != (i, s):
                gone |= set(range(s, s + k))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


def test_substrings(docs):
    from ledgerloom.llm.substring_dedup import op1_substring_dedup

    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring_dedup(docs).collect() if r.doc_id is not None}
    assert got == _windows(list(enumerate(TEXTS)))
    assert op1_substring_dedup(docs.where("false")).count() == 0


def test_near_duplicates(docs):
    from ledgerloom.llm.near_dedup import op2_near_dedup

    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op2_near_dedup(docs).collect()}
    assert [got[i][1] for i in range(len(TEXTS))] == [0, 0, 0, 3, 4, 5, 6, 7, 8, 8, 0]
    assert got[4] == (0, 4, True) and got[8][0] == 1


def test_bpe_and_packing(docs):
    import tiktoken

    from ledgerloom.llm.byte_bpe import load_ranks, op9_byte_bpe
    from ledgerloom.llm.packing import op7_packing

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    want = {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    for r in op9_byte_bpe(docs).where("doc_id is not null").collect():
        assert r.n_tokens == len(want[r.doc_id]) and r.decoded_sha256 == hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], dtype="<u4").tobytes()).hexdigest()
    pieces = op7_packing(docs).where("doc_id is not null").collect()
    for i, ids in want.items():
        ids, at = ids + [0], 0
        for r in sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_zip64_directory():
    from ledgerloom.llm.warc_zip import directory

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        with z.open("a", "w", force_zip64=True) as f:
            f.write(b"hello")
    at, n = directory(raw, len(raw.getvalue()))["a"]
    assert raw.getvalue()[at : at + n] == b"hello"


def test_search(spark):
    from ledgerloom.llm.vector_search import op10_top_k

    v = np.random.default_rng(1).normal(size=(300, 8)).astype(np.float32)
    v[40:80] = v[40]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (350, [float("nan")] * 8)]
    got = op10_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    w = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    for q in range(0, 300, 50):
        want = sorted(((-int(w[q] @ w[i]), i) for i in range(300) if i != q))[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_pages_and_secrets(spark, docs):
    from ledgerloom.llm.html_extract import extract_pages, page_lines
    from ledgerloom.llm.secret_scan import redact_secrets

    page = '<html><body><nav><ul><li>Menu</ul></nav><div class="ad">buy</div><article><h1>T &amp; t</h1><p>one <b>two<br>three</p><script>x</script></article><footer>f</footer></body></html>'
    assert [t for _, t in page_lines(page)] == ["T & t", "one two three"]
    plain = "<body><div>Shared</div><div>only {}</div></body>"
    rows = [(1, "http://a/x/1", page), (2, "http://b/1", plain.format("1")), (3, "http://b/2", plain.format("2")), (4, None, None)]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "T & t\n\none two three", 2: "only 1", 3: "only 2", 4: ""}
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    one = spark.createDataFrame([(1, f'x token = "{key}" y', None, None, 0), (2, "plain", None, None, 0), (3, None, None, None, 0)], SCHEMA)
    assert {r.doc_id: r.text for r in redact_secrets(one).collect()} == {1: 'x token = "[SECRET]" y', 2: "plain", 3: None}


def test_quality_and_fingerprints(docs):
    from ledgerloom.llm.order_minhash import likeness, op8_order_minhash, sketch
    from ledgerloom.llm.quality import fit, score_documents

    assert likeness(sketch("abcdefghij" * 9), sketch("abcdefghij" * 9)) == 1 and sketch("") != sketch("a")
    assert op8_order_minhash(docs).count() == len(TEXTS) + 1
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert score_documents(docs, fit(docs, labels)).where("score between 0 and 1").count() == len(TEXTS) + 1
