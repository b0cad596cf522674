"""Operators whose results SQL cannot express, against plain versions; edge cases of the others."""

import base64
import hashlib
import io
import random
import struct
import zipfile
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _prose(rng, n, words="river stone open light never market seven quiet garden winter paper north".split()):
    return " ".join(rng.choice(words) for _ in range(n))


def test_quality_equals_a_plain_vote(spark):
    from ledgerloom.llm.quality import fit, score_documents, term_counts, vote

    rng = random.Random(1)
    texts = [(i, _prose(rng, 60) if i % 2 else " ".join([rng.choice(["$$$", "buy", "now", "!!!"])] * 40)) for i in range(80)]
    labels = [(i, i % 2) for i in range(60)] + [(61, None), (None, 1)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts] + [(90, None, ""), (91, "", ""), (92, "x " * 200_000, ""), (5, texts[5][1], "")], "doc_id long, text string, score string")
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    model = fit(docs, table, sample=1000)
    got = defaultdict(list)
    for r in score_documents(docs, model, k=7).collect():
        got[r.doc_id].append(r.score)
    known, label = model["known"].astype(np.float64), model["label"]
    for i, t in texts:
        x = term_counts([t.encode()], 1024) * model["weight"]
        x = x / np.linalg.norm(x) @ model["basis"]
        sim = known @ (x[0] / np.linalg.norm(x))
        near = np.argsort(-sim)[:7]
        w = np.maximum(sim[near], 0) ** 4
        assert got[i][0] == pytest.approx(float((w * label[near]).sum() / w.sum()), abs=1e-3), i
    assert all((got[i][0] >= 0.5) == (i % 2 == 1) for i in range(60, 80))
    assert got[90] == got[91] == [pytest.approx(float(model["prior"]))] and len(got[5]) == 2 and got[5][0] == got[5][1]
    none = fit(docs, table.where("false"))
    assert {r.score for r in score_documents(docs, none).collect()} == {0.5} and score_documents(docs.where("false"), model).count() == 0
    assert vote(np.zeros((1, 1024 + 3)), model, 3)[0] == float(model["prior"])
    assert np.array_equal(fit(docs, table, sample=30)["known"], fit(docs.repartition(7), table, sample=30)["known"])


def _plain_sketch(text, k=8, m=24, width=2):
    """The minimal numbered k-mers by a loop, with the operator's hash functions."""
    from ledgerloom.llm.common import mix

    u = lambda x: np.array([x & (2**64 - 1)], dtype=np.uint64)
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return "0" * (8 * m)
    raw += b"\0" * (k - len(raw))
    seen, h = {}, []
    repeated = defaultdict(int)
    grams = [raw[i : i + k] for i in range(len(raw) - k + 1)]
    for g in grams:
        repeated[g] += 1
    for g in grams:
        v = 0
        for b in g:
            v = (v * 0x9E3779B97F4A7C15 + b) % 2**64
        v = int(mix(u(v))[0])
        if repeated[g] > 1:
            n = seen.get(g, 0)
            seen[g] = n + 1
            v = int(mix(u(v + n * 0xD1342543DE82EF95))[0])
        h.append(v)
    out = ""
    for j in range(1, m + 1):
        salt = int(mix(u(j * 0xA0761D6478BD642F))[0]) | 1
        key = [(v * salt % 2**64) ^ ((v * salt % 2**64) >> 32) for v in h]
        chosen = sorted(sorted(range(len(h)), key=lambda i: key[i])[:width])
        value = 0
        for i in chosen:
            value = int(mix(u(value * 0x9E3779B97F4A7C15 + h[i]))[0])
        out += f"{value >> 32:08x}"
    return out


def test_fingerprints(spark):
    from ledgerloom.llm.order_minhash import likeness, op8_order_minhash, sketch

    rng = random.Random(3)
    for text in ["", "a", "abcdefgh", "abcabcabcabcabcabc", "é" * 9, _prose(rng, 40), "\U0001F600 x" * 7]:
        assert sketch(text) == _plain_sketch(text), text
    texts = {i: _prose(rng, n) for i, n in zip((3, 9, 4, 100, 7), (30, 80, 0, 50, 3))} | {8: None, 50: "é\U0001F600" * 40}
    table = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in op8_order_minhash(table.repartition(3)).collect()}
    order = sorted(texts, reverse=True)
    for at, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (sketch(text), sketch(edited))
        assert (r.near_edited, r.near_next) == (likeness(sketch(text), sketch(edited)), likeness(sketch(text), sketch(following)))
    shuffled = " ".join(sorted(texts[9].split()))
    assert likeness(sketch(texts[9]), sketch(texts[9].replace("river", "rivers", 1))) > likeness(sketch(texts[9]), sketch(shuffled))
    same = op8_order_minhash(spark.createDataFrame([(1, "only"), (1, "only"), (None, "only")], "doc_id long, text string")).collect()
    assert len(same) == 3 and {r.near_next for r in same} == {1.0} and op8_order_minhash(table.where("false")).count() == 0


def test_chunks_are_stitched(spark):
    import public_tokenizers
    import tiktoken

    from ledgerloom.llm.byte_bpe import decode_documents, encode_documents, load_ranks

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    rng = random.Random(5)
    odd = [" ", "  ", "\n", "\n\n \t", "it's", " 1234", "é", "\U0001F600", "word", "...", "don't", "　", "x" * 70]
    texts = ["".join(rng.choice(odd) for _ in range(rng.choice([50, 400, 900]))) for _ in range(60)] + ["x" * 3000, " " * 3000 + "y", "a" * 63 + " " * 300 + "b" * 200, "", None]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], ""), (None, texts[1], "")]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for chunk, overlap in ((64, 32), (200, 90)):
        encoded = encode_documents(table, path, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
        got = decode_documents(encoded, path).collect()
        assert len(got) == len(rows)
        for r in got:
            text = (texts[1] if r.doc_id is None else texts[r.doc_id]) or ""
            assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert encode_documents(table.where("false"), path, public_tokenizers.PATTERN).count() == 0


def test_archives_round_trip(spark):
    from ledgerloom.llm.common import shared_dir
    from ledgerloom.llm.warc_zip import mark_revisits, op6_warc_zip, read_packages, write_packages

    rows = [(1, "http://a/1", "one"), (2, None, "one"), (5, "http://a/é x", "one"), (3, "http://b", None), (4, "http://b", ""), (6, "u", "é" * 5000), (7, "u", "x\r\n\r\nWARC/1.1\r\n"), (7, "u", "x\r\n\r\nWARC/1.1\r\n"), (None, "u", "one")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_digest string")
    last = {"one": 5, "": 4, "é" * 5000: 6, rows[6][2]: 7}
    want = sorted((i or -1, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""]) for i, _, h in rows)
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op6_warc_zip(table).collect())
    assert got == want and op6_warc_zip(table.where("false")).count() == 0
    marked = mark_revisits(table)
    for zip64 in (True, False):
        packages = write_packages(marked.repartition(2), shared_dir(spark, "warc"), limit=200, zip64=zip64)
        payloads = [(r.page_id, bytes(r.payload)) for r in read_packages(packages, payload=True, tasks=3).collect() if r.record_type == "response"]
        assert sorted(payloads) == sorted((i, (h or "").encode()) for i, _, h in rows if last[h or ""] == i)


def test_zip64_end_records():
    from ledgerloom.llm.warc_zip import directory

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:  # more members than the plain end record can count
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"m{i}"), str(i))
    found = directory(raw, len(raw.getvalue()))
    assert len(found) == 66_000
    for i in (0, 65_535, 65_999):
        at, n = found[f"m{i}"]
        assert raw.getvalue()[at : at + n] == str(i).encode()
    small = io.BytesIO()
    with zipfile.ZipFile(small, "w") as z:
        z.writestr("a", "text")
        z.comment = b"a note behind the end record"
    data = bytearray(small.getvalue())
    end = data.rfind(b"PK\x05\x06")
    entries, size, offset = struct.unpack("<HII", data[end + 10 : end + 20])
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, entries, entries, size, offset) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    data[end + 8 : end + 20] = struct.pack("<HHII", 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF)
    rebuilt = bytes(data[:end]) + wide + bytes(data[end:])
    at, n = directory(io.BytesIO(rebuilt), len(rebuilt))["a"]
    assert rebuilt[at : at + n] == b"text"
    with pytest.raises(ValueError):
        directory(io.BytesIO(b"no archive"), 10)


def _components(texts, n, percent):
    sets = {}
    for i, t in texts:
        words = (t or "").lower().split()
        sets[i] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_copies_equal_brute_force(spark):
    from ledgerloom.llm.near_dedup import drop_near_duplicates, op2_near_dedup

    rng = random.Random(6)
    texts = []
    for group in range(12):
        words = [f"g{group}w{rng.randrange(200)}" for _ in range(rng.choice([25, 60, 140]))]
        for copy in range(rng.choice([1, 2, 5, 9])):
            changed = list(words)
            for _ in range(rng.choice([0, 1, 2, 4])):
                changed[rng.randrange(len(changed))] = f"c{rng.randrange(10**6)}"
            texts.append((len(texts), " ".join(changed)))
    texts += [(900, ""), (901, None), (902, "two words"), (903, "Two\nwords"), (904, "word " * 9000)]
    table = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op2_near_dedup(table.repartition(4)).collect()}
    assert got == _components(texts, 3, 85)
    assert op2_near_dedup(table.where("false")).count() == 0
    rows = spark.createDataFrame([(1, texts[0][1], 9), (1, texts[0][1], 9), (2, texts[0][1].upper(), 9), (3, None, 9), (None, "x", 9)], "doc_id long, text string, n int")
    kept = drop_near_duplicates(rows).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3] and kept[0].n == 9
    shared = spark.createDataFrame([(3, texts[0][1]), (5, texts[0][1]), (5, texts[-1][1]), (None, "x y"), (None, "x y")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.text[:3]) for r in drop_near_duplicates(shared).collect()) == sorted([(3, texts[0][1][:3]), (5, "wor"), (0, "x y"), (0, "x y")])


def test_substring_edges(spark):
    from ledgerloom.llm.substring_dedup import dedup_substrings, drop_repeated_passages

    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} {passage} c{i}", "x", None) for i in range(40)] + [(7, "other text here", "y", None), (None, passage, "z", None), (50, passage, None, None), (50, passage, None, None), (60, passage + " " + passage, "w", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, kept_text string, n_words int")
    got = dedup_substrings(table.repartition(6), per_bucket=50).collect()
    assert len(got) == len(rows)
    removed = defaultdict(list)
    for r in got:
        removed[r.doc_id].append(r.n_removed)
    assert removed[0] == [0] and all(removed[i] == [60] for i in range(1, 40) if i != 7) and sorted(removed[7]) == [0, 60]
    assert removed[50] == [60, 60] and removed[None] == [60] and removed[60] == [120]
    out = drop_repeated_passages(table.drop("kept_text").withColumn("n_chars", F.lit(0).cast("long")))
    assert {r.text for r in out.where("doc_id = 3").collect()} == {"a3 b3 c3"} and out.where("doc_id = 0").first().text == rows[0][1]


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from ledgerloom.llm.common import materialize

    rng = random.Random(8)
    passage = " ".join(f"q{rng.randrange(10**5)}" for _ in range(70))
    good = [_prose(rng, 120, [f"w{i}" for i in range(400)]) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(100, good[0]), (101, good[1] + " tail"), (102, f"{_prose(rng, 60, [f'w{i}' for i in range(400)])} {passage}"), (103, f"{passage} {_prose(rng, 60, [f'w{i}' for i in range(400)])}"), (104, good[5] [:200] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'), (105, None), (106, "")]
    rows += [(200 + i, "spam " * (30 + i)) for i in range(30)]
    schema = DOCS
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0 if i >= 200 else 1, 0) for i, _ in rows if i < 30 or i >= 200], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "secrets", "packing"]
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == [x.split()[0] for x in schema.split(", ")]
    clean = set(range(40)) | {102, 103, 104}
    assert clean <= set(seen["quality"]) and not {i for i in seen["quality"] if i >= 200}
    assert {100, 101} & set(seen["near_dedup"]) == set() and clean <= set(seen["near_dedup"])
    assert passage in seen["substring_dedup"][102] and "q" not in seen["substring_dedup"][103].split("w")[0] and passage not in seen["substring_dedup"][103]
    assert "[SECRET]" in seen["secrets"][104] and all(seen["secrets"][i] == seen["substring_dedup"][i] for i in clean - {104})
    packed = pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == set(seen["secrets"])
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == set(seen["secrets"])
