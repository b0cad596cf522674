"""Order MinHash fingerprints: sketches sensitive to edit distance.

A text's k-mers (``k`` UTF-8 bytes) are numbered by occurrence. For each of ``m`` hash functions the ``width`` least
of them are selected, put back in text order and hashed together; the fingerprint is the ``m`` hashes. Texts that
hold the same k-mers in another order share few of them.

Defined results: a null or empty text has no k-mers and one fixed fingerprint; a text shorter than k is one k-mer;
two texts have likeness 1 if their fingerprints are equal. Rows are ordered by descending doc_id, then a hash of the text; a null
doc_id comes last. The only document is its own next; repeated rows stand beside each other; a very long text is sketched
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix
from .neighbours import with_neighbours

_U = np.uint64


def sketch(text: str, k: int = 8, m: int = 24, width: int = 2) -> str:
    """``m`` hashes of eight hex digits."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return "0" * (8 * m)
    if len(raw) < k:
        raw = np.concatenate([raw, np.zeros(k - len(raw), dtype=np.uint8)])
    n = len(raw) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = h * _U(0x9E3779B97F4A7C15) + raw[j : j + n]
    h = mix(h)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if same.any():  # number the occurrences of a repeated k-mer
        member = np.zeros(n, dtype=bool)
        member[1:] |= same
        member[:-1] |= same
        at = order[member]
        at = at[np.lexsort((at, h[at]))]
        new = np.concatenate([[True], h[at[1:]] != h[at[:-1]]])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        h[at] = mix(h[at] + (np.arange(len(at)) - begin).astype(np.uint64) * _U(0xD1342543DE82EF95))
    salts = mix(np.arange(1, m + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)
    take = min(width, n)
    best = np.empty((m, take), dtype=np.int64)
    step = max(1, (1 << 16) // n)
    for lo in range(0, m, step):
        v = h[None, :] * salts[lo : lo + step, None]
        v ^= v >> _U(32)
        rows = np.arange(len(v))
        for t in range(take):
            best[lo : lo + step, t] = at = v.argmin(axis=1)
            v[rows, at] = ~_U(0)
    best.sort(axis=1)
    value = np.zeros(m, dtype=np.uint64)
    for t in range(take):
        value = mix(value * _U(0x9E3779B97F4A7C15) + h[best[:, t]])
    return value.astype(">u8").view(np.uint8).reshape(m, 8)[:, :4].tobytes().hex()


_sketched = lru_cache(maxsize=2)(sketch)  # a text is its own, then the next of the row after it


def likeness(a: str, b: str) -> float:
    """Share of equal hashes of two fingerprints."""
    m = len(a) // 8
    return sum(a[i : i + 8] == b[i : i + 8] for i in range(0, 8 * m, 8)) / m


def _compare(row: dict, before: dict | None, after: dict | None) -> dict:
    text, following = row["text"] or "", (after or {}).get("text") or ""
    n = len(text) // 3
    edited = text[: len(text) - n] + following[:n]
    own, other, following_print = _sketched(text), sketch(edited), _sketched(following)
    return {
        "doc_id": row["doc_id"], "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": own, "edited_fingerprint": other, "near_edited": likeness(own, other), "near_next": likeness(own, following_print),
    }


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` of every row."""
    rows = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))

    @F.pandas_udf("string")
    def prints(texts):
        return texts.map(sketch)

    return rows.select(id_col, prints("__text").alias("fingerprint"))


def op8_order_minhash(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_neighbours(rows, order, lambda r: {"text": r["text"]}, _compare, fields, circular=True)
