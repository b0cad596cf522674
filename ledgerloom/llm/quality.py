"""Quality scores by nearest-neighbour voting in a latent semantic space.

Terms are byte trigrams hashed to ``terms`` columns, and words that repeat the word before. A bounded sample of labelled rows
(``sample`` rows, those of the least hashes of doc_id and text) gives term weights, the leading ``rank`` singular directions and the labelled
vectors; these (``sample`` x ``rank`` numbers) are broadcast. Every document's cosine with every labelled vector is
computed exactly, in blocks, and the ``k`` most similar neighbours vote with their similarity as weight.

Defined results: a null or empty text, or one without similar neighbours, gets the sample's share of label 1 (0.5
without labels); rows with null labels or ids teach nothing; repeated rows score alike; a very long text is counted whole;
an empty table gives an empty result. Ties among neighbours are broken by their place in the sorted sample. Other columns
are carried along, ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Words, column_bytes, load, slices


#: Bands of the share of words that repeat the word before; each is a term of its own.
REPEATED = ((0.1, 0.3), (0.3, 0.6), (0.6, 1.1))


def term_counts(texts: list[bytes], terms: int) -> np.ndarray:
    """Dampened term counts, one row per text; the last columns count words equal to the word before, by the share of such words."""
    data = np.frombuffer(b"\x00\x00".join(texts) + b"\x00\x00", dtype=np.uint8).astype(np.uint32)
    size = np.array([len(t) + 2 for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), size)[:-2]
    code = (data[:-2] * np.uint32(2654435761)) ^ (data[1:-1] * np.uint32(2246822519)) ^ (data[2:] * np.uint32(3266489917))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(668265263)
    inside = (data[:-2] != 0) & (data[1:-1] != 0) & (data[2:] != 0)
    at = owner * terms + (code >> np.uint32(8)) % np.uint32(terms)
    counts = np.bincount(at[inside], minlength=len(texts) * terms).reshape(len(texts), terms).astype(np.float32)
    w = Words(texts)
    again = np.zeros(len(texts))
    if len(w.hash) > 1:
        same = (w.hash[1:] == w.hash[:-1]) & (w.owner[1:] == w.owner[:-1])
        again = np.bincount(w.owner[1:][same], minlength=len(texts))
    share = again / np.maximum(w.count, 1)
    bands = np.stack([again * ((share >= lo) & (share < hi)) for lo, hi in REPEATED], axis=1).astype(np.float32)
    return np.hstack([np.log1p(counts), 8 * np.log1p(bands)])


def _features(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = column_bytes(b.column(0))
        for lo, hi in slices(texts, 1 << 20):
            x = term_counts(texts[lo:hi], terms)
            yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1).slice(lo, hi - lo)], names=["x", "label"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", terms: int = 1024, rank: int = 64, sample: int = 4000) -> dict[str, np.ndarray]:
    """``labels`` holds the rows that may be learnt from."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "label").limit(sample)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "__id")
    least = texts.select("__id", F.xxhash64("text").alias("tk"), "label", "text").orderBy(F.xxhash64("__id"), "tk", "label").limit(sample)  # ids that repeat: as many rows, always the same
    rows = least.select("text", "label").mapInArrow(lambda it: _features(it, terms), "x binary, label double").collect()
    rows.sort(key=lambda r: (r["x"], r["label"]))
    if not rows:
        return {"prior": np.float64(0.5)}
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in rows]).astype(np.float64)
    y = np.array([r["label"] for r in rows])
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    x = _unit(x * weight)
    values, vectors = np.linalg.eigh(x.T @ x)
    basis = vectors[:, ::-1][:, :rank]
    return {"weight": weight, "basis": basis, "known": _unit(x @ basis).astype(np.float32), "label": y, "prior": np.float64(y.mean())}


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def vote(x: np.ndarray, model: dict[str, np.ndarray], k: int) -> np.ndarray:
    """Similarity-weighted share of label 1 among the k nearest labelled vectors of each row of counts."""
    out = np.full(len(x), float(model["prior"]))
    if "known" not in model:
        return out
    sim = (_unit(_unit(x * model["weight"]) @ model["basis"]).astype(np.float32)) @ model["known"].T
    k = min(k, sim.shape[1])
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(sim, near, axis=1), 0).astype(np.float64) ** 4
    total = weight.sum(axis=1)
    found = (total > 0) & (x.sum(axis=1) > 0)
    out[found] = ((weight * model["label"][near]).sum(axis=1) / np.where(total > 0, total, 1))[found]
    return np.clip(out, 0, 1)


def score_documents(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", k: int = 15) -> DataFrame:
    """``docs`` with ``score``, the likelihood of label 1."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    terms = len(model["weight"]) - len(REPEATED) if "weight" in model else 16
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = column_bytes(b.column(-1))
            for lo, hi in slices(texts, 1 << 20):
                part = b.slice(lo, hi - lo)
                score = np.concatenate([vote(term_counts(texts[i : min(i + 500, hi)], terms), shared.value, k) for i in range(lo, hi, 500)])
                yield pa.record_batch([*part.columns[:-1], pa.array(score)], schema=arrow)

    return docs.select("*", F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def learnable(labels: DataFrame) -> DataFrame:
    """Label rows outside the held-out third."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, learnable(load(spark, sf_dir, "labels"))))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5; the model learns from ``docs`` and the labels' learnable rows."""
    scored = score_documents(docs, fit(docs, learnable(load(spark, sf_dir, "labels"))))
    return scored.where("score >= 0.5").select(*docs.columns)
