"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words. Consecutive windows of a document that share a minimiser (the least hash of
their ``m``-word runs) form a super-k-mer, which travels as one packed string to its minimiser's bucket; all copies
of a window therefore meet in one bucket, where sorting finds every window that starts earlier elsewhere.

* Skew: a first pass counts the super-k-mers of all texts in many more counters than there are buckets, by minimiser.
  A counter only ever says too much, so every minimiser with more super-k-mers than an average bucket holds lies in a
  *hot* one. The hot ones are broadcast as one bit a counter (``counters`` bits at most, 32 MB). Windows of hot
  minimisers travel one by one, by their own hash, and only the first of each slice does: the later ones of
  that slice are known to be repeats already. Whole texts that repeat within a slice are settled the same way. So a
  window that stands in every slice (8 MB of text) costs its bucket one short row a slice.
* Exactness: windows are grouped by a 64-bit hash and then compared word by word; where a hash is shared by
  different words, these windows are grouped by their words instead.

Defined results: a null or empty text has no words; a null ``doc_id`` sorts after all others; rows that repeat a
``doc_id`` with another text are documents of their own, ordered by a 32-bit hash of the text; wholly equal rows get
equal results and do not remove each other. Other columns are carried along; ``n_words``, ``n_removed`` and
``kept_text`` replace columns of these names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, Words, column_bytes, materialize, shuffle_partitions, sliding_min, slices

ADDED = ("n_words", "n_removed", "kept_text")


def _runs(w: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer."""
    ok = w.whole(k)
    if not ok.any():
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    least = sliding_min(w.grams(m), k - m + 1)
    at = np.flatnonzero(ok)
    value = least[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    return at[begin], np.diff(np.append(begin, len(at))), value[begin]


SEGMENT = 4096  # counters that travel as one row


def _count(batches: Iterator[pa.RecordBatch], k: int, m: int, counters: int) -> Iterator[pa.RecordBatch]:
    """Super-k-mers by counter, which the minimiser names: for each slice and segment, packed pairs of counter and number."""
    for b in batches:
        texts = column_bytes(b.column(0))
        for lo, hi in slices(texts):
            counter, n = np.unique(_counter(_runs(Words(texts[lo:hi]), k, m)[2], counters), return_counts=True)
            pairs = np.stack([counter, n], axis=1).astype(np.int64)
            cut = np.flatnonzero(np.diff(counter // SEGMENT)) + 1
            parts = [x for x in np.split(pairs, cut) if len(x)]
            yield pa.record_batch([pa.array([int(x[0, 0]) // SEGMENT for x in parts], pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["segment", "pairs"])


def _add(t: pa.Table) -> pa.Table:
    """The numbers of one segment added up."""
    pairs = np.frombuffer(b"".join(t.column("pairs").to_pylist()), np.int64).reshape(-1, 2)
    first = int(t.column("segment")[0].as_py()) * SEGMENT
    n = np.zeros(SEGMENT, dtype=np.int64)
    np.add.at(n, pairs[:, 0] - first, pairs[:, 1])
    return pa.table({"first": pa.array([first], pa.int64()), "total": pa.array([int(n.sum())], pa.int64()), "n": pa.array([n.tobytes()], pa.binary())})


def _above(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hot = [first + np.flatnonzero(np.frombuffer(n, np.int64) > limit) for first, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *hot]))], names=["counter"])


def _counter(value: np.ndarray, counters: int) -> np.ndarray:
    return (value >> np.uint64(20)).astype(np.int64) % counters


def _blob(doc: np.ndarray, key: np.ndarray, start: np.ndarray, parts: list[bytes], pack: zstandard.ZstdCompressor) -> bytes:
    head = np.array([len(doc)], dtype=np.int64).tobytes()
    return pack.compress(head + doc.tobytes() + start.tobytes() + key.astype(np.uint32).tobytes() + b"\n".join(parts))


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    doc, start = (np.frombuffer(raw, np.int64, n, 8 + 8 * n * i) for i in range(2))
    return doc, np.frombuffer(raw, np.uint32, n, 8 + 16 * n).astype(np.int64), start, raw[8 + 20 * n :]


_SPREAD = pa.schema([("bucket", pa.int64()), ("doc_key", pa.int64()), ("text_key", pa.int64()), ("blob", pa.binary())])


def _spread(batches: Iterator[pa.RecordBatch], k: int, m: int, buckets: int, counters: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per bucket and slice with its packed super-k-mers; rows with a ``doc_key`` carry settled repeats. hot: a bit a counter."""
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        ids = b.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
        keys = b.column(1).to_numpy(zero_copy_only=False)
        texts = column_bytes(b.column(2))
        order = np.lexsort((keys, ids))
        ids, keys, texts = ids[order], keys[order], [texts[i] for i in order]
        for lo, hi in slices(texts):
            rows: dict[str, list] = {n: [] for n in _SPREAD.names}

            def put(bucket, doc, key, blob, rows=rows):
                for n, v in zip(_SPREAD.names, (bucket, doc, key, blob)):
                    rows[n].append(v)

            doc, key, seen, keep = ids[lo:hi], keys[lo:hi], {}, []
            w = Words(texts[lo:hi])
            for i, t in enumerate(texts[lo:hi]):
                j = seen.setdefault(t, i)
                if i == j or (doc[i], key[i]) == (doc[j], key[j]):
                    keep.append(i == j)
                else:
                    keep.append(False)
                    if w.count[i] >= k:
                        put(int(doc[i]) % buckets, int(doc[i]), int(key[i]), np.array([[0, w.count[i] - k + 1]], dtype=np.int64).tobytes())
            at, n, value = _runs(w, k, m)
            chosen = np.array(keep, dtype=bool)[w.owner[at]] if len(at) else np.zeros(0, dtype=bool)
            at, n, value = at[chosen], n[chosen], value[chosen]
            c = _counter(value, counters)
            is_hot = (hot[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
            goes = (value % np.uint64(buckets)).astype(np.int64)
            if is_hot.any():
                single = np.repeat(at[is_hot], n[is_hot]) + np.concatenate([np.arange(x) for x in n[is_hot]])
                whole = w.grams(k)[single]
                by = np.lexsort((single, whole))
                single, whole = single[by], whole[by]
                again = np.zeros(len(single), dtype=bool)
                for x in np.flatnonzero(whole[1:] == whole[:-1]) + 1:
                    i, j = single[x], single[x - 1]
                    again[x] = _same(w, i, j, k)
                repeats = np.sort(single[again])
                for o in np.unique(w.owner[repeats]):
                    p = repeats[w.owner[repeats] == o] - w.first[o]
                    put(int(doc[o]) % buckets, int(doc[o]), int(key[o]), _intervals(p).tobytes())
                at = np.concatenate([at[~is_hot], single[~again]])
                n = np.concatenate([n[~is_hot], np.ones((~again).sum(), dtype=np.int64)])
                goes = np.concatenate([goes[~is_hot], (whole[~again] % np.uint64(buckets)).astype(np.int64)])
            by = np.argsort(goes, kind="stable")
            at, n, goes = at[by], n[by], goes[by]
            own, first = w.owner[at], w.start[at]
            last = w.end[at + n + k - 2]
            cut = np.flatnonzero(np.diff(goes)) + 1
            for x, y in zip([0, *cut], [*cut, len(goes)]):
                if x < y:
                    parts = [b" ".join(w.data[s:e].split()) for s, e in zip(first[x:y].tolist(), last[x:y].tolist())]
                    put(int(goes[x]), None, None, _blob(doc[own[x:y]], key[own[x:y]], at[x:y] - w.first[own[x:y]], parts, pack))
            yield pa.record_batch([pa.array(rows[f.name], f.type) for f in _SPREAD], schema=_SPREAD)


def _same(w: Words, i: int, j: int, k: int) -> bool:
    a, b = w.data[w.start[i] : w.end[i + k - 1]], w.data[w.start[j] : w.end[j + k - 1]]
    return a == b or a.split() == b.split()


def _intervals(p: np.ndarray) -> np.ndarray:
    """Pairs (first, number) of runs of consecutive window starts."""
    begin = np.flatnonzero(np.concatenate([[True], np.diff(p) > 1]))
    return np.stack([p[begin], np.diff(np.append(begin, len(p)))], axis=1).astype(np.int64)


_REPEATS = pa.schema([("doc_key", pa.int64()), ("text_key", pa.int64()), ("spans", pa.binary())])


def _repeats(t: pa.Table, k: int) -> pa.Table:
    """Windows of one bucket that start earlier elsewhere, as spans by document."""
    out_doc, out_key, out = [], [], []
    heads, parts = [], []
    for d, tk, blob in zip(t.column("doc_key"), t.column("text_key"), t.column("blob")):
        if d.is_valid:
            out_doc.append(d.as_py())
            out_key.append(tk.as_py())
            out.append(blob.as_py())
        else:
            *head, words = _unblob(blob.as_py())
            heads.append([x.copy() for x in head])  # not a view of all that was unpacked
            parts.append(words)
    if heads:
        doc, key, start = (np.concatenate([h[i] for h in heads]) for i in range(3))
        texts = b"\n".join(parts).split(b"\n")
        del heads, parts
        w = Words(texts)
        del texts
        at = np.flatnonzero(w.whole(k))
        h = w.grams(k)[at]
        w.hash = None  # not needed any more
        own = w.owner[at]
        d, tk, pos = doc[own], key[own], start[own] + at - w.first[own]
        a, n = w.start[at], w.end[at + k - 1]
        data = w.data
        del w, own, at, doc, key, start
        order = np.lexsort((pos, tk, d, h))
        hs = h[order]
        del h
        same = np.zeros(len(order), dtype=bool)
        same[1:] = hs[1:] == hs[:-1]
        bad = []
        for x in np.flatnonzero(same).tolist():
            i, j = order[x], order[x - 1]
            if data[a[i] : n[i]] != data[a[j] : n[j]]:
                bad.append(hs[x])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        for value in set(bad):  # different words under one hash: group these by their words
            group: dict[bytes, int] = {}
            for x in np.flatnonzero(hs == value).tolist():
                i = order[x]
                head[x] = group.setdefault(data[a[i] : n[i]], x)
        del data, a, n, hs, same
        f, o = order[head], order
        dup = (d[f] != d[o]) | (tk[f] != tk[o]) | (pos[f] != pos[o])
        o = o[dup]
        o = o[np.lexsort((pos[o], tk[o], d[o]))]
        if len(o):
            new = np.flatnonzero((np.diff(d[o]) != 0) | (np.diff(tk[o]) != 0)) + 1
            for x, y in zip([0, *new], [*new, len(o)]):
                out_doc.append(int(d[o[x]]))
                out_key.append(int(tk[o[x]]))
                out.append(_intervals(np.unique(pos[o[x:y]])).tobytes())
    return pa.table([pa.array(out_doc, pa.int64()), pa.array(out_key, pa.int64()), pa.array(out, pa.binary())], schema=_REPEATS)


def _apply(batches: Iterator[pa.RecordBatch], k: int, schema: pa.Schema, text_at: int, spans_at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = column_bytes(b.column(text_at))
        spans = b.column(spans_at).to_pylist()
        total, removed, kept = [], [], []
        for t, s in zip(raw, spans):
            words = t.split()  # bytes.split cuts at the same six ASCII characters
            gone = 0
            if s:
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                for first, n in np.frombuffer(b"".join(s), dtype=np.int64).reshape(-1, 2):
                    cover[first] += 1
                    cover[first + n + k - 1] -= 1
                stay = np.cumsum(cover[:-1]) == 0
                gone = int(len(words) - stay.sum())
                words_kept = [x for x, y in zip(words, stay.tolist()) if y]
            else:
                words_kept = words
            total.append(len(words))
            removed.append(gone)
            kept.append(b" ".join(words_kept))
        columns = [b.column(b.schema.get_field_index(f.name)) for f in schema if f.name not in ADDED]
        columns += [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.record_batch(columns, schema=schema)


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF))


def dedup_substrings(docs: DataFrame, k: int = 20, m: int = 2, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 100_000, counters: int = 1 << 28) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space).

    ``per_bucket`` is the number of super-k-mers that a bucket should hold, ``counters`` the most counters for them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    text = F.col(text_col).cast("string")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    likely = max(4 * shuffle_partitions(spark), size // 60 // per_bucket + 1)  # buckets, at some 60 bytes a super-k-mer
    counters = min(counters, 1 << (16 * likely).bit_length())
    counts = docs.select(text.alias("text")).mapInArrow(lambda it: _count(it, k, m, counters), "segment long, pairs binary")
    counts = materialize(counts.groupBy("segment").applyInArrow(_add, "first long, total long, n binary"), "counts")
    total = counts.agg(F.sum("total")).first()[0] or 0
    buckets = max(4 * shuffle_partitions(spark), total // per_bucket + 1)
    limit = max(1000, total // buckets)
    hot = np.zeros(counters // 8 + 1, dtype=np.uint8)
    for (c,) in counts.select("first", "n").mapInArrow(lambda it: _above(it, limit), "counter long").collect():  # fewer than buckets, as each holds more than an average one
        hot[c >> 3] |= 1 << (c & 7)
    shared = spark.sparkContext.broadcast(hot)
    spread = (
        docs.select(F.col(id_col).cast("long").alias("doc_key"), _text_key(text).alias("text_key"), text.alias("text"))
        .mapInArrow(lambda it: _spread(it, k, m, buckets, counters, shared.value), "bucket long, doc_key long, text_key long, blob binary")
    )
    repeats = spread.groupBy("bucket").applyInArrow(lambda t: _repeats(t, k), "doc_key long, text_key long, spans binary")
    spans = repeats.groupBy("doc_key", "text_key").agg(F.collect_list("spans").alias("__spans")).withColumnsRenamed({"doc_key": "__of_doc", "text_key": "__of_text"})
    left = docs.withColumns({"__doc": F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))), "__key": _text_key(text), "__text": text})
    joined = left.join(spans, (F.col("__doc") == F.col("__of_doc")) & (F.col("__key") == F.col("__of_text")), "left")
    out = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    schema = to_arrow_schema(out)
    names = [*docs.columns, "__text", "__spans"]
    return joined.select(*names).mapInArrow(lambda it: _apply(it, k, schema, len(names) - 2, len(names) - 1), out)


def op1_substring_dedup(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; a text without any stays as it is."""
    found = dedup_substrings(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
