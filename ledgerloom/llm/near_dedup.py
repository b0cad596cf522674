"""MinHash near-dedup by a signature-coordinate inverted join.

1. Each text gives its set of word shingles, a 128-bit name of that set, and a signature of ``coords`` coordinates, each
   the joint hash of ``depth`` minima (so that a shared line seldom matches). Texts with one set form a class; one
   vertex stands for it.
2. A pair that matches in at least ``threshold`` coordinates matches in one of any ``coords - threshold + 1``: only
   this prefix of coordinates is posted, as (coordinate, value) lists.
3. Leader round: each list's most central member (whose values have the longest lists) is its leader; members are
   paired with leaders, never with each other. Pairs below the threshold are skipped, the others confirmed on the
   full sets. In a group of near copies nearly all fall into one component here.
4. Cross round: lists whose members lie in one component are merged and skipped. Members of the others are joined
   across components by their full sets: a shingle's list holds only the texts that have it among their rarest (the
   prefix that a pair at the limit must share), a list's largest component is never paired with itself, and the join
   skips pairs whose positions leave too few common shingles. What is left is confirmed, so no link between
   components is lost; a link inside a component changes nothing.
5. Components of the confirmed links by label propagation with pointer jumping; a component of the leader round is one
   vertex when the links across are followed.

The threshold lies 5.2 standard deviations below what a pair at the limit of similarity is expected to match, so such
a pair is missed with a probability of the order of 1e-7.
Defined results: a null text or one without words has an empty set, is linked with nothing and is its own component;
with fewer words than a shingle, the whole sequence is the one shingle; repeated rows are linked; a null doc_id
has a null component unless it is linked with a row that has one; the least (doc_id, hash of the text) names a component,
so ties do not matter; a very long text is read whole; an empty table gives an empty result; other columns are ignored,
or carried along by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, column_bytes, materialize, mix, slices

_U = np.uint64


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the distinct shingles of each text, sorted by both."""
    w = Words([t.lower() for t in texts])  # bytes.lower() changes A-Z only
    at = np.flatnonzero(w.whole(n)) if len(w.hash) >= n else np.zeros(0, dtype=np.int64)
    owner, value = w.owner[at], w.grams(n)[at] if len(at) else np.zeros(0, dtype=np.uint64)
    few = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(few):
        short = np.array([mix(np.array([int.from_bytes(hashlib.blake2b(b" ".join(texts[i].lower().split()), digest_size=8).digest(), "little")], dtype=np.uint64))[0] for i in few.tolist()], dtype=np.uint64)
        owner, value = np.concatenate([owner, few]), np.concatenate([value, short])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _sign(batches: Iterator[pa.RecordBatch], n: int, coords: int, depth: int) -> Iterator[pa.RecordBatch]:
    salts = mix(np.arange(1, coords * depth + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F)) | _U(1)
    for b in batches:
        texts = column_bytes(b.column(2))
        for lo, hi in slices(texts, 1 << 20):
            owner, value = shingle_sets(texts[lo:hi], n)
            size = np.bincount(owner, minlength=hi - lo)
            have = np.flatnonzero(size)
            begin = np.searchsorted(owner, have)
            sig = np.zeros((hi - lo, coords), dtype=np.uint32)
            for c in range(coords if len(have) else 0):
                joint = np.zeros(len(have), dtype=np.uint64)
                for salt in salts[c * depth : (c + 1) * depth]:
                    v = value * salt
                    v ^= v >> _U(29)
                    joint = mix(joint + np.minimum.reduceat(v * _U(0xBF58476D1CE4E5B9), begin))
                sig[have, c] = joint >> _U(32)
            end = np.append(begin[1:], len(value))
            name: list[bytes | None] = [None] * (hi - lo)
            for i, x, y in zip(have.tolist(), begin.tolist(), end.tolist()):
                name[i] = hashlib.blake2b(value[x:y].tobytes(), digest_size=16).digest()
            yield pa.record_batch([
                b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(name, pa.binary()),
                pa.array([s.view(np.int32).tolist() if x else None for s, x in zip(sig, size)], pa.list_(pa.int32())),
            ], names=["doc_id", "tk", "n", "c", "sig"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = column_bytes(b.column("text"))
        for lo, hi in slices(texts, 1 << 20):
            owner, value = shingle_sets(texts[lo:hi], n)
            size = np.bincount(owner, minlength=hi - lo)
            at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            yield pa.record_batch([b.column("c").slice(lo, hi - lo), b.column("home").slice(lo, hi - lo), pa.array(size, pa.int32()), pa.ListArray.from_arrays(at, pa.array(value.view(np.int64)))], names=["c", "home", "n", "tokens"])


def _confirm(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        one, two = column_bytes(b.column("text_a")), column_bytes(b.column("text_b"))
        known: dict[bytes, np.ndarray] = {}
        keep = []
        for a, c in zip(one, two):
            if len(known) > 256:
                known.clear()
            for t in (a, c):
                if t not in known:
                    known[t] = shingle_sets([t], n)[1]
            x, y = known[a], known[c]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        mask = pa.array(keep, pa.bool_())
        yield b.drop_columns(["text_a", "text_b"]).filter(mask)


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """c and label (least (doc_id, c) that it reaches) of the linked vertices. links: a, b; vertices: c, doc_id."""
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a"))
    label = vertices.join(both.select(F.col("src").alias("c")).distinct(), "c").select("c", F.struct("doc_id", "c").alias("label"))
    label = materialize(label, "labels")
    while True:
        near = both.join(label.withColumnRenamed("c", "dst"), "dst").groupBy("src").agg(F.min("label").alias("near")).withColumnRenamed("src", "c")
        step = label.join(near, "c").select("c", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = label.select(F.col("c").alias("at"), F.col("label").alias("beyond"))
        step = step.join(jump, F.col("to")["c"] == F.col("at"), "left").select("c", "was", F.least("to", F.coalesce("beyond", "to")).alias("label"))
        step = materialize(step, "labels")
        label = step.select("c", "label")
        if step.where(~F.col("was").eqNullSafe(F.col("label"))).limit(1).count() == 0:
            return label


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, coords: int = 32, depth: int = 3, threshold: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and tk (hash of the text) of every row. Links have 100 * intersection >= percent * union."""
    chance = (percent / 100) ** depth  # that a coordinate of a pair at the limit matches
    threshold = threshold or max(1, int(coords * chance - 5.2 * (coords * chance * (1 - chance)) ** 0.5))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tk"), text.alias("text"))
    signed = materialize(rows.mapInArrow(lambda it: _sign(it, shingle, coords, depth), "doc_id long, tk long, n long, c binary, sig array<int>"), "signatures")
    classes = signed.where("n > 0 and doc_id is not null").groupBy("c").agg(F.min(F.struct("doc_id", "tk")).alias("rep"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.select("c", "rep.doc_id", "rep.tk", "sig", "copies"), "classes")

    prefix = coords - threshold + 1
    posted = F.posexplode(F.slice("sig", 1, prefix)).alias("coord", "value")
    key = F.xxhash64("coord", "value").alias("key")
    posts = classes.select("c", posted).select("c", key)
    long_lists = materialize(posts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "lists")
    central = posts.join(long_lists, "key").groupBy("c").agg(F.collect_list("key").alias("keys"), F.sum("size").alias("weight"))  # at most ``prefix`` keys
    shared = materialize(central.select(F.explode("keys").alias("key"), "c", "weight"), "posts")
    leaders = materialize(shared.groupBy("key").agg(F.min(F.struct((-F.col("weight")).alias("w"), "c")).alias("lead")).select("key", F.col("lead.c").alias("lead")), "leaders")

    matches = lambda x, y: F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda p: p))
    sigs = classes.select(F.col("c").alias("v"), "sig")
    texts = rows.join(classes.select(F.col("doc_id").alias("d"), F.col("tk").alias("t"), "c"), (F.col("doc_id") == F.col("d")) & (F.col("tk") == F.col("t"))).select("c", "text")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        wanted = materialize(pairs, f"{name}-pairs")
        more = "".join(f", {f.name} binary" for f in wanted.schema if f.name not in "ab")
        ends = wanted.select(F.col("a").alias("c")).union(wanted.select("b")).distinct()
        needed = materialize(texts.join(ends, "c").groupBy("c").agg(F.first("text").alias("text")), f"{name}-texts")
        both = wanted.join(needed.select(F.col("c").alias("a"), F.col("text").alias("text_a")), "a").join(needed.select(F.col("c").alias("b"), F.col("text").alias("text_b")), "b")
        return materialize(both.mapInArrow(lambda it: _confirm(it, shingle, percent), f"a binary, b binary{more}"), name)

    led = shared.join(leaders, "key").where("c <> lead").select(F.least("c", "lead").alias("a"), F.greatest("c", "lead").alias("b")).distinct()
    led = led.join(sigs.select(F.col("v").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("v").alias("b"), F.col("sig").alias("sig_b")), "b")
    links = confirmed(led.where(matches("sig_a", "sig_b") >= threshold).select("a", "b"), "led")
    label = components(classes.select("c", "doc_id"), links)

    home = F.coalesce(F.col("label.c"), F.col("c")).alias("home")
    homes = materialize(shared.select("key", "c").join(label, "c", "left").select("key", "c", home), "homes")
    mixed = materialize(homes.groupBy("key").agg(F.min("home").alias("lo"), F.max("home").alias("hi")).where("lo <> hi").select("key"), "mixed")
    members = homes.join(mixed, "key").select("c", "home").distinct()
    members = materialize(members.join(texts, "c").groupBy("c", "home").agg(F.first("text").alias("text")), "members")
    sets = members.mapInArrow(lambda it: _sets(it, shingle), "c binary, home binary, n int, tokens array<long>")
    sets = materialize(sets, "sets")
    tokens = sets.select("c", F.explode("tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    order = tokens.join(common, "token").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("order"))
    head = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1  # tokens that no other text has come first in the order of rarity
    alone = (F.col("n") - F.size("order")).alias("alone")
    posts = sets.select("c", "home", "n").join(order, "c").select("c", "home", "n", alone, head.cast("int").alias("head"), "order").where("head > alone")
    posts = posts.select("c", "home", "n", "alone", F.posexplode(F.slice("order", F.lit(1), F.col("head") - F.col("alone"))).alias("i", "o"))
    posts = materialize(posts.select("c", "home", "n", (F.col("alone") + F.col("i")).alias("pos"), "o.token"), "prefixes")
    largest = posts.groupBy("token", "home").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max_by("home", F.struct("k", "home")).alias("main"), F.count(F.lit(1)).alias("homes")).where("homes > 1")
    largest = materialize(largest.select("token", "main"), "mains")
    few = materialize(posts.join(largest, "token").where("home <> main").drop("main"), "few")
    one = few.select("token", F.col("c").alias("a"), F.col("home").alias("home_a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"))
    two = posts.select("token", F.col("c").alias("b"), F.col("home").alias("home_b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"))
    most = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))  # of common shingles, from here on
    cross = one.join(two, (one["token"] == two["token"]) & (F.col("home_a") != F.col("home_b")) & ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))))
    ends = F.least(*(F.struct(F.col(x).alias("a"), F.col(f"home_{x}").alias("h")) for x in "ab")), F.greatest(*(F.struct(F.col(x).alias("a"), F.col(f"home_{x}").alias("h")) for x in "ab"))
    cross = cross.select(ends[0].alias("x"), ends[1].alias("y")).select("x.a", F.col("y.a").alias("b"), F.col("x.h").alias("home_a"), F.col("y.h").alias("home_b")).distinct()
    more = confirmed(cross, "cross")
    if not more.isEmpty():  # a component of the leader round is one vertex now
        joined = materialize(more.select(F.least("home_a", "home_b").alias("a"), F.greatest("home_a", "home_b").alias("b")).distinct(), "joined")
        beyond = components(classes.select("c", "doc_id"), joined).select(F.col("c").alias("home"), F.col("label").alias("beyond"))
        label = classes.select("c").join(label, "c", "left").select("c", "label", home).join(beyond, "home", "left")
        label = label.select("c", F.coalesce("beyond", "label").alias("label")).where("label is not null")

    found = classes.join(label, "c", "left").withColumn("component_id", F.coalesce("label.doc_id", "doc_id"))
    found = materialize(found.where("copies > 1 or component_id <> doc_id").select(F.col("c").alias("of"), "component_id"), "components")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "c", "tk").join(found, F.col("c") == F.col("of"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "tk")


def op2_near_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, shingle=3, percent=85).drop("tk")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near duplicates (five-word shingles, similarity 0.8). Rows that share an id
    but not a text are decided each by itself, rows that repeat another wholly stay once, rows without an id all stay."""
    gone = near_duplicates(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__of"), F.col("tk").alias("__tk")).distinct()
    same = (F.col("doc_id").cast("long") == F.col("__of")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("__tk"))
    left = docs.join(gone, same, "left_anti").withColumn("__apart", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    return left.dropDuplicates(["doc_id", "text", "__apart"]).select(*docs.columns)
