"""Source divergence audit over a minimal acyclic transducer vocabulary.

1. Document frequencies of (lang, term) are counted inside each task and added up; terms of at least ``least`` documents are
   kept, range-partitioned and sorted, and cut into blocks of at most 65,536 terms (or 16 MB) of one language.
2. Each block is built into a minimal acyclic transducer (``transducer``) that gives a term's place in its block. A block's
   base, the number of the language's terms before it, turns places into lexicographic ordinals.
3. Texts are streamed through the transducers for the counts: a task sends the terms of its texts, by group (lang, source)
   and block, as sorted runs with their numbers, and the transducer stands first in the stream that it counts. Which term
   starts which block is all that every task knows (one row a block). Blocks with many occurrences are salted.
4. Probabilities are integers by exact decimals. Divergence of pairs: groups' counts are laid out in slabs of consecutive
   ordinals, a matrix of groups by terms in one task of at most 4,000,000 cells, whose sums for each pair are added up: the
   rows that travel are pairs a slab, not pairs a term. Ties go by the ordinal, which is the order of the UTF-8 bytes.

Defined results: null text, lang and source are empty; each row is a document, also one that repeats another; a group without
terms has count 0 for every kept term; a language without kept terms gives pairs of value 0 and no terms; very long texts and
terms are read whole; an empty table gives an empty result; other columns are ignored. The pairs of a language's
sources are the result itself, so a group is expected to fit a task as one row for each source.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_bytes, materialize, shuffle_partitions
from .transducer import Transducer

_TERM = re.compile(rb"[a-z\x80-\xff]+")  # of lower-cased bytes: ASCII letters and all beyond ASCII
_HELD = 600_000  # entries that a task holds before it hands them on
SCALE = 1_000_000_000
CELLS = 4_000_000


def terms_of(text: bytes) -> list[bytes]:
    return _TERM.findall(text.lower())  # bytes.lower() changes A-Z only


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, documents) of this task's texts."""
    held: dict[bytes, Counter] = defaultdict(Counter)

    def give() -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            yield pa.record_batch([pa.array([lang.decode()] * len(n), pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["lang", "term", "docs"])
        held.clear()

    for b in batches:
        for i, (lang, text) in enumerate(zip(column_bytes(b.column(0)), column_bytes(b.column(1)))):
            held[lang].update(set(terms_of(text)))
            if i % 256 == 255 and sum(map(len, held.values())) > _HELD:
                yield from give()
    yield from give()


_VOCABULARY = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("place", pa.int32()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64()), ("machine", pa.binary())])


def _vocabulary(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted terms with their places, and one row a block with its transducer and first term."""
    number = TaskContext.get().partitionId() << 32
    lang, terms, docs, size = None, [], 0, 0

    def give() -> Iterator[pa.RecordBatch]:
        k = len(terms)
        columns = ([lang] * (k + 1), [number] * (k + 1), [*range(k), None], [*terms, terms[0]], [None] * k + [k], [None] * k + [docs], [None] * k + [Transducer.build(terms).dumps()])
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _VOCABULARY)], schema=_VOCABULARY)

    for b in batches:
        for here, term, d in zip(*(c.to_pylist() for c in b.columns)):
            if terms and (here != lang or len(terms) == most or size > 16 << 20):
                yield from give()
                number, terms, docs, size = number + 1, [], 0, 0
            lang, docs, size = here, docs + d, size + len(term)
            terms.append(term)
    if terms:
        yield from give()


_RUNS = "lang string, block long, salt int, source string, terms binary, counts binary"
_RUN = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("salt", pa.int32()), ("source", pa.string()), ("terms", pa.binary()), ("counts", pa.binary())])


def _runs(batches: Iterator[pa.RecordBatch], route: dict[str, tuple[list[bytes], list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the terms of each group's texts, cut where blocks start. route: by language the blocks' first terms,
    numbers and salts."""
    held: dict[tuple[str, str], Counter] = defaultdict(Counter)
    turn = TaskContext.get().partitionId()

    def give() -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (lang, source), n in held.items():
            firsts, blocks, salts = route.get(lang, ([], [], []))
            if not firsts:
                continue
            terms = sorted(n)
            cuts = [bisect_left(terms, f) for f in firsts] + [len(terms)]
            for block, salt, lo, hi in zip(blocks, salts, cuts, cuts[1:]):
                for x in range(lo, hi, 8192):
                    some = terms[x : min(x + 8192, hi)]
                    rows.append((lang, block, turn % salt, source, b" ".join(some), np.array([n[t] for t in some], np.int64).tobytes()))
            if len(rows) >= 256:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUN)], schema=_RUN)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUN)], schema=_RUN)
        held.clear()

    for b in batches:
        langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, text in enumerate(column_bytes(b.column(2))):
            held[langs[i], sources[i]].update(terms_of(text))
            if i % 256 == 255 and sum(map(len, held.values())) > _HELD:
                yield from give()
                turn += 1
    yield from give()


def _recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each transducer comes before its runs, the runs of one source together; gives what each source has of each place. Runs
    beside each other walk together."""
    machine, at, total = None, None, None

    def give() -> Iterator[pa.RecordBatch]:
        if at is not None:
            place = np.flatnonzero(total)
            lang, block, source = at
            yield pa.record_batch([pa.array([lang] * len(place), pa.string()), pa.array([source] * len(place), pa.string()), pa.array(np.full(len(place), block)), pa.array(place.astype(np.int32)), pa.array(total[place])], names=["lang", "source", "block", "place", "n"])

    for b in batches:
        langs, blocks, sources, terms, counts = (b.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
        i = 0
        while i < len(langs):
            if counts[i] is None:
                yield from give()
                machine, at, i = Transducer.loads(terms[i]), None, i + 1
                continue
            j, size = i, 0
            while j < len(langs) and counts[j] is not None and size < 4 << 20:
                size, j = size + len(terms[j]), j + 1
            place, n = machine.ordinals(b" ".join(terms[i:j])), np.frombuffer(b"".join(counts[i:j]), np.int64)
            lo = 0
            while i < j:
                hi, here = lo, (langs[i], blocks[i], sources[i])
                while i < j and here == (langs[i], blocks[i], sources[i]):
                    hi, i = hi + len(counts[i]) // 8, i + 1
                if at != here:
                    yield from give()
                    at, total = here, np.zeros(machine.size, np.int64)
                known = np.flatnonzero(place[lo:hi] >= 0) + lo
                np.add.at(total, place[known], n[known])
                lo = hi
    yield from give()


def _slab(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over one slab of terms for each ordered pair of sources. left: source, at, p; right: one row with all sources,
    the probability of a term that they lack, and the number of terms."""
    sources, lack, width = right.column("sources")[0].as_py(), np.array(right.column("lack")[0].as_py(), np.int64), right.column("width")[0].as_py()
    place = {s: i for i, s in enumerate(sources)}
    p = np.repeat(lack[:, None], width, axis=1)
    p[[place[s] for s in left.column("source").to_pylist()], left.column("at").to_numpy()] = left.column("p").to_numpy()
    value = np.empty((len(sources), len(sources)), np.int64)
    for i, own in enumerate(p):
        apart = own - p
        value[i] = (apart * apart // p).sum(axis=1)
    one, two = np.nonzero(~np.eye(len(sources), dtype=bool))
    lang = right.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "i": pa.array(one.astype(np.int32)), "j": pa.array(two.astype(np.int32)), "value": pa.array(value[one, two])})


def _probability(n: F.Column, total: F.Column, size: F.Column) -> F.Column:
    """1 + floor(SCALE * (n + 1) / (total + size)), in decimals: the product leaves 64 bits at 9,223,372,036 occurrences."""
    return F.lit(1) + F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + size).cast("decimal(31,0)"))


def divergence(docs: DataFrame, least: int = 3, top: int = 200, block: int = 65536) -> DataFrame:
    """lang, source, part, item, value and rank: sources of a language apart from each other and from the whole."""
    spark = docs.sparkSession
    p = shuffle_partitions(spark)
    lang, source, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))
    found = docs.select(lang, text).mapInArrow(_frequencies, "lang string, term binary, docs long")
    kept = materialize(found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least), "audit-kept")
    in_order = kept.repartitionByRange(p, "lang", "term").sortWithinPartitions("lang", "term").select("lang", "term", "docs")
    types = "lang string, block long, place int, term binary, n long, docs long, machine binary"
    words = materialize(in_order.mapInArrow(lambda it: _vocabulary(it, block), types), "audit-vocabulary")

    before = Window.partitionBy("lang").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    salts = F.least(F.lit(p), 1 + F.floor(F.col("docs") / (1 << 20))).cast("int").alias("salts")
    blocks = words.where("machine is not null").select("lang", "block", "term", "n", salts, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    blocks = materialize(blocks, "audit-blocks")
    route: dict[str, tuple[list, list, list]] = {}
    for r in blocks.select("lang", "block", "term", "salts").orderBy("lang", "block").collect():  # one row for up to 65,536 terms
        for column, x in zip(route.setdefault(r.lang, ([], [], [])), (bytes(r.term), r.block, r.salts)):
            column.append(x)

    runs = docs.select(lang, source, text).mapInArrow(lambda it: _runs(it, route), _RUNS)
    salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    machines = words.where("machine is not null").join(blocks.select("lang", "block", "salts"), ["lang", "block"])
    machines = machines.select("lang", "block", salt, F.lit(None).cast("string").alias("source"), F.col("machine").alias("terms"), F.lit(None).cast("binary").alias("counts"))
    stream = machines.union(runs).repartition("lang", "block", "salt").sortWithinPartitions("lang", "block", "salt", F.col("counts").isNotNull(), "source")
    places = stream.mapInArrow(_recount, "lang string, source string, block long, place int, n long")
    counts = places.groupBy("lang", "source", "block", "place").agg(F.sum("n").alias("n")).join(blocks.select("lang", "block", "base"), ["lang", "block"])
    counts = materialize(counts.select("lang", "source", (F.col("base") + F.col("place")).alias("ordinal"), "n"), "audit-counts")

    size = blocks.groupBy("lang").agg(F.sum("n").alias("size"))
    groups = docs.select(lang, source).distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(size, "lang", "left")
    numbered = Window.partitionBy("lang").orderBy("source")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("size", F.lit(0)).alias("size"), (F.row_number().over(numbered) - 1).alias("i"))
    groups = materialize(groups, "audit-groups")
    whole = groups.groupBy("lang").agg(F.sum("total").alias("whole"), F.count(F.lit(1)).alias("sources"))
    width = F.least(F.lit(1024), F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("sources")))).cast("long")

    seen = counts.withColumn("all", F.sum("n").over(Window.partitionBy("lang", "ordinal"))).join(groups.drop("i"), ["lang", "source"]).join(whole, "lang")
    seen = seen.select("lang", "source", "ordinal", _probability(F.col("n"), F.col("total"), F.col("size")).alias("p"), _probability(F.col("all"), F.col("whole"), F.col("size")).alias("q"), width.alias("width"))
    seen = materialize(seen, "audit-seen")

    gap = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    term = seen.where("p > q").select("lang", "source", "ordinal", gap.alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    spelled = words.where("machine is null").join(blocks.select("lang", "block", "base"), ["lang", "block"]).select("lang", (F.col("base") + F.col("place")).alias("ordinal"), F.col("term").cast("string").alias("item"))
    term = term.join(spelled, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    slab = F.floor(F.col("ordinal") / F.col("width"))
    left = seen.select("lang", slab.alias("slab"), "source", (F.col("ordinal") % F.col("width")).alias("at"), "p")
    lack = _probability(F.lit(0).cast("long"), F.col("total"), F.col("size"))
    right = groups.where("size > 0").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", lack.alias("lack")))).alias("g"), F.first("size").alias("size"), F.count(F.lit(1)).alias("sources"))
    right = right.withColumn("w", width).withColumn("slab", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / F.col("w")))))
    right = right.select("lang", "slab", F.col("g.source").alias("sources"), F.col("g.lack").alias("lack"), F.least("w", F.col("size") - F.col("slab") * F.col("w")).alias("width"))
    sums = left.groupBy("lang", "slab").cogroup(right.groupBy("lang", "slab")).applyInArrow(_slab, "lang string, i int, j int, value long")
    sums = sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source", "i").join(groups.select("lang", F.col("source").alias("item"), F.col("i").alias("j")), "lang").where("i <> j").join(sums, ["lang", "i", "j"], "left")
    near = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "j")
    pair = pairs.withColumn("value", F.coalesce("value", F.lit(0))).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(near).alias("rank"))
    return pair.union(term)


def op12_source_audit(docs: DataFrame) -> DataFrame:
    return divergence(docs)
