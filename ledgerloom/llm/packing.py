"""Packing documents into fixed-length sequences by cutting-stock column generation.

1. Every document is tokenised once, ends with the end id, and is cut into full pieces of ``capacity`` ids and one rest.
   Pieces go to a table in the shared folder.
2. The histogram of piece lengths (at most ``capacity`` numbers, whatever the corpus holds) is the demand of a
   cutting-stock linear program. Columns are patterns, multisets of lengths that fit one sequence. The first basis comes
   from knapsacks at volume prices, each of which uses up one length; a knapsack dynamic program over smoothed dual
   values prices further columns, and a revised simplex takes them in, until the gap to the dual bound is at most
   ``gap`` (or a hundredth of a sequence for each length), no pattern is worth more than one sequence, or ``patience``
   rounds in a row save nothing.
3. Patterns that fill a sequence are rounded down to whole numbers; what rounding leaves (at most one sequence a basis
   column) is dealt by further knapsack patterns that fill a sequence exactly. Pieces of each length are ranked over the
   cluster (a rank within each of several parts plus the parts' offsets, so that a length that a third of the documents
   share is spread), and ranks are dealt to patterns by a table of ranges of at most a few thousand rows.
4. The pieces that no exact pattern takes (at most a few a length) are laid end to end by rank and cut where a
   sequence ends; what remains of the last one goes to sequences whose length is a power of two, which need no padding.
   So nothing is padded, and very few pieces are cut: ``plan`` gives the numbers dealt.

Defined results: a null or empty text is the end id alone; repeated rows are packed each by itself; a very long text
is many full pieces and a rest; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shuffle_partitions

_CACHED: dict[str, tuple] = {}


#: Fixed value: the pre-token pattern of byte-level tokenizers that name none of their own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NO_TOKEN = "<|no token of the vocabulary|>"


def _tokenizer(path: str, pattern: str | None) -> tuple:
    if path not in _CACHED:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)

        def whole(text: str) -> bytes:
            return np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

        added = [x.content for x in t.get_added_tokens_decoder().values()]
        _CACHED[path] = (_ranked(t, pattern) or whole, whole, added)
    return _CACHED[path]


def _ranked(t, pattern: str | None) -> Callable[[str], bytes] | None:
    """A faster encoder for a byte-level BPE that merges in the order of its ids and cuts by ``pattern``; else None."""
    import json

    import tiktoken

    spec = json.loads(t.to_str())
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and pattern == BYTE_LEVEL and not spec.get("normalizer")
    if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {x.content for x in t.get_added_tokens_decoder().values()}
    vocabulary = {w: i for w, i in model["vocab"].items() if w not in added}
    made = [vocabulary["".join(m if not isinstance(m, str) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made) or any(c not in byte_of for w in vocabulary for c in w):
        return None
    ranks = {bytes(byte_of[c] for c in w): i for w, i in vocabulary.items()}
    merge = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={_NO_TOKEN: 1 << 30})
    return lambda text: merge.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def tokenize(text: str | None, path: str, pattern: str | None = None) -> bytes:
    """Ids of ``text`` as the tokenizer gives them, little-endian unsigned 32-bit. pattern: its pre-tokens, if known."""
    fast, whole, added = _tokenizer(path, pattern)
    if not text:
        return b""
    if any(x in text for x in added):
        return whole(text)
    try:
        return fast(text)
    except ValueError:  # the faster one's pattern matcher gives up on white space of a million characters
        return whole(text)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, pattern: str | None, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lo in range(0, len(ids), 1000):
            rows: list[tuple] = []
            for doc, text in zip(ids[lo : lo + 1000], texts[lo : lo + 1000]):
                raw = tokenize(text, path, pattern) + end
                total = len(raw) // 4
                for at in range(0, len(raw), step):
                    part = raw[at : at + step]
                    rows.append((doc, at // 4, len(part) // 4, zlib.crc32(part), total, part if len(part) < step else None))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.binary()])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])


def fill(number: dict[int, int], capacity: int) -> list[int]:
    """Knapsack at volume prices: lengths, each at most ``number`` times, of the greatest sum that fits. Longer ones come first."""
    reach, took, room, copy = 1, {}, (2 << capacity) - 1, 0  # bit c: a sum of c can be made
    while not reach >> capacity & 1:
        copy, had = copy + 1, reach
        for x in sorted((x for x, n in number.items() if n >= copy), reverse=True):  # one more of each
            new = (reach << x) & room & ~reach
            reach |= new
            while new:
                low = new & -new
                took[low.bit_length() - 1] = x
                new ^= low
            if reach >> capacity & 1:
                break
        if reach == had:
            break
    c, out = reach.bit_length() - 1, []
    while c:
        out.append(took[c])
        c -= took[c]
    return out


def best_values(size: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack over ascending sizes: the greatest value of every capacity and the size taken last (-1: none)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            v = best[c - size[:n]] + worth[:n]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], took[c] = v[i], i
    return best, took


def _pattern(took: np.ndarray, size: np.ndarray, capacity: int, first: int) -> dict[int, int]:
    """The best pattern that holds size ``first``: index -> number."""
    counts = Counter([first])
    c = capacity - int(size[first])
    while c > 0:
        if took[c] < 0:
            c -= 1
            continue
        counts[int(took[c])] += 1
        c -= int(size[took[c]])
    return dict(counts)


def _first_basis(size: np.ndarray, need: np.ndarray, capacity: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """Patterns, each of which uses up one length that no later pattern holds: a triangular basis."""
    left, at = need.copy(), {int(x): i for i, x in enumerate(size)}
    patterns: list[dict[int, int]] = [{} for _ in size]
    use, there = np.zeros(len(size)), dict.fromkeys(map(int, size[::-1]), capacity)
    while there:
        longest = next(iter(there))
        counts = Counter(at[x] for x in [longest, *fill(there, capacity - longest)])
        times, i = min((left[i] / n, i) for i, n in counts.items())
        for j, n in counts.items():
            left[j] -= n * times
        del there[int(size[i])]
        patterns[i], use[i] = dict(counts), times
    return patterns, use


def cutting_stock(demand: dict[int, int], capacity: int, gap: float = 1e-3, patience: int = 60, columns: int = 40) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Patterns (length -> number) of the linear program's solution with how often each is used, and the proven gap."""
    size = np.array(sorted(demand), dtype=np.int64)
    if not len(size):
        return [], 0.0
    need = np.array([demand[int(x)] for x in size], dtype=np.float64)
    patterns, use = _first_basis(size, need, capacity)
    centre = size / capacity  # feasible dual values of the best bound so far
    bound, smooth, idle, inverse = float(centre @ need), 0.7, 0, None
    while use.sum() - bound > max(gap * bound, 0.01 * len(size)) and idle < patience:  # rounding costs up to 1 a length
        if inverse is None:
            basis = np.zeros((len(size), len(size)))
            for j, p in enumerate(patterns):
                basis[list(p), j] = list(p.values())
            inverse = np.linalg.inv(basis)
        dual, before = inverse.sum(axis=0), use.sum()
        worth = np.maximum(smooth * centre + (1 - smooth) * dual, 0)
        best, took = best_values(size, worth, capacity)
        scale = max(best[capacity], 1.0)  # worth / scale is feasible, so need @ worth / scale bounds any solution from below
        if need @ worth / scale > bound:
            bound, centre = float(need @ worth / scale), worth / scale
        rich = np.argsort(-(worth + best[capacity - size]))[:columns]
        found = list({tuple(sorted(p.items())): p for p in (_pattern(took, size, capacity, int(i)) for i in rich)}.values())
        table = np.zeros((len(found), len(size)))
        for j, p in enumerate(found):
            table[j, list(p)] = list(p.values())
        entered = 0
        while True:
            value = table @ dual
            j = int(value.argmax())
            if value[j] <= 1 + 1e-6:
                break
            column = inverse @ table[j]
            ratio = np.where(column > 1e-9, np.maximum(use, 0) / np.where(column > 1e-9, column, 1), np.inf)
            out = int(ratio.argmin())
            pivot, hit = inverse[out] / column[out], np.flatnonzero(np.abs(column) > 1e-12)
            inverse[hit] -= np.outer(column[hit], pivot)
            inverse[out] = pivot
            amount = ratio[out]
            use = use - amount * column
            use[out], patterns[out] = amount, found[j]
            table[j] = 0
            entered += 1
            dual = inverse.sum(axis=0)
        idle = 0 if use.sum() < before - 1e-4 * before * gap else idle + 1
        if not entered:
            if smooth == 0:
                break  # no pattern is worth more than one sequence
            smooth = smooth / 2 if smooth > 0.05 else 0.0
    solution = [({int(size[i]): n for i, n in p.items()}, float(x)) for p, x in zip(patterns, use) if x > 1e-9]
    return solution, float(use.sum() / bound - 1)


def plan(demand: dict[int, int], capacity: int) -> tuple[list[tuple], dict[int, int], int]:
    """Ranges (length, low, high, times, first sequence, offset, step) of ranks, ranks dealt by length, sequences used."""
    left, ranges, sequence = dict(demand), [], 0

    def deal(pattern: dict[int, int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length, n in sorted(pattern.items()):
            low = demand[length] - left[length]
            ranges.append((length, low, low + n * times, times, sequence, offset, length))
            left[length] -= n * times
            offset += n * length
        sequence += times

    exact = lambda pattern: sum(n * length for length, n in pattern.items()) == capacity
    for pattern, used in sorted(cutting_stock(demand, capacity)[0], key=lambda x: -x[1]):
        times = min([int(used + 1e-6), *(left[length] // n for length, n in pattern.items())])
        if times and exact(pattern):
            deal(pattern, times)
    there = {x: left[x] for x in sorted(left, reverse=True) if left[x]}  # what rounding leaves
    while there:
        longest = next(iter(there))
        there[longest] -= 1
        counts = Counter([longest, *fill(there, capacity - longest)])
        if exact(counts):
            deal(counts, min(left[length] // n for length, n in counts.items()))
            there = {x: left[x] for x in there if left[x]}
        else:
            del there[longest]  # no exact pattern holds it any more
    return ranges, {x: demand[x] - left[x] for x in demand}, sequence


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checksums of parts of rests: part_from and part_length count ids."""
    for b in batches:
        crc = [zlib.crc32(ids[4 * f : 4 * (f + n)]) for ids, f, n in zip(b.column("ids").to_pylist(), b.column("part_from").to_pylist(), b.column("length").to_pylist())]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
        yield pa.record_batch([b.column(n) for n in names] + [pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])


OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str | None = None, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(texts.mapInArrow(lambda it: _pieces(it, tokenizer, pattern, capacity, end_id), PIECES), "pieces")
    parts = min(1024, 4 * shuffle_partitions(spark))
    slim = pieces.drop("ids").withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    counts = slim.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "piece-counts")
    demand = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    ranges, dealt, sequences = plan(demand, capacity)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = slim.withColumn("r", F.row_number().over(within) - 1).join(offsets, ["length", "part"]).withColumn("rank", F.col("r") + F.col("base"))

    table = spark.createDataFrame([*ranges] or [(0,) * 7], "of long, low long, high long, times long, first long, at long, step long")
    hit = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.join(F.broadcast(table), hit, "left").withColumn("t", F.col("rank") - F.col("low"))
    whole = placed.where("of is not null").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("t") % F.col("times")).alias("sequence_id"),
        (F.col("at") + F.floor(F.col("t") / F.col("times")) * F.col("step")).cast("long").alias("offset"),
    )

    base, rows = 0, []
    for length in sorted(demand, reverse=True):
        if demand[length] > dealt[length]:
            rows.append((length, base - dealt[length] * length))
            base += (demand[length] - dealt[length]) * length
    full = base // capacity
    tail, edge = [], full * capacity
    for bit in reversed(range(capacity.bit_length())):
        if (base - full * capacity) >> bit & 1:
            tail.append((edge, 1 << bit))
            edge += 1 << bit
    stream = spark.createDataFrame(rows or [(0, 0)], "of_length long, shift long")
    rest = placed.where("of is null").join(F.broadcast(stream), F.col("length") == F.col("of_length")).withColumn("o", F.col("shift") + F.col("rank") * F.col("length"))
    end = F.col("o") + F.col("length")
    inside = F.when(F.floor(F.col("o") / capacity) < F.floor((end - 1) / capacity), F.array((F.floor((end - 1) / capacity) * capacity).cast("long"))).otherwise(F.array().cast("array<long>"))
    marks = F.array(*[F.lit(x).cast("long") for x, _ in tail]).cast("array<long>")
    edges = F.array_sort(F.array_distinct(F.concat(F.array("o", end), inside, F.filter(marks, lambda x: (x > F.col("o")) & (x < end)))))
    starts = F.array(*[F.lit(x).cast("long") for x, _ in tail]).cast("array<long>")
    spread = (
        rest.withColumn("edges", edges)
        .select("*", F.posexplode(F.slice("edges", F.lit(1), F.size("edges") - 1)).alias("i", "lo"))
        .withColumn("hi", F.element_at("edges", F.col("i") + 2))
        .withColumn("tails", F.size(F.filter(starts, lambda x: x <= F.col("lo"))))
        .select(
            "doc_id", F.col("start").alias("piece_start"), F.col("ids_crc32").alias("piece_crc"), F.col("length").alias("piece_length"), "doc_tokens",
            (F.col("start") + F.col("lo") - F.col("o")).alias("start"), (F.col("lo") - F.col("o")).alias("part_from"), (F.col("hi") - F.col("lo")).alias("length"),
            F.when(F.col("lo") < full * capacity, sequences + F.floor(F.col("lo") / capacity)).otherwise(sequences + full + F.col("tails") - 1).cast("long").alias("sequence_id"),
            F.when(F.col("lo") < full * capacity, F.col("lo") % capacity).otherwise(F.col("lo") - F.try_element_at(starts, F.greatest(F.col("tails"), F.lit(1)))).cast("long").alias("offset"),
        )
    )
    spread = materialize(spread, "stream")
    uncut = spread.where("length = piece_length").withColumn("ids_crc32", F.col("piece_crc"))
    cut = spread.where("length < piece_length")
    key = ["doc_id", "start", "ids_crc32"]
    wanted = cut.select(F.col("doc_id").alias("w_doc"), F.col("piece_start").alias("w_start"), F.col("piece_crc").alias("w_crc")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("start") == F.col("w_start")) & (F.col("ids_crc32") == F.col("w_crc"))
    ids = pieces.join(wanted, same, "left_semi").groupBy(*key).agg(F.first("ids").alias("ids")).select(F.col("doc_id").alias("w_doc"), F.col("start").alias("w_start"), F.col("ids_crc32").alias("w_crc"), "ids")
    same = F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("piece_start") == F.col("w_start")) & (F.col("piece_crc") == F.col("w_crc"))
    cut = cut.join(ids, same).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "part_from", "ids")
    cut = cut.mapInArrow(_cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long")
    return whole.select(*OUT).unionByName(uncut.select(*OUT)).unionByName(cut.select(*OUT))


def op7_packing(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
