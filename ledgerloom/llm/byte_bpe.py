"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text of more than ``chunk`` characters is cut into chunks that overlap; the chunks are pre-tokenised in parallel.
A chunk's first pre-tokens may be wrong, since it starts anywhere, but the pattern looks only forward: at the first
boundary inside the overlap on which both chunks agree the later chunk is in step, and the cut goes there. The pieces
between cuts are then encoded in parallel and their ids joined in order. Where no boundary agrees within the overlap
(one very long pre-token), the rest of that text stays one piece. A shorter text is one chunk.

Pre-tokens that a single space between two non-space characters begins never depend on what is before it, so ids are
kept by space-delimited unit and by pre-token, and each distinct one is split and merged once per worker.

Defined results: a null text is empty (no ids); repeated rows give repeated results; an empty table gives an empty result;
other columns are dropped but for those named in ``keep``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

_UNSAFE = re.compile(r"\s | \s|^ | $")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_CACHED: dict = {}


class UnitCache(dict):
    """Ids (little-endian unsigned 32-bit) of ``" " + unit``; a new unit is split by ``pattern`` and joined from the
    ids of its pre-tokens, of which there are fewer. Both are emptied when they are full."""

    def __init__(self, encode: Callable[[str], bytes], pattern: str | None = None, limit: int = 250_000):
        import regex

        super().__init__()
        self.encode, self.limit, self.pieces = encode, limit, {}
        self.split = regex.compile(pattern).findall if pattern else lambda unit: [unit]

    def unit(self, unit: str) -> bytes:
        known, out = self.pieces, []
        for piece in self.split(unit):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= self.limit:
                    known.clear()
                ids = known[piece] = self.encode(piece)
            out.append(ids)
        return b"".join(out)

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self[unit] = self.unit(" " + unit)
        return ids

    def text(self, text: str) -> bytes:
        if not text:
            return b""
        units = (_SAFE.split if _UNSAFE.search(text) else lambda t: t.split(" "))(text)
        return self.unit(units[0]) + b"".join(map(self.__getitem__, units[1:]))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _encoder(path: str, pattern: str) -> UnitCache:
    if ("ranks", path) not in _CACHED:
        import tiktoken

        merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
        # a pre-token is merged by itself: the library's own pattern matcher gives up on white space of a million characters
        _CACHED["ranks", path] = UnitCache(lambda t: np.array(merge._encode_single_piece(t), dtype="<u4").tobytes(), pattern)
    return _CACHED["ranks", path]


def _tokens(path: str) -> tuple[list[bytes], int]:
    if ("tokens", path) not in _CACHED:
        ranks = load_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _CACHED["tokens", path] = table
    return _CACHED["tokens", path]


def _map_column(make: Callable[[], Callable], source: str, target: str, schema: StructType) -> Callable:
    """A mapInArrow function that adds binary column ``target`` from ``source`` and drops ``source``."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            at = b.schema.get_field_index(source)
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                new = pa.array([f(x) for x in part.column(at).to_pylist()], pa.binary())
                yield pa.record_batch([new if n == target else part.column(b.schema.get_field_index(n)) for n in arrow.names], schema=arrow)

    return run


def _with(df: DataFrame, source: str, target: str) -> StructType:
    return StructType([f for f in df.schema if f.name != source] + [StructField(target, BinaryType())])


def _starts(pattern: str, text: str) -> list[int]:
    import regex

    return [m.start() for m in regex.finditer(pattern, text)]


def _cuts(chunks: list[tuple[int, list[int]]], overlap: int) -> list[int]:
    """Positions at which pieces start. chunks: position and sure boundaries of each, in order."""
    cuts = [0]
    true = set(chunks[0][1])
    for at, found in chunks[1:]:
        meet = next((x for x in found if x in true), None)
        if meet is None:
            break
        cuts.append(meet)
        true = {x for x in found if x >= meet}
    return cuts


def _boundaries(pattern: str, chunk: int, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at, text, last in zip(b.column("at").to_pylist(), b.column("part").to_pylist(), b.column("last").to_pylist()):
                found = _starts(pattern, text)
                sure = found if last else found[:-2]  # the end of a cut text may change its last pre-tokens
                near = [at + x for x in sure if x < overlap or x >= chunk]
                out.append(np.array(near, dtype=np.int64).tobytes())
            yield pa.record_batch([b.column("doc"), b.column("key"), b.column("at"), pa.array(out, pa.binary())], names=["doc", "key", "at", "found"])

    return run


def _stitch(overlap: int) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        rows = dict(zip(t.column("at").to_pylist(), t.column("found").to_pylist()))  # equal rows fall together
        cuts = _cuts([(at, np.frombuffer(rows[at], np.int64).tolist()) for at in sorted(rows)], overlap)
        return pa.table({"doc": t.column("doc").slice(0, 1), "key": t.column("key").slice(0, 1), "cuts": pa.array([cuts], pa.list_(pa.int64()))})

    return run


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), chunk: int = 65_536, overlap: int = 1_024) -> DataFrame:
    """``id_col``, the columns in ``keep`` and ``ids``, the token ids as little-endian unsigned 32-bit integers."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(id_col, *keep, text.alias("__text"))
    short = docs.where(F.length("__text") <= chunk)
    schema = _with(short, "__text", "ids")
    short = short.mapInArrow(_map_column(lambda: _encoder(ranks, pattern).text, "__text", "ids", schema), schema)

    long = docs.where(F.length("__text") > chunk).withColumns({"__doc": F.col(id_col).cast("string"), "__key": F.xxhash64("__text")})
    at = F.explode(F.sequence(F.lit(0), F.length("__text") - 1, F.lit(chunk))).alias("at")
    parts = (
        long.select(F.col("__doc").alias("doc"), F.col("__key").alias("key"), at, "__text")
        .select("doc", "key", F.col("at").cast("long"), F.col("__text").substr(F.col("at") + 1, F.lit(chunk + overlap)).alias("part"), (F.col("at") + chunk + overlap >= F.length("__text")).alias("last"))
        .repartition("doc", "key", "at")
    )
    cuts = (
        parts.mapInArrow(_boundaries(pattern, chunk, overlap), "doc string, key long, at long, found binary")
        .groupBy("doc", "key").applyInArrow(_stitch(overlap), "doc string, key long, cuts array<long>")
    )
    end = F.coalesce(F.try_element_at("cuts", F.col("p") + 2), F.length("__text").cast("long"))
    pieces = (
        long.join(cuts, F.col("__doc").eqNullSafe(F.col("doc")) & (F.col("__key") == F.col("key")))
        .select("doc", "key", "__text", "cuts", F.posexplode("cuts").alias("p", "from"))
        .select("doc", "key", "p", F.col("__text").substr((F.col("from") + 1).cast("int"), (end - F.col("from")).cast("int")).alias("piece"))
        .repartition("doc", "key", "p")
    )
    schema = _with(pieces, "piece", "part_ids")
    ids = (
        pieces.mapInArrow(_map_column(lambda: _encoder(ranks, pattern).text, "piece", "part_ids", schema), schema)
        .groupBy("doc", "key", "p").agg(F.first("part_ids").alias("part_ids"))
        .groupBy("doc", "key").agg(F.sort_array(F.collect_list(F.struct("p", "part_ids"))).alias("parts"))
        .select("doc", "key", F.concat(F.array_join(F.transform("parts", lambda x: F.hex(x["part_ids"])), "")).alias("all"))
        .select("doc", "key", F.unhex("all").alias("ids"))
    )
    long = long.drop("__text").join(ids, F.col("__doc").eqNullSafe(F.col("doc")) & (F.col("__key") == F.col("key"))).select(id_col, *keep, "ids")
    return short.unionByName(long)


def decode_documents(encoded: DataFrame, ranks: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the concatenated bytes of the ids, beside ``ids_col``."""
    source = encoded.drop("decoded").withColumn("__ids", F.col(ids_col))

    def make() -> Callable[[bytes], bytes]:
        table = _tokens(ranks)
        return lambda x: b"".join(map(table.__getitem__, np.frombuffer(x or b"", dtype="<u4").tolist()))

    schema = _with(source, "__ids", "decoded")
    return source.mapInArrow(_map_column(make, "__ids", "decoded", schema), schema)


def op9_byte_bpe(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = decode_documents(encode_documents(docs, path, public_tokenizers.PATTERN), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
