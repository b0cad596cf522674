"""Shared helpers: the cluster's shared folder, materialised tables and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NO_ID = np.int64(2**63 - 1)
SLOT_BITS = 24


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; where that is unset, a temporary folder of a local session. On a cluster
    it must be set: executors can't share a folder of the driver's machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _FALLBACK.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and every executor sees the files."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote; nothing may read these tables, or what was derived from them lazily, again."""
    for df in tables:
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Meanwhile a query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def slotted(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Those of ``rows`` whose 64-bit hash ``key`` shares its last ``SLOT_BITS`` bits with one of ``wanted`` (one column), and
    no others but by such chance. One bit a slot is broadcast, 2 MB in all, whatever the input."""
    slot = lambda c: F.col(c).bitwiseAND((1 << SLOT_BITS) - 1)
    part = lambda c: F.shiftright(slot(c), 15).alias("__part")
    bits = wanted.groupBy(part(wanted.columns[0])).agg(F.bitmap_construct_agg(slot(wanted.columns[0]).bitwiseAND(32767)).alias("__bits"))
    byte = F.substring("__bits", F.shiftright(slot(key).bitwiseAND(32767), 3).cast("int") + 1, F.lit(1))
    held = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), slot(key).bitwiseAND(7).cast("int")) == 1
    return rows.join(F.broadcast(bits), part(key) == F.col("__part")).where(held).select(*rows.columns)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slices(texts: list[bytes], limit: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about ``limit`` bytes each; a longer text forms a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a text column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POW or len(_POW["up"]) < n:
        size = max(n, 1 << 18)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POW[key] = np.cumprod(p, dtype=np.uint64)
    return _POW["up"][:n], _POW["down"][:n]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts: byte spans, owner and a 64-bit hash each."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, dtype=np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2].astype(np.int64), edge[1::2].astype(np.int64)
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
        self.owner = np.searchsorted(ends, self.start, side="right")
        self.first = np.searchsorted(self.owner, np.arange(len(texts)))
        self.count = np.bincount(self.owner, minlength=len(texts)) if len(texts) else np.zeros(0, dtype=np.int64)
        self.hash = np.empty(len(self.start), dtype=np.uint64)
        lo = 0
        while lo < len(self.start):  # in pieces that stay in the processor's cache
            hi = max(lo + 1, int(np.searchsorted(self.end, self.start[lo] + (1 << 17), side="right")))
            base = self.start[lo]
            s, e = self.start[lo:hi] - base, self.end[lo:hi] - base
            up, down = _powers(int(e[-1]))
            total = np.zeros(int(e[-1]) + 1, dtype=np.uint64)
            np.cumsum((raw[base : base + e[-1]].astype(np.uint64) + _U(1)) * up, dtype=np.uint64, out=total[1:])
            self.hash[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            lo = hi

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words from each word on; those that leave a text are meaningless."""
        m = max(0, len(self.hash) - n + 1)
        g = np.zeros(m, dtype=np.uint64)
        for j in range(n):
            g = g * _BASE + self.hash[j : j + m]
        return mix(g)

    def whole(self, n: int) -> np.ndarray:
        """Which word starts a run of ``n`` words of one text."""
        m = max(0, len(self.hash) - n + 1)
        return self.owner[:m] == self.owner[n - 1 : n - 1 + m] if m else np.zeros(0, dtype=bool)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, a
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
