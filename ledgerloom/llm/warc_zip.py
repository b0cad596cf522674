"""WARC records in ZIP packages: a writer, and a reader that takes records by range.

A package is a ZIP file with two stored members: ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdx`` (offset and length of each). The reader parses the end record and the central directory (with
their ZIP64 forms), finds where the stored members' bytes are, reads the index and then each record's range; nothing
is extracted. Executors read and write by a URI that pyarrow's file systems open, in the shared folder.

Of records with equal payloads the one with the largest page_id is a response and the others revisit it; rows that
tie at the largest are all responses. Defined results: null html is an empty payload, a null url gives a record
without a target, a null page_id sorts below all others and is read back as null; repeated rows give a record each; a
very long page is one record; an empty table gives no packages and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, shuffle_partitions

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"


class _Counted:
    """An output stream that zipfile takes for one it can't seek."""

    def __init__(self, raw):
        self.raw, self.at = raw, 0

    def write(self, data) -> int:
        self.raw.write(data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        self.raw.flush()


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = http + (payload if refers_to is None else b"")
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    number = lambda x: int(x[10:-1]) if x and x[10:-1] else None  # noqa: E731  <urn:page:N>
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "url": fields.get("WARC-Target-URI"), "payload": payload}


def _write(batches: Iterator[pa.RecordBatch], folder: str, limit: int, zip64: bool) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for lo in range(0, len(b), 200):
                yield from b.slice(lo, 200).to_pylist()

    todo = rows()
    row = next(todo, None)
    while row is not None:
        path = f"{folder}/{uuid.uuid4().hex}.zip"  # a repeated task writes other packages; only those reported are read
        where, name = fs.FileSystem.from_uri(path)
        index, at = [], 0
        with where.open_output_stream(name) as raw, zipfile.ZipFile(_Counted(raw), "w", zipfile.ZIP_STORED) as package:
            with package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=zip64) as member:
                while row is not None and at < limit:
                    payload = row["payload"]
                    digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                    data = gzip.compress(_record(row["page_id"], row["url"], payload, digest, row["refers_to"]), 6, mtime=0)
                    member.write(data)
                    index.append((at, len(data)))
                    at += len(data)
                    row = next(todo, None)
            package.writestr(zipfile.ZipInfo(INDEX), "".join(f"{o} {n}\n" for o, n in index))
        yield pa.record_batch([[path], [len(index)]], names=["path", "records"])


def write_packages(records: DataFrame, folder: str, limit: int = 16 << 20, zip64: bool = True) -> DataFrame:
    """Write page_id, url, payload, sha1, refers_to as packages of about ``limit`` bytes; gives path and records of each."""
    spark = records.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return materialize(records.mapInArrow(lambda it: _write(it, folder, limit, zip64), "path string, records long"), "packages")


def directory(f, size: int) -> dict[str, tuple[int, int]]:
    """Where the bytes of each stored member are: name -> (offset, length). f: an open random-access file."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = tail_at + end - 20
    if locator >= 0 and (found := at(locator, 20))[:4] == b"PK\x06\x07":
        end64 = at(struct.unpack("<Q", found[8:16])[0], 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        entries, length, offset = struct.unpack("<QQQ", end64[32:56])
    central, members, i = at(offset, length), {}, 0
    for _ in range(entries):
        method, packed, full, name_n, extra_n, note_n, local = struct.unpack("<10xH8xIIHHH8xI", central[i : i + 46])
        name = central[i + 46 : i + 46 + name_n].decode()
        extra = central[i + 46 + name_n : i + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # 64-bit values stand, in order, for those at their limit
                wide = [x[0] for x in struct.iter_unpack("<Q", extra[4 : 4 + n - n % 8])]
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        if method == 0:
            name_m, extra_m = struct.unpack("<26xHH", at(local, 30))
            members[name] = (local + 30 + name_m + extra_m, packed)
        i += 46 + name_n + extra_n + note_n
    return members


def _read(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload
    for b in batches:
        for path in b.column(0).to_pylist():
            where, name = fs.FileSystem.from_uri(path)
            with where.open_input_file(name) as f:
                members = directory(f, f.size())
                start, length = members[INDEX]
                f.seek(start)
                entries = [tuple(map(int, line.split())) for line in f.read(length).splitlines()]
                start = members[ARCHIVE][0]
                for lo in range(0, len(entries), 200):
                    rows = []
                    for offset, n in entries[lo : lo + 200]:
                        f.seek(start + offset)
                        rows.append(parse_record(gzip.decompress(f.read(n))))
                    yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in zip(names, types)], names=names)


def read_packages(packages: DataFrame, payload: bool = False, tasks: int | None = None) -> DataFrame:
    """The records of the packages at ``path``, read by ``tasks`` tasks (a number keeps few bytes of paths from one task)."""
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    return packages.select("path").repartition(tasks or shuffle_partitions(packages.sparkSession), "path").mapInArrow(lambda it: _read(it, payload), fields)


def mark_revisits(pages: DataFrame, least: int = 0, salts: int = 16) -> DataFrame:
    """page_id, url, payload, sha1 and, for those that repeat a payload of at least ``least`` bytes, refers_to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    repeated = rows.where(F.length("payload") >= least).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    spread = repeated.select(F.col("sha1").alias("of"), "last", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("of_salt"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")
    rows = rows.withColumn("salt", salt).join(spread, (F.col("sha1") == F.col("of")) & (F.col("salt") == F.col("of_salt")), "left")
    return rows.select("page_id", "url", "payload", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def op6_warc_zip(pages: DataFrame) -> DataFrame:
    packages = write_packages(mark_revisits(pages), shared_dir(pages.sparkSession, "warc"))
    return read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
