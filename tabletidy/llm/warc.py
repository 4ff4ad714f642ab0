"""WARC (operator 8): a Python data source that writes and reads archives.

Writing: every task writes one ``.warc.gz`` file, a gzip member per record. Each member's
extra field holds the member's whole length, so a reader can pass over a record after its
headers; other gzip readers ignore the field. A task attempt writes a file name of its own
and the driver's commit names the good ones in a manifest of the job: files of lost or
repeated attempts are never read, and what earlier jobs wrote to the folder stays.

Reading: plans a partition per ``split_mb`` of each file (the manifest has record offsets;
a foreign file without them is one partition), takes predicates on record type and headers,
parses a record's headers first, and decodes the payload only of records that are asked for.
Archives live where pyarrow's file systems reach (``file://``, ``hdfs://``, ``s3://``, ...).
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringStartsWith,
    WriterCommitMessage,
)

from tabletidy.llm.common import reachable, shared_path, staged, table

#: One row per record; ``payload`` is null for records without one of their own.
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
MANIFEST = re.compile(r"_manifest(-[0-9a-f]{32})?\.json")  # one per job; older archives have one without an id
PART = re.compile(r"part-[0-9a-f]{32}\.warc\.gz")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # the tables hold no crawl time; a fixed date keeps archives repeatable
ROWS = 256


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean_uri(uri: str) -> str:
    """Control characters and spaces percent-encoded, so that a header stays one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def record(record_id: str, record_type: str, uri: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """One record; a revisit keeps the HTTP headers, with the length, and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {clean_uri(uri)}")
    if record_type == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field (subfield WL) holds its own length."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQ", 12, b"WL", 8, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    starts: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def write(self, iterator) -> Written:
        store, path = pa.fs.FileSystem.from_uri(self.path)
        store.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        at, starts = 0, [0]
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in iterator:
                for row in range(batch.num_rows):
                    r = {n: batch.column(n)[row].as_py() for n in ("record_id", "record_type", "target_uri", "refers_to", "payload")}
                    if at - starts[-1] >= self.split:
                        starts.append(at)
                    data = member(record(r["record_id"], r["record_type"], r["target_uri"], r["refers_to"], r["payload"] or b""))
                    out.write(data)
                    at += len(data)
        return Written(name, at, starts)

    def commit(self, messages) -> None:
        store, path = pa.fs.FileSystem.from_uri(self.path)
        store.create_dir(path, recursive=True)
        listed = [{"name": m.name, "size": m.size, "starts": m.starts} for m in messages if m is not None]
        name = f"_manifest-{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{path}/{name}.part", compression=None) as out:
            out.write(json.dumps(listed).encode())
        store.move(f"{path}/{name}.part", f"{path}/{name}")  # a reader sees the whole manifest or none

    def abort(self, messages) -> None:
        store, path = pa.fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{path}/{m.name}")


@dataclass
class Split(InputPartition):
    name: str
    start: int
    stop: int


class Member:
    """One record of an open file: its headers now, its block only if asked."""

    def __init__(self, f, at: int):
        f.seek(at)
        start = f.read(2)
        self.f, self.at, self.end = f, at, None
        self.head, self.rest = b"", b""
        if start == b"\x1f\x8b":
            method, flags = f.read(2)
            f.read(6)
            if flags & 4:
                (n,) = struct.unpack("<H", f.read(2))
                extra = f.read(n)
                if extra[:2] == b"WL" and extra[2:4] == b"\x08\0":
                    self.end = at + struct.unpack("<Q", extra[4:12])[0]
            for flag in (8, 16):  # a file name, a comment
                if flags & flag:
                    while f.read(1) not in (b"\0", b""):
                        pass
            if flags & 2:
                f.read(2)
            self.inflate = zlib.decompressobj(-15)
        else:
            self.inflate, self.head = None, start
        while b"\r\n\r\n" not in self.head and self._more():
            pass
        self.head, _, self.rest = self.head.partition(b"\r\n\r\n")
        self.headers = {}
        for line in self.head.decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            self.headers.setdefault(key.strip().lower(), value.strip())
        self.length = int(self.headers.get("content-length", "0") or 0)
        self.http: bytes | None = None
        if self.headers.get("content-type", "").startswith("application/http"):
            while b"\r\n\r\n" not in self.rest[: self.length] and len(self.rest) < self.length and self._more(True):
                pass
            self.http = self.rest[: self.length].partition(b"\r\n\r\n")[0]

    def _more(self, rest: bool = False, most: int = 4096) -> bool:
        """Decode a little more, of the headers or of the block."""
        if self.inflate is None:
            data = self.f.read(most)
        else:
            given = self.inflate.unconsumed_tail or self.f.read(most)
            data = self.inflate.decompress(given, most) if not self.inflate.eof else b""
            if not data and given and not self.inflate.eof:
                return True
        if rest:
            self.rest += data
        else:
            self.head += data
        return bool(data)

    def block(self) -> bytes:
        parts, have = [self.rest], len(self.rest)
        while have < self.length:
            before, self.rest = have, b""
            if not self._more(True, 1 << 16):
                break
            parts.append(self.rest)
            have += len(parts[-1])
            if have == before and self.inflate is not None and self.inflate.eof:
                break
        self.rest = b"".join(parts)
        return self.rest[: self.length]

    def next(self, size: int) -> int:
        """Where the next record begins; without a length in the member it must be decoded."""
        if self.end is not None:
            return self.end
        if self.inflate is None:
            return self.at + len(self.head) + 4 + self.length + 4
        while not self.inflate.eof:
            given = self.inflate.unconsumed_tail or self.f.read(1 << 16)
            if not given:
                return size
            self.inflate.decompress(given, 1 << 20)
        return self.f.tell() - len(self.inflate.unused_data) + 8

    def row(self) -> dict:
        h = self.headers
        length = self.length if self.http is None else self.length - len(self.http) - 4
        if self.http is not None and h.get("warc-type") == "revisit" and (m := re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", self.http)):
            length = int(m[1])
        return {
            "record_id": h.get("warc-record-id", "").strip("<>") or None,
            "record_type": h.get("warc-type"),
            "target_uri": h.get("warc-target-uri"),
            "refers_to": h.get("warc-refers-to", "").strip("<>") or None,
            "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "payload_bytes": length,
        }

    def payload(self) -> bytes:
        block = self.block()
        return block if self.http is None else block[len(self.http) + 4 :]


def passes(f, row: dict) -> bool:
    """One pushed predicate on a record's headers (SQL's null rules: a null passes none)."""
    if isinstance(f, Not):
        inner = f.child
        return row[inner.attribute[0]] is not None and not passes(inner, row)
    v = row[f.attribute[0]]
    match f:
        case IsNull():
            return v is None
        case IsNotNull():
            return v is not None
        case EqualNullSafe():
            return v == f.value
        case _ if v is None:
            return False
        case EqualTo():
            return v == f.value
        case In():
            return v in f.value
        case GreaterThan():
            return v > f.value
        case GreaterThanOrEqual():
            return v >= f.value
        case LessThan():
            return v < f.value
        case LessThanOrEqual():
            return v <= f.value
        case StringStartsWith():
            return v.startswith(f.value)
    raise ValueError(f)


PUSHED = (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool):
        self.path, self.with_payload, self.verify, self.filters = path, payload, verify, []

    def pushFilters(self, filters):
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if isinstance(inner, PUSHED) and len(inner.attribute) == 1 and inner.attribute[0] != "payload" and not (isinstance(f, Not) and isinstance(inner, (IsNull, EqualNullSafe))):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Split]:
        store, path = pa.fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        files = [info] if info.type == pa.fs.FileType.File else store.get_file_info(pa.fs.FileSelector(path, recursive=True))
        manifests = sorted(x.path for x in files if MANIFEST.fullmatch(x.base_name) and x.path.rpartition("/")[0] == path.rstrip("/"))
        splits = []
        for manifest in manifests:
            with store.open_input_stream(manifest, compression=None) as f:
                listed = json.loads(f.read())
            splits += [Split(f"{path}/{x['name']}", a, b) for x in listed if x["size"] for a, b in itertools.pairwise([*x["starts"], x["size"]])]
        # files of others; a part of the writer counts by its manifest only, where there is one
        return splits + [Split(x.path, 0, x.size) for x in files if re.search(r"\.warc(\.gz)?$", x.path) and x.size and not (manifests and PART.fullmatch(x.base_name))]

    def read(self, split: Split | None) -> Iterator[pa.RecordBatch]:
        if split is None:  # no archive, or none with a record
            return
        store, _ = pa.fs.FileSystem.from_uri(self.path)
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        kept, held = [], 0
        with store.open_input_file(split.name) as f:
            at, size = split.start, f.size()
            while at < split.stop:
                one = Member(f, at)
                row = one.row() | {"payload": None}
                if one.headers and all(passes(x, row) for x in self.filters):
                    if row["record_type"] != "revisit" and (self.with_payload or self.verify):
                        payload = one.payload()
                        if self.verify and row["payload_digest"] not in (None, digest(payload)):
                            raise ValueError(f"{split.name} at {at}: the payload does not match its digest")
                        if self.with_payload:
                            row["payload"] = payload
                            held += len(payload)
                    kept.append(row)
                    if len(kept) >= ROWS or held >= 4_000_000:
                        yield pa.RecordBatch.from_pylist(kept, schema)
                        kept, held = [], 0
                at = one.next(size)
        if kept:
            yield pa.RecordBatch.from_pylist(kept, schema)


class Warc(DataSource):
    """Options: path, split_mb (16), payload (true), verify (false: compare digests when reading)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], int(self.options.get("split_mb", "16")) << 20)

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true", self.options.get("verify", "false") == "true")


def register(spark: SparkSession) -> None:
    reachable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def to_records(pages: DataFrame) -> DataFrame:
    """Pages as records: of equal payloads the largest page_id is the response, others revisit it.

    Null html is the empty payload. A null page_id sorts below all others. Rows that repeat
    the response's page_id with its payload are responses too. Payloads are equal when their
    SHA-256 is (different ones of one SHA-1, the records' digest, are known). Only ids and
    digests shuffle to find the groups; pages then meet the (usually few) revisits by page_id.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    narrow = staged(pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha2(payload, 256)).alias("_sha")), "page-digests")
    groups = staged(narrow.groupBy("_sha").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "page-groups")
    again = narrow.join(groups, "_sha").where(~F.col("page_id").eqNullSafe(F.col("_last"))).distinct().withColumnsRenamed({"page_id": "_page", "_sha": "_of"})
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    met = own.join(again, own["page_id"].eqNullSafe(again["_page"]) & (F.unhex(F.sha2("payload", 256)) == again["_of"]), "left")
    revisit = F.col("_of").isNotNull()
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return met.select(
        name(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, name(F.col("_last"))).alias("refers_to"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.lit(None).cast("long").alias("payload_bytes"),
        "payload",
    )


def write_warc(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    to_records(pages).write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def page_of(record_id: F.Column) -> F.Column:
    return F.nullif(F.substring_index(record_id, ":", -1), F.lit("")).cast("long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archive")
    write_warc(table(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path, payload="false", verify="true")
    return records.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
