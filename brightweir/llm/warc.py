"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Writing: every task writes files of its own, each record a gzip member of its own. A
member's header tells its compressed length (extra field ``sl``), so readers can step
over it. Only files named in the manifest that the commit leaves belong to the archive;
what failed or repeated tasks leave behind is never read.

Reading: the plan has a partition for every ``partition_bytes`` of a file, cut at record
starts that the manifest lists. Predicates on the record type and other header fields
are pushed down: a record's headers are inflated and parsed first, and of a record that
they rule out nothing more is inflated. Payloads are inflated only if asked for.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import saved, ship, text_or_empty

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, "
    "refers_to string, payload_bytes bigint, payload binary"
)
#: Columns that header fields give, with the fields' names (fixed values of the format).
FIELDS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 256 << 20  # a task begins another file beyond this
RESTART_BYTES = 4 << 20  # the manifest lists a record start this often
PARTITION_BYTES = 32 << 20
LEVEL = 4
STEP = 1 << 14  # compressed bytes inflated at a time while headers are looked for
BLANK = b"\r\n\r\n"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; plain paths and file: URIs are local."""
    if re.match(r"file:/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    """A gzip member whose extra field holds its own length and that of the record."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def field_value(value: object) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)


def record_bytes(row: dict) -> bytes:
    """One record; a revisit has the HTTP headers of its payload but not the payload."""
    payload, revisit = row.get("payload") or b"", row.get("record_type") == "revisit"
    fields = [
        ("WARC-Type", row.get("record_type") or "response"),
        ("WARC-Record-ID", f"<{row.get('record_id') or uuid.uuid4().urn}>"),
        ("WARC-Date", row.get("date")),
        ("WARC-Target-URI", row.get("target_uri")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Refers-To", f"<{row['refers_to']}>" if row.get("refers_to") is not None else None),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    block = http_block(payload) + (b"" if revisit else payload)
    fields.append(("Content-Length", len(block)))
    head = "".join(f"{k}: {field_value(v)}\r\n" for k, v in fields if v is not None)
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + BLANK


def info_record() -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = f"WARC-Type: warcinfo\r\nWARC-Record-ID: <{uuid.uuid4().urn}>\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return VERSION + b"\r\n" + head.encode() + block + BLANK


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files: list[dict] = []
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, first = system.open_output_stream(f"{folder}/{name}", compression=None), member(info_record())
                    out.write(first)
                    size = len(first)
                    files.append({"name": name, "starts": [0]})
                if size - files[-1]["starts"][-1] >= RESTART_BYTES:
                    files[-1]["starts"].append(size)
                data = member(record_bytes(row))
                out.write(data)
                size += len(data)
                files[-1]["size"] = size
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(folder)):
                if old.base_name.startswith("_manifest-"):
                    system.delete_file(old.path)
        lines = [json.dumps(f) for m in messages if m is not None for f in m.files]
        with system.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.jsonl", compression=None) as out:
            out.write("\n".join(lines).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """What was written stays unnamed and so unread."""


@dataclass
class Range(InputPartition):
    """Records of a file that begin from ``start`` on and before ``stop``."""

    path: str
    start: int
    stop: int


class Source:
    """A file read from a place on, as raw or inflated bytes of one record at a time."""

    def __init__(self, file: pa.NativeFile, at: int) -> None:
        self.file, self.at = file, at

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def open_record(self) -> bool:
        """Prepare the record at ``self.at``; false at the end of the file."""
        head = self.read(self.at, 64)
        while head[:2] == b"\r\n":  # blank lines between records of a plain file
            self.at += 2
            head = self.read(self.at, 64)
        if not head:
            return False
        self.data, self.length, self.raw = b"", None, self.at
        self.packed = head[:2] == b"\x1f\x8b"
        if self.packed:
            flags, self.raw = head[3], self.at + 10
            if flags & 4:
                extra = struct.unpack("<H", head[10:12])[0]
                if extra == 12 and head[12:14] == b"sl":
                    self.length = struct.unpack("<I", head[16:20])[0]
                self.raw += 2 + extra
            for flag in (8, 16):  # file name and comment, ended by a zero byte
                while flags & flag and self.read(self.raw, 1) not in (b"\0", b""):
                    self.raw += 1
                self.raw += bool(flags & flag)
            self.raw += 2 * bool(flags & 2)
            self.inflate = zlib.decompressobj(-15)
        return True

    def more(self) -> bool:
        """Take in the next bytes of the record; false if there are none."""
        if self.packed and self.inflate.eof:
            return False
        part = self.read(self.raw, STEP)
        self.raw += len(part)
        self.data += self.inflate.decompress(part) if self.packed else part
        return bool(part)

    def until_blank(self, start: int) -> int:
        """Place after the next blank line from ``start`` on."""
        while (found := self.data.find(BLANK, start)) < 0:
            if not self.more():
                return len(self.data)
        return found + 4

    def upto(self, size: int) -> None:
        parts, have = [self.data], len(self.data)
        while have < size:
            self.data = b""
            if not self.more():
                break
            parts.append(self.data)
            have += len(self.data)
        self.data = b"".join(parts)

    def skip(self, size: int) -> None:
        """Go to the next record; ``size`` is that of this one without its closing blank lines."""
        if not self.packed:
            self.at += size + 4
        elif self.length:
            self.at += self.length
        else:
            while not self.inflate.eof:
                self.data = b""
                if not self.more():
                    break
            self.at = self.raw - len(self.inflate.unused_data) + 8


def headers(block: bytes) -> dict[str, str]:
    lines = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines if k}


def columns_of(fields: dict[str, str]) -> dict[str, str | None]:
    out = {name: fields.get(field) for name, field in FIELDS.items()}
    for name in ("record_id", "refers_to"):
        out[name] = out[name].strip("<>") if out[name] is not None else None
    return out


def passes(row: dict, test: Filter) -> bool:
    value = row[test.attribute[0]]
    match test:
        case EqualTo():
            return value is not None and value == test.value
        case EqualNullSafe():
            return value == test.value
        case In():
            return value in test.value and value is not None
        case IsNotNull():
            return value is not None
        case IsNull():
            return value is None
        case StringStartsWith():
            return value is not None and value.startswith(test.value)
    return True


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if isinstance(test, (EqualTo, EqualNullSafe, In, IsNotNull, IsNull, StringStartsWith)) and test.attribute[0] in FIELDS and len(test.attribute) == 1:
                self.tests.append(test)
            else:
                yield test

    def files(self) -> Iterator[dict]:
        system, folder = opened(self.path)
        info = system.get_file_info(folder)
        if info.type == fs.FileType.File:
            yield {"name": "", "size": info.size, "starts": [0]}
            return
        found = system.get_file_info(fs.FileSelector(folder))
        manifests = [f.path for f in found if f.base_name.startswith("_manifest-")]
        for path in manifests:
            with system.open_input_stream(path, compression=None) as file:
                yield from map(json.loads, file.read().decode().splitlines())
        if not manifests:  # an archive that others have written
            for f in found:
                if f.base_name.endswith((".warc", ".warc.gz")):
                    yield {"name": f.base_name, "size": f.size, "starts": [0]}

    def partitions(self) -> list[Range]:
        out = []
        for file in self.files():
            path, start = f"{self.path}/{file['name']}".rstrip("/"), 0
            for at in [*file["starts"][1:], file["size"]]:
                if at - start >= self.partition_bytes or at == file["size"]:
                    out.append(Range(path, start, at))
                    start = at
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in self.records(partition):
            rows.append(row)
            size += 500 + len(row["payload"] or b"")
            if size >= 4 << 20:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        names = [*FIELDS, "payload_bytes", "payload"]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

    def records(self, partition: Range) -> Iterator[dict]:
        if not partition.path:
            return
        system, path = opened(partition.path)
        with system.open_input_file(path) as file:
            source = Source(file, partition.start)
            while source.at < partition.stop and source.open_record():
                head = source.until_blank(0)
                fields = headers(source.data[:head])
                length = int(fields.get("content-length", 0))
                row = columns_of(fields)
                if all(passes(row, t) for t in self.tests):
                    yield row | self.payload_of(source, fields, head, length)
                source.skip(head + length)

    def payload_of(self, source: Source, fields: dict[str, str], head: int, length: int) -> dict:
        """Size of the payload and, if asked for, the payload: what follows the HTTP headers in the block."""
        http = fields.get("content-type", "").startswith("application/http")
        begin, size = head, length
        if http:
            begin = min(source.until_blank(head), head + length)
            size = int(headers(source.data[head:begin]).get("content-length", head + length - begin))
        revisit = fields.get("warc-type") == "revisit"
        payload = None
        if not revisit and (self.payload or self.verify):
            source.upto(head + length)
            payload = source.data[begin : head + length]
            said = fields.get("warc-payload-digest", "")
            if self.verify and said.startswith("sha1:") and (said[5:] != digest(payload) or size != len(payload)):
                raise ValueError(f"payload of {fields.get('warc-record-id')} differs from its digest or length")
        return {"payload_bytes": size, "payload": payload if self.payload else None}


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let it push predicates down."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, response_id)``: the page whose payload each page repeats.

    Of pages with equal payloads of at least ``least_bytes`` that with the smallest id
    is the response, which has itself as ``response_id``; so have all smaller payloads.
    Only payloads that occur more than once are looked up.
    """
    rows = pages.select("page_id", "url", F.encode(text_or_empty("html"), "UTF-8").alias("payload")).withColumn("sha", F.sha1("payload"))
    shared = saved(
        rows.where(F.length("payload") >= least_bytes)
        .groupBy("sha")
        .agg(F.min("page_id").alias("response_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("sha").alias("shared_sha"), "response_id"),
        "warc-shared",
    )
    return rows.join(shared, rows["sha"] == shared["shared_sha"], "left").select(
        "page_id", "url", "payload", F.coalesce("response_id", "page_id").alias("response_id")
    )


def page_records(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Records to be written, one for each row of ``pages`` (``page_id, url, html``).

    A null html is an empty payload, a null url gives no target, a null id is kept as
    such. Rows that repeat id and payload of the response are responses too. Other
    columns are not looked at.
    """
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    repeats = ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return with_revisits(pages, least_bytes).select(
        urn("page_id").alias("record_id"),
        F.when(repeats, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit(None).cast("string").alias("payload_digest"),  # the writer computes it
        F.when(repeats, urn("response_id")).alias("refers_to"),
        F.length("payload").cast("bigint").alias("payload_bytes"),
        "payload",
    )


def write_warc(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """Records of an archive (``SCHEMA``); ``verify`` checks response payloads against their digests."""
    register(spark)
    return spark.read.format("warc").option("payload", payload).option("verify", verify).load(path)


def page_id_of(urn: str) -> Column:
    return F.nullif(F.regexp_extract(urn, r"^urn:page:(-?\d*)$", 1), F.lit("")).cast("bigint")


#: Five hex digits of the digest are 20 bits, four letters of the base-32 alphabet.
CHECK = """
WITH hashed AS (
    SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first
    FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) % 32 + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed
"""
