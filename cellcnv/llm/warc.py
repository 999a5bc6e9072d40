"""WARC archives as a Python data source, with payload deduplication by revisit records.

Reading plans partitions of whole files packed by size. Predicates on the record type and on header columns
are pushed down: headers are parsed first, and the payload of a record that is not wanted is neither decoded
nor, where the member's length is known, read. (Archives written here keep each record in a gzip member of its
own with its compressed length in an "SL" extra field; without it the member is inflated and thrown away.)

Writing puts each task's records into a hidden file that the commit renames, so lost and repeated tasks leave
nothing visible.

Defined results: a null payload is empty; a null url leaves out the header; a null page_id gives a record
without an id that is never referred to; among repeated rows of the largest page_id with equal payloads each is
a response; columns other than page_id, url and html are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)

from .common import fresh_path, table

RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
#: Columns that a pushed-down predicate may name, all known before the payload is decoded.
HEADER_COLUMNS = {"record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes"}
NAMES = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 8 << 20


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str) -> str:
    """A value that can't end its header line: control characters and blanks are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(record_id: str | None, target_uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {date}"]
    lines += [f"WARC-Record-ID: <urn:page:{header_value(record_id)}>"] if record_id is not None else []
    lines += [f"WARC-Target-URI: {header_value(target_uri)}"] if target_uri is not None else []
    lines += [f"WARC-Refers-To: <urn:page:{header_value(refers_to)}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    """One gzip member whose extra field SL holds the member's compressed and plain length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = b"SL" + struct.pack("<HII", 8, 24 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths):
        super().__init__(None)
        self.paths = paths


class _Source:
    """Bytes of a file by position, plain or member by member."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at = file, size, 0

    def bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, max(0, self.size - at)))

    def records(self):
        """Yields (head, rest): the head is parsed text up to the payload; rest() gives the block, if asked for."""
        while self.at < self.size:
            start = self.bytes(self.at, 4096)
            yield from self._member(start) if start[:2] == b"\x1f\x8b" else self._plain(start)

    def _member(self, start: bytes):
        at, known = self.at, None
        if start[3] & 4:
            extra = start[12 : 12 + struct.unpack_from("<H", start, 10)[0]]
            if extra[:2] == b"SL":
                known = struct.unpack_from("<I", extra, 4)[0]
        inflate, data, read = zlib.decompressobj(31), b"", 0

        def more(least: int | None):
            """Inflate until the plain text has `least` bytes, or to the end of the member."""
            nonlocal data, read
            parts, have = [data], len(data)
            while not inflate.eof and (least is None or have < least):
                chunk = inflate.unconsumed_tail
                if not chunk:
                    chunk = self.bytes(at + read, 65536 if least is None else 4096)
                    read += len(chunk)
                    if not chunk:
                        raise ValueError("a gzip member breaks off")
                plain = inflate.decompress(chunk, 0 if least is None else max(1, least - have))
                parts.append(plain)
                have += len(plain)
            data = b"".join(parts)

        least = 2048
        more(least)
        while (head_end := _head_end(data)) is None and not inflate.eof:
            least *= 2
            more(least)

        def rest() -> bytes:
            more(None)
            return data[head_end:]

        yield data[:head_end], rest
        if known:
            self.at = at + known
        else:
            more(None)
            self.at = at + read - len(inflate.unused_data)

    def _plain(self, start: bytes):
        n = len(start)
        while (head_end := _head_end(start)) is None and self.at + n < self.size:
            n *= 2
            start = self.bytes(self.at, n)
        if head_end is None:
            raise ValueError("a record's header breaks off")
        warc_end = start.index(b"\r\n\r\n") + 4
        length = int(_fields(start[:warc_end])["content-length"])
        at = self.at
        yield start[:head_end], lambda: self.bytes(at + head_end, length - (head_end - warc_end))
        self.at = at + warc_end + length + 4


def _head_end(data: bytes) -> int | None:
    """Where the block's payload begins: after the WARC header and, for HTTP blocks, after the HTTP header."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    if b"application/http" in data[:end]:
        end = data.find(b"\r\n\r\n", end + 4)
        if end < 0:
            return None
    return end + 4


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if _}


def header_row(head: bytes) -> dict:
    """The header columns of a record, from its head alone."""
    warc, _, http = head.partition(b"\r\n\r\n")
    headers = _fields(warc)
    row = {c: headers.get(n) for c, n in NAMES.items()}
    for c in ("record_id", "refers_to"):
        if row[c]:
            row[c] = row[c].strip("<>").removeprefix("urn:page:")
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].partition(":")[2]
    length = (_fields(http) if http else headers).get("content-length")
    return row | {"payload_bytes": None if length is None else int(length), "headers": headers}


TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: lambda a, b: a.startswith(b), IsNotNull: lambda a, _: True,
}


def holds(row: dict, tests: list[tuple[type, str, object]]) -> bool:
    """Whether a header row meets all predicates; null meets none."""
    return all(row[c] is not None and TESTS[kind](row[c], value) for kind, c, value in tests)


class WarcReader(DataSourceReader):
    """Options: path; payload (true: decode payloads, else they are null); verify (true: check payload digests); split_bytes."""

    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true") == "true"
        self.verify, self.split_bytes = options.get("verify", "false") == "true", int(options.get("split_bytes", 64 << 20))
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.tests.append((type(f), f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        where, root = filesystem(self.path)
        found = [i for i in where.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and not i.base_name.startswith(("_", ".")) and re.search(r"\.warc(\.gz)?$", i.base_name)]
        groups, room = [], 0
        for i in sorted(found, key=lambda i: (-i.size, i.path)):
            if room < i.size or not groups:
                groups.append([])
                room = self.split_bytes
            groups[-1].append(i.path)
            room -= i.size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition):
        where, _ = filesystem(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with where.open_input_file(path) as file:
                for head, rest in _Source(file, file.size()).records():
                    row = header_row(head)
                    if not holds(row, self.tests):
                        continue
                    row["payload"] = None
                    if self.payload and row["record_type"] != "revisit":
                        block = rest()
                        row["payload"] = block[: row["payload_bytes"]] if row["payload_bytes"] is not None else block
                        if self.verify and row["payload_digest"] and digest_of(row["payload"]) != row["payload_digest"]:
                            raise ValueError(f"record {row['record_id']} in {path} doesn't match its payload digest")
                        held += len(row["payload"])
                    row["headers"] = list(row["headers"].items())
                    rows.append(row)
                    held += len(head)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


ARROW = pa.schema([
    *((c, pa.string()) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")),
    ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])


@dataclass
class Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_id, target_uri, payload, refers_to; options: path, level (0: plain), date, max_file_bytes."""

    def __init__(self, options: dict):
        self.path, self.level = options["path"], int(options.get("level", 4))
        self.date, self.most = options.get("date", "1970-01-01T00:00:00Z"), int(options.get("max_file_bytes", 512 << 20))

    def write(self, iterator):
        where, root = filesystem(self.path)
        where.create_dir(root, recursive=True)
        names, file, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(c).to_pylist() for c in ("record_id", "target_uri", "payload", "refers_to")]
            for record_id, uri, payload, refers_to in zip(*columns):
                if file is None:
                    names.append(f"{uuid.uuid4().hex}.warc" + (".gz" if self.level else ""))
                    file, size = where.open_output_stream(f"{root}/_{names[-1]}", compression=None), 0
                data = record_bytes(record_id, uri, payload or b"", refers_to, self.date)
                data = gzip_member(data, self.level) if self.level else data
                file.write(data)
                size += len(data)
                if size >= self.most:
                    file.close()
                    file = None
        if file is not None:
            file.close()
        return Written(names)

    def commit(self, messages):
        where, root = filesystem(self.path)
        for name in (n for m in messages if m for n in m.names):
            where.move(f"{root}/_{name}", f"{root}/{name}")

    def abort(self, messages):
        where, root = filesystem(self.path)
        for name in (n for m in messages if m for n in m.names):
            where.delete_file(f"{root}/_{name}")


class Warc(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """record_id, target_uri, payload and refers_to: of equal payloads of at least min_bytes, only the largest page_id is a response."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.length("payload").cast("long"))
    same = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(same, ["digest", "size"], "left")
    revisit = F.col("page_id").isNull() & F.col("first").isNotNull() | (F.col("page_id") != F.col("first"))
    return joined.select(F.col("page_id").cast("string").alias("record_id"), "target_uri", "payload", F.when(revisit, F.col("first").cast("string")).alias("refers_to"))


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, **options) -> None:
    register(pages.sparkSession)
    with_revisits(pages, min_bytes).write.format("warc").mode("append").options(**options).save(path)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records of all archives under a path. where() on header columns is pushed down; payload="false" leaves payloads out."""
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def op2_warc(spark, sf_dir):
    path = fresh_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path, verify="true")
    return records.select(
        F.col("record_id").cast("long").alias("page_id"),
        F.when(F.col("record_type") == "revisit", F.col("payload_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    )


OP2_SQL = r"""
with p as (
  select page_id, coalesce(html, '') html, upper(sha1(coalesce(html, ''))) h, max(page_id) over (partition by coalesce(html, '')) first from pages
), fives as (
  select *, list_transform(range(0, 8), lambda i: cast('0x' || substr(h, cast(5 * i + 1 as bigint), 5) as integer)) parts from p
)
select page_id, cast(strlen(html) as bigint) payload_bytes,
  array_to_string(list_transform(parts, lambda x: array_to_string(list_transform([32768, 1024, 32, 1], lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x // d % 32 + 1, 1)), '')), '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to
from fives
"""
