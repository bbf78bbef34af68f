"""WARC archives as a Spark data source, written and read.

Records are gzip members of their own, each with its length in the member's extra field (`sl`), so a reader gets from
one header to the next without decoding payloads. Reading plans partitions over files: small files together, large ones
cut at the record boundaries that the writer noted; files of other writers are read whole, compressed or plain. A
partition parses headers first. Predicates on record type and other header columns are pushed into the scan, and the
payload is decoded only for records that pass them and only if the schema asks for a column that needs it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull,
    LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, MapType, StringType, StructField, StructType

from ..sources.commits import FolderWriter, Written, listed, opened, place
from .common import Scratch, joined_evenly, table

FORMAT = "granary_warc"
_TEXT = ("file", "record_type", "record_id", "target_uri", "date", "content_type", "payload_digest", "refers_to", "payload_sha1")
_NUMBER = ("offset", "content_length", "payload_bytes")
SCHEMA = StructType([*(StructField(c, StringType()) for c in _TEXT), *(StructField(c, LongType()) for c in _NUMBER), StructField("headers", MapType(StringType(), StringType())), StructField("payload", BinaryType())])
#: Columns of the named fields; their predicates are pushed down.
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "content_length": "Content-Length", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"  #: the date of pages, which have none: the same at each attempt
FILE_BYTES = 1 << 30  #: a file is closed once it has so many
SPLIT_BYTES = 64 << 20  #: a partition reads about so many
NOTE_BYTES = 4 << 20  #: the writer notes a record boundary each so many bytes
HEADER_MOST = 1 << 20  #: a header that goes on for longer is an error
LEVEL = 6  #: of compression
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000  #: a batch of records is passed on at either
PLAIN_FIELD = re.compile(r"[\x00-\x20\x7f]")


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member with its lengths in an extra field, unless they need more than 32 bits."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 10 + 14 + len(body) + 8
    if max(size, len(data)) > 0xFFFFFFFF:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + body + tail


def member_length(head: bytes) -> int | None:
    """What the extra field of a gzip member says of its length."""
    if len(head) < 12 or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        name, size = struct.unpack_from("<2sH", head, at)
        if name == b"sl" and size == 8 and at + 12 <= len(head):
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + size
    return None


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record's bytes. Blanks and control characters that would break a field are percent-encoded; null fields are left out."""
    lines = [f"{name}: {PLAIN_FIELD.sub(lambda m: f'%{ord(m[0]):02X}', value)}" for name, value in fields if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def http(payload: bytes, length: int, kind: str) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {length}\r\n\r\n".encode() + payload


class Writer(FolderWriter):
    """Rows record_type, record_id, target_uri, date, media_type, payload_digest, payload_bytes, refers_to, headers (map)
    and payload: one record each, in files of about FILE_BYTES. Revisits keep the response's header and no payload."""

    def __init__(self, path: str, overwrite: bool, file_bytes: int, note_bytes: int) -> None:
        super().__init__(path, overwrite, ".warc.gz")
        self.file_bytes, self.note_bytes = file_bytes, note_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _ = opened(self.path)
        entries, out = [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or entries[-1]["bytes"] >= self.file_bytes:
                        if out:
                            out.close()
                        entries.append({"name": self.new_name(len(entries)), "bytes": 0, "splits": []})
                        out = store.open_output_stream(self.draft(entries[-1]["name"]), compression=None)
                        self._add(out, entries[-1], member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:granary:{entries[-1]['name']}>"), ("WARC-Date", EPOCH), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                    self._add(out, entries[-1], member(self.bytes_of(row)))
        finally:
            if out:
                out.close()
        return Written(entries)

    def _add(self, out, entry: dict, data: bytes) -> None:
        if entry["bytes"] >= (entry["splits"][-1] if entry["splits"] else 0) + self.note_bytes:
            entry["splits"].append(entry["bytes"])
        out.write(data)
        entry["bytes"] += len(data)

    @staticmethod
    def bytes_of(row: dict) -> bytes:
        revisit = row["record_type"] == "revisit"
        digest = row["payload_digest"]
        fields = [
            ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]), ("WARC-Target-URI", row["target_uri"]), ("Content-Type", "application/http;msgtype=response"),
            ("WARC-Payload-Digest", digest and f"sha1:{digest}"), ("WARC-Refers-To", row["refers_to"]), ("WARC-Profile", PROFILE if revisit else None), *(row["headers"] or ()),
        ]
        payload = b"" if revisit else row["payload"] or b""
        return record(fields, http(payload, row["payload_bytes"] if revisit else len(payload), row["media_type"] or "text/html;charset=utf-8"))


class Bytes:
    """A file's bytes from any offset on, read ahead in blocks; what is skipped is not read."""

    BLOCK = 1 << 20

    def __init__(self, file) -> None:
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def get(self, start: int, n: int) -> bytes:
        """At most n bytes from start on; fewer only at the end."""
        if start < self.at or start + n > self.at + len(self.held):
            self.held, self.at = self.file.read_at(max(n, self.BLOCK), start), start
        return self.held[start - self.at : start - self.at + n]


class Record:
    """One record: its fields at once, its block when asked for. `end` is where the next one begins."""

    def __init__(self, source: Bytes, start: int) -> None:
        self.source, self.start = source, start
        self.packed = source.get(start, 2) == b"\x1f\x8b"
        self.unpacker = zlib.decompressobj(31) if self.packed else None
        self.fed, self.known, self.done = start, member_length(source.get(start, 64)) if self.packed else None, False
        head = b""
        while (cut := head.find(b"\r\n\r\n")) < 0:
            more = self._more(4096)
            if not more or len(head) > HEADER_MOST:
                raise ValueError(f"no WARC record at byte {start}")
            head += more
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {start}")
        self.rest, self.header = head[cut + 4 :], cut + 4
        lines = re.sub(r"\r\n[ \t]+", " ", head[:cut].decode("utf-8", "replace")).split("\r\n")[1:]  # folded lines are joined
        self.fields = {name.strip(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        self.lower = {k.lower(): v for k, v in self.fields.items()}
        self.length = int(self.lower.get("content-length", 0))

    def _more(self, n: int) -> bytes:
        """Further bytes of the record: about n of them, none at its end."""
        if not self.packed:
            data = self.source.get(self.fed, n)
            self.fed += len(data)
            return data
        while not self.unpacker.eof:
            if self.unpacker.unconsumed_tail:
                data = self.unpacker.unconsumed_tail
            else:
                data = self.source.get(self.fed, min(self.source.BLOCK, max(n, 4096)) if self.known is None else max(1, min(n, self.start + self.known - self.fed)))
                if not data:
                    raise ValueError(f"the record at byte {self.start} is cut off")
                self.fed += len(data)
            if got := self.unpacker.decompress(data, n):
                return got
        return b""

    def block(self) -> bytes:
        parts, have = [self.rest], len(self.rest)
        while have < self.length and (more := self._more(max(4096, self.length - have))):
            parts.append(more)
            have += len(more)
        if have < self.length:
            raise ValueError(f"the record at byte {self.start} is cut off")
        return b"".join(parts)[: self.length]

    def end(self) -> int:
        if not self.packed:
            return self.start + self.header + self.length + 4
        if self.known is not None:
            return self.start + self.known
        while not self.unpacker.eof:
            self._more(1 << 16)
        return self.fed - len(self.unpacker.unused_data)

    def field(self, column: str):
        value = self.lower.get(FIELDS[column].lower())
        if column == "content_length":
            return self.length
        return value.removeprefix("sha1:") if value and column == "payload_digest" else value


@dataclass
class Part(InputPartition):
    ranges: list[tuple[str, int, int]]  # name, first byte, end


#: How a pushed filter is decided; a null value passes none of these.
TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


def predicate(given: Filter) -> Callable[[Record], bool] | None:
    """A test of a record's fields, or None where the filter can't be decided by them."""
    if isinstance(given, Not):
        inner = predicate(given.child)
        column = given.child.attribute[0] if inner else None
        null_safe = isinstance(given.child, EqualNullSafe | IsNull | IsNotNull)
        return inner and (lambda r: (null_safe or r.field(column) is not None) and not inner(r))
    column = getattr(given, "attribute", ("",))
    if len(column) != 1 or column[0] not in FIELDS:
        return None
    column, value = column[0], getattr(given, "value", None)
    if isinstance(given, IsNull):
        return lambda r: r.field(column) is None
    if isinstance(given, IsNotNull):
        return lambda r: r.field(column) is not None
    if isinstance(given, EqualNullSafe):
        return lambda r: r.field(column) == value
    test = TESTS.get(type(given))
    return test and (lambda r: (x := r.field(column)) is not None and value is not None and test(x, value))


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split_bytes: int) -> None:
        self.path, self.schema, self.split_bytes = path, schema, split_bytes
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if predicate(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Part]:
        """Ranges of whole records: noted boundaries cut large files, and small ranges share a partition."""
        parts: list[Part] = []
        size = self.split_bytes
        for entry in listed(self.path, ".warc", ".warc.gz"):
            cuts = [0]
            for at in entry.get("splits", ()):
                if at - cuts[-1] >= self.split_bytes:
                    cuts.append(at)
            for a, b in zip(cuts, [*cuts[1:], entry["bytes"]], strict=True):
                if size + b - a > self.split_bytes:
                    parts.append(Part([]))
                    size = 0
                parts[-1].ranges.append((entry["name"], a, b))
                size += b - a
        return parts or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        schema, tests = to_arrow_schema(self.schema), [predicate(f) for f in self.filters]
        names, rows, size = schema.names, [], 0
        wants = bool({"payload", "payload_sha1", "payload_bytes"} & set(names))
        store, _ = opened(self.path)
        for name, at, end in partition.ranges:
            with store.open_input_file(place(self.path, name)) as file:
                source = Bytes(file)
                while at < end:
                    if not source.get(at, 4).strip(b"\r\n"):  # blank lines between records of other writers
                        at += max(1, len(source.get(at, 4)))
                        continue
                    r = Record(source, at)
                    if all(test(r) for test in tests):
                        rows.append(self.row(r, name, names, wants))
                        size += len(rows[-1].get("payload") or b"") + 500
                        if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    at = r.end()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    @staticmethod
    def row(r: Record, name: str, names: list[str], wants: bool) -> dict:
        out = {c: r.field(c) for c in names if c in FIELDS} | {"file": name, "offset": r.start}
        if "headers" in names:
            out["headers"] = list(r.fields.items())
        if wants:
            block, kind = r.block(), r.field("content_type") or ""
            if kind.startswith("application/http"):
                head, _, payload = block.partition(b"\r\n\r\n")
                stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            else:
                payload, stated = block, None
            if r.field("record_type") == "revisit":
                out |= {"payload_bytes": int(stated[1]) if stated else None, "payload_sha1": None, "payload": None}
            else:
                out |= {"payload_bytes": len(payload), "payload": payload}
                if "payload_sha1" in names:
                    out["payload_sha1"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        return {c: out.get(c) for c in names}


class WarcSource(DataSource):
    """format(FORMAT): options path, split_bytes (reading), file_bytes and note_bytes (writing). A schema of some of
    SCHEMA's columns keeps what they don't need from being decoded."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema, int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite, int(self.options.get("file_bytes", FILE_BYTES)), int(self.options.get("note_bytes", NOTE_BYTES)))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets it get filters."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """A record for each row of pages (page_id, url, html). Of rows with equal payloads of at least `least` bytes, the
    one of largest page_id (null smallest; of repeated rows any one) is the response, and the others revisit it.

    Equal payloads are told by SHA-256. A payload that many rows share is found by partial aggregates, and its rows are
    joined by a broadcast of the few such keys, so they don't meet in one task.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.monotonically_increasing_id().alias("rid"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.unhex(F.sha1("payload"))})
    # rows below the least stand for themselves
    key = F.when(F.col("payload_bytes") >= least, F.unhex(F.sha2("payload", 256))).otherwise(F.col("rid").cast("string").cast("binary"))
    rows = scratch.written(rows.withColumn("key", key), "payloads")
    keys = rows.groupBy("key").agg(F.max(F.struct("page_id", "rid")).alias("top"), F.max(F.struct("page_id", "rid", "url"))["url"].alias("top_url"), F.count(F.lit(1)).alias("n"))
    both = joined_evenly(rows, scratch.written(keys, "keys"), "key", "n")
    revisit = F.col("rid") != F.col("top.rid")
    uri = lambda *c: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws(":", *(F.coalesce(x.cast("string"), F.lit("")) for x in c)).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))
    page = F.when(F.col("page_id").isNotNull(), F.struct(F.lit("WARC-Page-ID").alias("k"), F.col("page_id").cast("string").alias("v")))
    of = F.when(revisit & F.col("top.page_id").isNotNull(), F.struct(F.lit("WARC-Refers-To-Page-ID").alias("k"), F.col("top.page_id").cast("string").alias("v")))
    at = F.when(revisit & F.col("top_url").isNotNull(), F.struct(F.lit("WARC-Refers-To-Target-URI").alias("k"), F.col("top_url").alias("v")))
    return both.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), uri(F.col("page_id"), F.col("rid")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(EPOCH).alias("date"), F.lit(None).cast("string").alias("media_type"),
        base32(F.col("sha1")).alias("payload_digest"), "payload_bytes", F.when(revisit, uri(F.col("top.page_id"), F.col("top.rid"))).alias("refers_to"), F.map_from_entries(F.array_compact(F.array(page, of, at))).alias("headers"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def base32(digest: F.Column) -> F.Column:
    """Base32 of 20 bytes, in groups of 5 bits."""
    bits = F.concat(*(F.lpad(F.conv(F.substring(F.hex(digest), 10 * i + 1, 10), 16, 2), 40, "0") for i in range(4)))
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*(F.substring(letters, F.conv(F.substring(bits, 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)))


def archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes pages as archives below path. Null html is an empty payload, and null urls leave the field out."""
    register(pages.sparkSession)
    records(pages, Scratch(pages.sparkSession), least).write.format(FORMAT).mode("overwrite").save(path)


def visits(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archived pages, read back: payloads of responses
    are decoded and their digests compared with the stated ones, revisits have no payload to decode."""
    register(spark)
    read = spark.read.format(FORMAT).schema("record_type string, payload_digest string, headers map<string,string>, payload_bytes long, payload_sha1 string").load(path)
    read = read.where(F.col("record_type").isin("response", "revisit"))
    wrong = (F.col("record_type") == "response") & ~F.col("payload_sha1").eqNullSafe(F.col("payload_digest"))
    digest = F.when(wrong, F.raise_error(F.lit("a payload differs from its digest")).cast("string")).otherwise(F.col("payload_digest"))
    number = lambda name: F.col("headers").getItem(name).cast("long")
    return read.select(number("WARC-Page-ID").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", number("WARC-Refers-To-Page-ID").alias("refers_to"))


def op11_warc_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of pages, by way of archives in the shared folder; repeated rows and null page_ids stay."""
    path = f"{Scratch(spark).place}/archives"
    archive(table(spark, sf_dir, "pages"), path)
    return visits(spark, path)


#: SHA-1 isn't among DuckDB's functions under every name; its hex form is, and 5-bit groups make base32 of it.
OP11_SQL = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, first_value(r) OVER w AS top, first_value(page_id) OVER w AS top_page FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST, r)),
b AS (SELECT *, list_aggregate(list_transform(range(4), lambda i: lpad(bin(('0x' || substr(hex, 10 * i + 1, 10))::BIGINT), 40, '0')), 'string_agg', '') AS bits FROM d)
SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0b' || substr(bits, 5 * i + 1, 5))::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN r = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> top THEN top_page END AS refers_to FROM b
"""
