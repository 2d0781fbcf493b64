"""WARC archives as a data source of Spark, read and written in tasks.

``spark.read.format("warc")`` plans partitions from whole files, small ones
together. A record's headers are parsed first; what conditions on record types,
ids, targets, dates, digests or lengths ask for is tested on them, and the payload of a
record that fails, or whose content no column asks for, is not decoded: in
plain files its bytes are passed over, and in compressed ones, of one gzip
member a record, the member's length in its ``sl`` field lets the reader go on
to the next. Columns are those of the schema asked for.

``df.write.format("warc")`` writes a file for each task, closed at ``roll``
bytes and followed by another. Files get their names when the job commits; those
of failed attempts never do.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from braidwork.sources.shared import delete, qualified, store

from .common import materialize, maybe_broadcast, shared_dir, table

#: Pushes conditions down to data sources written in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
RECORD = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, "
    "content_type string, content_length long, headers map<string,string>, http_headers string, payload binary, computed_digest string"
)
#: Header fields of the format's standard, and one of ours for the length of a payload that a revisit leaves out.
FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
    "content_length": "Content-Length",
    "payload_length": "X-Payload-Length",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns that need a record's content.
CONTENT = {"http_headers", "payload", "computed_digest"}
ROLL = 256 << 20
#: Bytes of files that make a partition together, and of a read.
TOGETHER = 64 << 20
CHUNK = 1 << 20
#: Longest block of headers.
MOST_HEADERS = 1 << 20


def digest32(payload: bytes) -> str:
    """SHA-1 in base 32, as archives state it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header's value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def member(record: bytes, level: int = 1) -> bytes:
    """One gzip member whose extra field ``sl`` states its own length and that of the record."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    head = struct.pack("<BBBBIBBH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, (24 + len(body) + 8) & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(row) -> bytes:
    """A record with its block: headers of HTTP, then the payload, which a revisit leaves out but states."""
    payload = bytes(row["payload"] or b"")
    revisit = row["refers_to"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {row['content_type'] or 'text/html; charset=utf-8'}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", row["date"] or "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", row["url"]),
        ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"),
        ("X-Payload-Length", str(len(payload))),
        ("WARC-Profile", REVISIT if revisit else None),
        ("WARC-Refers-To", row["refers_to"]),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceWriter):
    """Tasks write files of their own below ``_temporary-``; the commit moves those of the attempts that count."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.packed, self.roll = options.get("compression", "gzip") == "gzip", int(options.get("roll", ROLL))
        self.job = uuid.uuid4().hex
        self.held = f"{self.path}/_temporary-{self.job}"

    def write(self, iterator):
        place, held = store(self.held)
        place.create_dir(held)
        files, out = [], None
        for row in iterator:
            if out is None:
                files.append(f"part-{uuid.uuid4().hex}.warc{'.gz' * self.packed}")
                out = place.open_output_stream(f"{held}/{files[-1]}", compression=None)
            record = record_bytes(row)
            out.write(member(record) if self.packed else record)
            if out.tell() >= self.roll:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        from pyarrow import fs

        place, path = store(self.path)
        place.create_dir(path)
        if self.overwrite:
            for f in place.get_file_info(fs.FileSelector(path)):
                if not f.base_name.startswith("_temporary-"):
                    (place.delete_file if f.is_file else place.delete_dir)(f.path)
        for m in messages:
            for name in m.files if m else ():
                place.move(f"{path}/_temporary-{self.job}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages):
        place, held = store(self.held)
        if place.get_file_info(held).type.name == "Directory":
            place.delete_dir(held)


class Files(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)


class Plain:
    """Bytes of a file in order, and passing over some of them."""

    def __init__(self, file):
        self.file, self.held, self.end = file, b"", False

    def more(self) -> bool:
        got = b"" if self.end else self.file.read(CHUNK)
        self.end = not got
        self.held += got
        return bool(got)

    def until(self, mark: bytes, most: int) -> bytes | None:
        """Up to and with ``mark``; None at the end."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            if len(self.held) > most:
                raise ValueError("no end of a record's headers")
            start = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        out, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, missing = [self.held[:n]], n - len(self.held)
        self.held = self.held[n:]
        while missing > 0:
            if not (got := self.file.read(min(missing, CHUNK))):
                raise ValueError("a record ends too early")
            parts.append(got)
            missing -= len(got)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        beyond = n - len(self.held)
        self.held = self.held[n:]
        if beyond > 0:
            self.file.seek(self.file.tell() + beyond)


class Member(Plain):
    """The bytes of one gzip member of ``file``, which may be left early."""

    def __init__(self, packed: Plain):
        super().__init__(None)
        self.packed, self.inflate, self.used = packed, zlib.decompressobj(31), 0
        self.length = self._stated()

    def _stated(self) -> int:
        """The member's length from its ``sl`` field, 0 if it has none."""
        while len(self.packed.held) < 24 and self.packed.more():
            pass
        head = self.packed.held[:24]
        if len(head) < 24 or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4 or head[12:14] != b"sl":
            return 0
        return struct.unpack("<I", head[16:20])[0]

    def more(self) -> bool:
        while not self.inflate.eof:
            if not self.packed.held and not self.packed.more():
                raise ValueError("a compressed record ends too early")
            given = self.packed.held[:65536]
            got = self.inflate.decompress(given)
            rest = self.inflate.unused_data if self.inflate.eof else b""
            self.used += len(given) - len(rest)
            self.packed.held = rest + self.packed.held[len(given) :]
            if got:
                self.held += got
                return True
        return False

    def take(self, n: int) -> bytes:
        parts, missing = [self.held[:n]], n - len(self.held)
        self.held = self.held[n:]
        while missing > 0:
            if not self.more():
                raise ValueError("a record ends too early")
            parts.append(self.held[:missing])
            missing -= len(parts[-1])
            self.held = self.held[len(parts[-1]) :]
        return b"".join(parts)

    def leave(self) -> None:
        """Go on to the next member, over what has not been inflated if the length is known."""
        if not self.inflate.eof and self.length > self.used:
            self.packed.skip(self.length - self.used)
            return
        while not self.inflate.eof:
            self.held = b""
            self.more()


def parse_headers(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name, continued lines joined; the last of equal names counts."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/\d+\.\d+", lines[0].strip()):
        raise ValueError(f"no record starts with {lines[0][:40]!r}")
    out, name = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def fields_of(headers: dict[str, str]) -> dict:
    """The columns that the headers alone give."""
    out = {column: headers.get(name.lower()) for column, name in FIELDS.items()}
    for c in ("content_length", "payload_length"):
        out[c] = int(out[c]) if out[c] is not None and re.fullmatch(r"\d{1,18}", out[c]) else None
    if out["payload_digest"] is not None:
        out["payload_digest"] = out["payload_digest"].rpartition(":")[2]
    out["headers"] = headers
    return out


def wanted(row: dict, conditions: list) -> bool:
    for kind, column, value in conditions:
        x = row[column]
        if kind in ("isnull", "notnull"):
            ok = (x is None) == (kind == "isnull")
        elif kind == "same":
            ok = x == value
        elif x is None:
            return False
        else:
            ok = {
                "eq": lambda: x == value, "in": lambda: x in value, "lt": lambda: x < value, "le": lambda: x <= value, "gt": lambda: x > value, "ge": lambda: x >= value,
                "starts": lambda: x.startswith(value), "ends": lambda: x.endswith(value), "contains": lambda: value in x,
            }[kind]()
        if not ok:
            return False
    return True


#: Strings compare by bytes in Spark and by code points here, which is the same order.
KINDS = {EqualTo: "eq", EqualNullSafe: "same", In: "in", LessThan: "lt", LessThanOrEqual: "le", GreaterThan: "gt", GreaterThanOrEqual: "ge", IsNull: "isnull", IsNotNull: "notnull", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains"}


class WarcReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.schema, self.conditions = options["path"], schema, []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if type(f) in KINDS and column in FIELDS and not (isinstance(f, In) and any(v is None for v in f.value)):
                self.conditions.append((KINDS[type(f)], column, value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        place, path = store(self.path)
        info = place.get_file_info(path)
        found = [info] if info.is_file else place.get_file_info(fs.FileSelector(path, recursive=True))
        names = [f for f in found if f.is_file and re.search(r"\.warc(\.gz)?$", f.path) and "/_temporary-" not in f.path]
        out, size = [[]], 0
        for f in sorted(names, key=lambda f: f.path):
            if out[-1] and size + f.size > TOGETHER:
                out.append([])
                size = 0
            out[-1].append(f.path)
            size += f.size
        return [Files(x) for x in out]

    def read(self, partition):
        place, _ = store(self.path)
        names, content = self.schema.names, bool(CONTENT & set(self.schema.names))
        kinds = pa.schema([(f.name, _arrow(f.dataType)) for f in self.schema])
        held, size = [], 0
        for path in partition.value:
            with place.open_input_file(path) as file:
                for row in records(Plain(file), path.endswith(".gz"), self.conditions, content):
                    held.append([row.get(n) for n in names])
                    size += 200 + len(row.get("payload") or b"")
                    if size >= 8 << 20:
                        yield _batch(held, kinds)
                        held, size = [], 0
        if held:
            yield _batch(held, kinds)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}[kind.simpleString()]


def _batch(rows: list[list], kinds: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    entries = lambda f, c: [list(m.items()) for m in c] if pa.types.is_map(f.type) else list(c)
    return pa.RecordBatch.from_arrays([pa.array(entries(f, c), f.type) for f, c in zip(kinds, columns)], schema=kinds)


def records(source: Plain, compressed: bool, conditions: list, content: bool):
    """Rows of an open file: headers, and the content of records that meet the conditions if it is asked for."""
    while source.held or source.more():
        part = Member(source) if compressed else source
        raw = part.until(b"\r\n\r\n", MOST_HEADERS)
        if raw is None:
            if part.held.strip():
                raise ValueError("no end of a record's headers")
            return
        row = fields_of(parse_headers(raw.lstrip(b"\r\n")))
        keep, length = wanted(row, conditions), row["content_length"] or 0
        if keep and content:
            row |= block_of(row, part.take(length))
        if compressed:
            part.leave()
        else:
            part.skip(length + 4 if not (keep and content) else 4)
        if keep:
            yield row


def block_of(row: dict, block: bytes) -> dict:
    """The payload behind headers of HTTP, the whole block of other records; none for a revisit."""
    http = None
    if (row["content_type"] or "").lower().replace(" ", "").startswith("application/http"):
        head, mark, rest = block.partition(b"\r\n\r\n")
        if mark:
            http, block = head.decode("utf-8", "replace"), rest
    if row["record_type"] == "revisit":
        return {"http_headers": http, "payload": None, "computed_digest": None}
    return {"http_headers": http, "payload": block, "computed_digest": digest32(block)}


class WarcSource(DataSource):
    """``format("warc")``, option ``path``; to write also ``roll`` (bytes) and ``compression`` (gzip or none)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("warc")`` known and lets conditions reach it; the setting stays on in this session."""
    spark.dataSource.register(WarcSource)
    spark.conf.set(PUSHDOWN, "true")


def read_warc(spark: SparkSession, path: str, columns: str = RECORD, where: str | None = None) -> DataFrame:
    """Records of a file or folder that meet the condition ``where``; ``columns``, some of those of RECORD, decides whether payloads are decoded.

    Read anew for each condition: Spark 4.1 keeps what was pushed down with
    the relation, so two conditions on one relation inside one query would
    both read what the last of them asks for. Every record has a type; that
    condition makes sure that a later query on the relation pushes its own.
    """
    register(spark)
    asked = T._parse_datatype_string(columns)
    typed = asked if "record_type" in asked.names else T.StructType([*asked.fields, T.StructField("record_type", T.StringType())])
    found = spark.read.format("warc").schema(typed).load(qualified(spark, path)).where("record_type IS NOT NULL")
    return (found.where(where) if where else found).select(*asked.names)


def revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """``pages`` with ``original``: of pages with equal payloads of at least ``least`` bytes the largest key, null on its own row and for smaller payloads.

    Digests are counted in tasks before they are shuffled; a page that shares
    its payload with a third of all others meets one row.
    """
    digest = F.sha2(F.coalesce(F.col(payload).cast("binary"), F.lit(b"")), 256)
    marked = pages.withColumn("_sha", F.when(F.coalesce(F.octet_length(F.col(payload)), F.lit(0)) >= least, digest))
    latest = marked.where("_sha IS NOT NULL").groupBy("_sha").agg(F.max(key).alias("_latest"), F.count("*").alias("_n")).where("_n > 1")
    latest = materialize(latest.select(F.col("_sha").alias("_same"), "_latest"), "latest-pages")
    joined = marked.join(maybe_broadcast(latest), F.col("_sha") == F.col("_same"), "left")
    return joined.withColumn("original", F.when(~F.col(key).eqNullSafe(F.col("_latest")), F.col("_latest"))).drop("_sha", "_same", "_latest")


def urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), key.cast("string"), F.lit(">"))


def key_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1)


def write_pages(pages: DataFrame, path: str, least: int = 0, roll: int = ROLL) -> None:
    """Archives of ``pages`` (page_id, url, html) in the folder ``path``; a payload that comes again is written once and revisited.

    Defined results: a null html is an empty payload; a null url has no target
    field; control characters of a url are percent-encoded; a null page_id is
    written as ``null`` and reads back null; rows that repeat the largest
    page_id of a payload are responses, each; an empty table writes no
    record; other columns are not written. A payload is handled as one row.
    """
    register(pages.sparkSession)
    named = revisits(pages.select("page_id", "url", "html"), least=least)
    out = named.select(
        F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:null>")).alias("record_id"),
        F.col("url"),
        F.lit(None).cast("string").alias("date"),
        urn(F.col("original")).alias("refers_to"),
        F.lit(None).cast("string").alias("content_type"),
        F.col("html").cast("binary").alias("payload"),
    )
    out.write.format("warc").option("roll", roll).mode("append").save(qualified(pages.sparkSession, path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives that ``write_pages`` made.

    Responses are decoded, and their lengths and digests taken from what was
    read. Of revisits only headers are parsed.
    """
    number = lambda c: F.nullif(key_of(F.col(c)), F.lit("")).cast("long")
    kept = read_warc(spark, path, "record_id string, record_type string, payload binary, computed_digest string", "record_type = 'response'")
    kept = kept.select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("computed_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = read_warc(spark, path, "record_id string, record_type string, payload_length long, payload_digest string, refers_to string", "record_type = 'revisit'")
    again = again.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    return kept.unionByName(again)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_pages(table(spark, sf_dir, "pages"), path)
    found = materialize(read_pages(spark, path), "warc-pages")
    delete(spark, path)
    return found


OP13_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS latest FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((CAST('0x' || substr(hex, 5 * g + 1, 5) AS BIGINT) >> s) & 31) + 1]), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM latest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM latest THEN latest END AS refers_to FROM d
"""
