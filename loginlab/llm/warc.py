"""WARC archives as a PySpark Python data source.

Writing: every row becomes a record, every record a gzip member of its own (or plain bytes). The member's
header states its length, so a reader can pass over it without inflating it. Tasks write under names of
their own into a pending folder; the commit moves the files of the successful attempts, and only these.

Reading: a partition is a file, or several small ones. Predicates on the record type and other headers are pushed
into the source. A record's headers are parsed first; its payload is inflated and decoded only if the record
passes and the schema asks for the payload. Archives of others, plain or gzip without stated lengths, are read too.

``revisits`` turns pages into records: of equal payloads (compared by SHA-256) the row with the smallest id
is a response, the others are revisits that refer to it. Null payloads are empty. A null id comes
after all others; of several rows with the same id and payload one is the response. A null URL gives a record
without a target. Line breaks and other control characters in header values are percent-encoded. Other columns are ignored. An empty
table gives no archive and an empty result. Chunked HTTP bodies of other archives are returned as stored.
"""

from __future__ import annotations

import base64
import hashlib
import operator
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loginlab.llm.common import join_groups, kept, numbered, remove, scratch_folder, table

FILE_BYTES = 256 * 2**20  # a writer begins another file beyond that
PARTITION_BYTES = 64 * 2**20  # small files are read together up to that
BLOCK = 2**20  # bytes read at a time
HEAD = 2**20  # bytes within which a record's headers must end
BATCH_ROWS, BATCH_BYTES = 1000, 2**24
MOST_HELD = 2**24  # bytes of payloads that a writer's task is handed at a time
SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, content_length long, "
    "payload_digest string, refers_to string, http_status int, payload_bytes long, file string, offset long, payload binary"
)
# fixed values: names of the format
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "content_type": "content-type",
    "content_length": "content-length",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile("[\x00-\x1f\x7f]")
_LOCAL = re.compile("^file:/+")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), _LOCAL.sub("/", path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# writing


def record(row: dict) -> bytes:
    """The bytes of a record. A revisit has the HTTP head of its page, but not the payload."""
    payload = row.get("payload") or b""
    http = f"HTTP/1.1 {row.get('http_status') or 200} OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<{row['record_id']}>"),
        ("WARC-Target-URI", row.get("target_uri")),
        ("WARC-Date", row.get("date")),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Refers-To", f"<{row['refers_to']}>" if row.get("refers_to") else None),
        ("WARC-Profile", PROFILE if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    safe = lambda v: _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", v)
    head = "".join(f"{k}: {safe(v)}\r\n" for k, v in fields if v is not None)
    return b"".join([b"WARC/1.1\r\n", head.encode(), b"\r\n", block, b"\r\n\r\n"])


def member(data: bytes, level: int) -> bytes:
    """A gzip member whose header states its own length (0: too long to be stated)."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(data) + packer.flush()
    size = len(body) + 32
    stated = size if size < 2**32 and len(data) < 2**32 else 0
    extra = b"sl\x08\x00" + stated.to_bytes(4, "little") + (len(data) if stated else 0).to_bytes(4, "little")
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra
    return head + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) % 2**32).to_bytes(4, "little")


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[str]


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.pending = f"_pending-{uuid.uuid4().hex}"
        self.packed = options.get("compression", "gzip") == "gzip"
        self.level = int(options.get("level", 4))
        self.most = int(options.get("filebytes", FILE_BYTES))
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        names: list[str] = []
        out, size = None, 0
        fs.create_dir(posixpath.join(root, self.pending), recursive=True)
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {"date": self.date} | batch.slice(i, 1).to_pylist()[0]
                data = record(row)
                if out is None or size > self.most:
                    if out:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}")
                    out, size = fs.open_output_stream(posixpath.join(root, self.pending, names[-1]), compression=None), 0
                data = member(data, self.level) if self.packed else data
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for f in archives(self.path):
                fs.delete_file(f[0])
        for name in [n for m in messages if m for n in m.files]:
            fs.move(posixpath.join(root, self.pending, name), posixpath.join(root, name))
        self._clear(fs, root)

    def abort(self, messages) -> None:
        self._clear(*filesystem(self.path))

    def _clear(self, fs, root) -> None:
        folder = posixpath.join(root, self.pending)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


# reading


def archives(path: str) -> list[tuple[str, int]]:
    """⟨file, bytes⟩ of a folder, without what is pending."""
    fs, root = filesystem(path)
    if fs.get_file_info(root).type == pafs.FileType.File:
        return [(root, fs.get_file_info(root).size)]
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
    names = [(f.path, f.size) for f in found if f.path.endswith((".warc", ".warc.gz"))]
    return sorted(f for f in names if "/_pending-" not in f[0])


class Bytes:
    """A file read by position, through one block in memory."""

    def __init__(self, fs, path: str):
        self.file, self.size = fs.open_input_file(path), fs.get_file_info(path).size
        self.begin, self.block = 0, b""

    def at(self, begin: int, n: int) -> bytes:
        if begin < self.begin or begin + n > self.begin + len(self.block):
            self.file.seek(begin)
            self.begin, self.block = begin, self.file.read(max(n, BLOCK))
        return self.block[begin - self.begin : begin - self.begin + n]


class Plain:
    """The record at a position of an uncompressed file."""

    def __init__(self, file: Bytes, begin: int):
        self.file, self.begin = file, begin

    def part(self, begin: int, n: int) -> bytes:
        return self.file.at(self.begin + begin, n)

    def end(self, length: int) -> int:
        return self.begin + length


class Packed:
    """The record at a position of a gzip file, inflated as far as it is asked for."""

    def __init__(self, file: Bytes, begin: int):
        self.file, self.begin, self.next = file, begin, begin
        self.data, self.inflate = bytearray(), zlib.decompressobj(zlib.MAX_WBITS | 16)
        head = file.at(begin, 24)
        own = head[3:4] == b"\x04" and head[10:16] == b"\x0c\x00sl\x08\x00"
        self.stated = int.from_bytes(head[16:20], "little") if own else 0

    def part(self, begin: int, n: int) -> bytes:
        while len(self.data) < begin + n and self._more():
            pass
        return bytes(self.data[begin : begin + n])

    def _more(self) -> bool:
        if self.inflate.eof or self.next >= self.file.size:
            return False
        packed = self.file.at(self.next, min(65536 if self.data else 4096, self.file.size - self.next))
        self.data += self.inflate.decompress(packed)
        self.next += len(packed) - len(self.inflate.unused_data)
        return True

    def end(self, length: int) -> int:
        if self.stated:
            return self.begin + self.stated
        while self._more():
            self.data.clear()
        if not self.inflate.eof:
            raise ValueError(f"the record at byte {self.begin} is cut off")
        return self.next


def _headers(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:  # a folded line goes on with the header above
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _head(source, begin: int, most: int) -> tuple[list[str], int] | None:
    """Lines up to an empty one, and where it ends; None if there is none within ``most`` bytes."""
    n = min(2048, most)
    while True:
        data = source.part(begin, n)
        end = data.find(b"\r\n\r\n")
        if end >= 0:
            return data[:end].decode("utf-8", "replace").split("\r\n"), begin + end + 4
        if len(data) < n or n >= most:
            return None
        n = min(2 * n, most)


def records(fs, path: str, wanted: set[str], passes) -> Iterator[dict]:
    """The records of a file that pass, with the wanted columns."""
    file = Bytes(fs, path)
    at = 0
    while at < file.size:
        packed = file.at(at, 2) == b"\x1f\x8b"
        source = (Packed if packed else Plain)(file, at)
        found = _head(source, 0, HEAD)
        if found is None or not found[0][0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at} of {path}")
        lines, body = found
        head = _headers(lines[1:])
        length = int(head.get("content-length", 0))
        row = {c: head.get(name) for c, name in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c] and row[c].removeprefix("<").removesuffix(">")
        row |= {"content_length": length, "file": path, "offset": at}
        if passes(row):
            begin, row["http_status"] = body, None
            http = (row["content_type"] or "").startswith("application/http")
            if http and wanted & {"payload", "payload_bytes", "http_status"}:
                inner = _head(source, body, min(length, HEAD))
                if inner:
                    status = inner[0][0].split()
                    row["http_status"] = int(status[1]) if status[1:] and status[1].isdigit() else None
                    begin = inner[1]
            row["payload_bytes"] = body + length - begin
            if row["record_type"] == "revisit":
                size = _headers(inner[0][1:]).get("content-length") if begin > body else None
                row["payload_bytes"] = int(size) if size and size.isdigit() else None
            if "payload" in wanted and row["record_type"] != "revisit":
                row["payload"] = source.part(begin, body + length - begin)
            yield row
        at = source.end(body + length + 4)


_TESTS = {
    ds.EqualTo: operator.eq,
    ds.GreaterThan: operator.gt,
    ds.GreaterThanOrEqual: operator.ge,
    ds.LessThan: operator.lt,
    ds.LessThanOrEqual: operator.le,
    ds.In: lambda x, v: x in v,
    ds.StringStartsWith: str.startswith,
    ds.StringEndsWith: str.endswith,
    ds.StringContains: lambda x, v: v in x,
}
PUSHED = set(HEADERS) | {"file", "offset"}


def pushable(f: ds.Filter) -> bool:
    if isinstance(f, ds.Not):
        return pushable(f.child)
    known = type(f) in _TESTS or isinstance(f, (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe))
    return known and len(f.attribute) == 1 and f.attribute[0] in PUSHED


def test(f: ds.Filter, row: dict) -> bool | None:
    """A predicate on a record's headers; None for unknown, as in SQL."""
    if isinstance(f, ds.Not):
        answer = test(f.child, row)
        return None if answer is None else not answer
    x = row[f.attribute[0]]
    if isinstance(f, ds.IsNull):
        return x is None
    if isinstance(f, ds.IsNotNull):
        return x is not None
    if isinstance(f, ds.EqualNullSafe):
        return x == f.value
    return None if x is None else _TESTS[type(f)](x, f.value)


@dataclass
class Files(ds.InputPartition):
    paths: list[str]

    def __init__(self, paths):
        super().__init__(paths)
        self.paths = paths


class Reader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema, self.path = schema, options["path"]
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        groups: list[list[str]] = []
        size = self.most
        for path, n in archives(self.path):
            if size + n > self.most:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition):
        names, kinds = self.schema.names, pa.schema([_arrow(f) for f in self.schema])
        fs, _ = filesystem(self.path)
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            for row in records(fs, path, set(names), lambda r: all(test(f, r) for f in self.filters)):
                rows.append({n: row.get(n) for n in names})
                size += len(row.get("payload") or b"")
                if len(rows) == BATCH_ROWS or size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)


def _arrow(field) -> pa.Field:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.field(field.name, kinds[field.dataType.simpleString()])


class WarcSource(ds.DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(schema, self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records of an archive or a folder of archives. Without ``payload`` among the columns no payload is
    decoded. Filters on headers are pushed down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    fields = [f for f in SCHEMA.split(", ") if columns is None or f.split()[0] in columns]
    return spark.read.format("warc").schema(", ".join(fields)).load(path)


def write_warc(records_: DataFrame, path: str, **options) -> None:
    """``record_id, record_type, payload`` and, if there are any, ``target_uri, refers_to, date, http_status``."""
    spark = records_.sparkSession
    spark.dataSource.register(WarcSource)
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(most)
    spark.conf.set(most, str(MOST_HELD))
    try:
        records_.write.format("warc").options(**options).mode("append").save(path)
    finally:
        spark.conf.set(most, before)


def revisits(pages: DataFrame, least_bytes=0, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """Records of pages: ``id, target_uri, record_type, first, payload``; ``first`` is the id of the response that a
    revisit refers to. Payloads of fewer than ``least_bytes`` are responses all."""
    rows = numbered(pages, "_at").select(
        F.col(id_col).alias("id"),
        F.col(url_col).alias("target_uri"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload"),
        "_at",
    )
    rows = rows.withColumn("_key", F.sha2("payload", 256))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "_at")
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("_key")
    groups = groups.agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    again = F.coalesce(F.col("_first._at") != F.col("_at"), F.lit(False))
    return join_groups(rows, groups, ["_key"], "_n", "_at").select(
        "id",
        "target_uri",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first.id")).alias("first"),
        "payload",
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    pages = revisits(table(spark, sf_dir, "pages"))
    refers = F.when(F.col("record_type") == "revisit", urn("first")).alias("refers_to")
    folder = scratch_folder(spark, "warc")
    write_warc(pages.select(urn("id").alias("record_id"), "record_type", "target_uri", refers, "payload"), folder)
    columns = ["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    found = read_warc(spark, folder, columns).where(F.col("record_type").isin("response", "revisit"))
    found = kept(
        found.select(
            page("record_id").alias("page_id"),
            "payload_bytes",
            F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
            "record_type",
            page("refers_to").alias("refers_to"),
        )
    )
    remove(spark, folder)
    return found


ORACLE_SQL = """
WITH sums AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT page_id, html, list_aggregate([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT), 1)
    FOR k IN range(32)], 'string_agg', '') AS payload_digest FROM sums),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM coded)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""
