"""WARC archives as a Spark data source, and the archiving of pages with revisit records for equal payloads.

``format("warc")`` writes record-compressed archives (``.warc.gz``, one gzip member a record) and reads them, archives whose
gzip members hold several records or parts of one, and plain ``.warc``. Planning lists the files and packs them into partitions by size; a file is read by one task, and the
writer starts a new file beyond ``max_file_bytes``. Predicates on the header columns are pushed down: the reader parses a
record's headers first, and a record that they exclude is neither decoded further nor, where its member states its
length in the "sl" extra field (as this writer's do), read. Option ``payload=false`` leaves out all payloads that way.

The writer's tasks write under temporary names and the driver renames the files of the tasks that succeeded, so tasks
that are repeated or lost leave nothing that a reader sees. Both sides open files through Arrow's file systems, by the
path's scheme, and need no folder of their own.

Defined cases: a null payload is empty; null headers are left out and read as null; line ends in header values are
percent-encoded; an archive without records gives no rows; one that ends within a record, or has a record whose length is
missing or no number, is an error; of repeated pages (same id, same payload) the first is the
response and the others revisit it; a null page id sorts above all others.
"""

from __future__ import annotations

import datetime
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from lamella.llm.common import scratch

SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, content_type string, payload_bytes long, payload binary"
#: Column -> the header that it is read from.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type"}
IDS = ("record_id", "refers_to")
ARROW = pa.schema([*((name, pa.string()) for name in HEADERS), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
#: Rows and payload bytes of a batch that the reader hands on, and bytes of files that a partition packs.
BATCH_ROWS, BATCH_BYTES, PARTITION_BYTES = 2000, 8 << 20, 128 << 20
#: A gzip header with an extra field that holds "sl": the member's length and the record's.
GZIP_HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sH", 12, b"sl", 8)


def store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if re.match(r"[A-Za-z][\w+.-]*:", path):
        return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return arrow_fs.LocalFileSystem(), path


# Records


def record_bytes(row: dict, date: str) -> bytes:
    """A record of the columns of SCHEMA. A revisit has the HTTP headers of what it stands for, and no payload."""
    payload = row["payload"] or b""
    kind = row["record_type"] or "resource"
    length = len(payload) if row.get("payload_bytes") is None else row["payload_bytes"]
    if kind in ("response", "revisit"):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {_line(row.get('content_type') or 'text/html; charset=utf-8')}\r\nContent-Length: {length}\r\n\r\n".encode()
        block_type = "application/http; msgtype=response"
    else:
        block, block_type = b"", _line(row.get("content_type") or "application/octet-stream")
    if kind != "revisit":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {_line(kind)}", f"WARC-Date: {_line(row.get('warc_date') or date)}"]
    for column, header in (("record_id", "WARC-Record-ID"), ("target_uri", "WARC-Target-URI"), ("refers_to", "WARC-Refers-To")):
        if (value := row.get(column)) is not None:
            head.append(f"{header}: <{_line(value)}>" if column in IDS else f"{header}: {_line(value)}")
    digest = row.get("payload_digest") or hashlib.sha256(payload).hexdigest()
    head += [f"WARC-Payload-Digest: sha256:{_line(digest)}"]
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += [f"Content-Type: {block_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(value: str) -> str:
    """A header's value, which is one line without space around it."""
    return re.sub(r"^\s|[\r\n]|\s$", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), value)


def member(record: bytes) -> bytes:
    """A gzip member of a record, which states its own length."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    length = len(GZIP_HEAD) + 8 + len(body) + 8
    return GZIP_HEAD + struct.pack("<II", length, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _headers(raw: bytes) -> dict[str, str]:
    """Lower-case names and values of the lines after the first; a line that starts with space continues the one before."""
    found: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def _columns(headers: dict[str, str]) -> dict:
    out = {column: headers.get(name) for column, name in HEADERS.items()}
    for column in IDS:
        out[column] = out[column] and out[column].removeprefix("<").removesuffix(">")
    if out["payload_digest"]:
        out["payload_digest"] = out["payload_digest"].removeprefix("sha256:")
    return out


def _finish(out: dict, block: bytes) -> dict:
    """Adds what the block has: for HTTP, its own content type and length and the payload after its headers."""
    if (out["content_type"] or "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = _headers(head)
        out["content_type"] = http.get("content-type")
        length = http.get("content-length", "")
        out["payload_bytes"] = int(length) if out["record_type"] == "revisit" and length.isdigit() else len(payload)
    else:
        payload = block
        out["payload_bytes"] = len(payload)
    out["payload"] = None if out["record_type"] == "revisit" else payload
    return out


def _length(headers: dict[str, str]) -> int:
    """The block's length as the headers have it."""
    value = headers.get("content-length", "")
    if not (value.isascii() and value.isdigit()):
        raise ValueError(f"a record's length is {value!r}")
    return int(value)


def _plain_records(f, keep, payloads: bool) -> Iterator[dict]:
    """Records of a file or a stream of records one after another."""
    while True:
        lines = []
        while (line := f.readline()) in (b"\r\n", b"\n"):
            pass
        while line and line not in (b"\r\n", b"\n"):
            lines.append(line)
            line = f.readline()
        if not lines:
            return
        if not line:
            raise EOFError("the archive ends within a record")
        headers = _headers(b"".join(x.rstrip(b"\r\n") + b"\r\n" for x in lines))
        length, out = _length(headers), _columns(headers)
        if payloads and keep(out):
            block = f.read(length)
            if len(block) < length:
                raise EOFError("the archive ends within a record")
            yield _finish(out, block)
        else:
            left = length
            while left and (piece := f.read(min(left, 1 << 20))):
                left -= len(piece)
            if left:
                raise EOFError("the archive ends within a record")
            if keep(out):
                yield out | {"payload_bytes": None, "payload": None}


class Inflated(io.RawIOBase):
    """What the gzip members of a file hold, one after another, up to its end; an incomplete member is an error."""

    def __init__(self, f):
        self.f, self.inflate, self.raw = f, None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while True:
            if self.inflate is None or self.inflate.eof:
                self.raw = self.inflate.unused_data if self.inflate is not None else self.raw
                self.raw = self.raw or self.f.read(1 << 16)
                if not self.raw:
                    return 0
                self.inflate = zlib.decompressobj(31)
            elif not self.raw and not self.inflate.unconsumed_tail:
                self.raw = self.f.read(1 << 16)
                if not self.raw:
                    raise EOFError("the archive ends within a record")
            out = self.inflate.decompress(self.inflate.unconsumed_tail + self.raw if not self.inflate.eof else self.raw, len(target))
            self.raw = b""
            if out:
                target[: len(out)] = out
                return len(out)


def _gzip_records(f, keep, payloads: bool) -> Iterator[dict]:
    """Records of a compressed archive.

    A member that states its length holds one record, of which only the headers are inflated where the rest isn't wanted,
    and the rest isn't read. From the first other member on the file is a stream, whatever its members hold of records.
    """
    while True:
        at = f.tell()
        start = f.read(24)
        if not start:
            return
        if start[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {at}")
        if len(start) < 24 or not start[3] & 4 or start[12:16] != b"sl\x08\0":
            f.seek(at)
            yield from _plain_records(io.BufferedReader(Inflated(f), 1 << 16), keep, payloads)
            return
        end = at + struct.unpack("<I", start[16:20])[0]
        inflate, got, raw = zlib.decompressobj(31), bytearray(), start
        while (split := got.find(b"\r\n\r\n")) < 0 and not inflate.eof:
            got += inflate.decompress(raw)
            if got.find(b"\r\n\r\n") < 0 and not inflate.eof:
                raw = f.read(min(4096, end - f.tell()))
                if not raw:
                    raise EOFError("the archive ends within a record")
        headers = _headers(bytes(got[: max(0, split)]))
        out, length = _columns(headers), _length(headers)
        if keep(out):
            if payloads:
                got += inflate.decompress(f.read(end - f.tell()))
                if not inflate.eof:
                    raise EOFError("the archive ends within a record")
                yield _finish(out, bytes(got[split + 4 : split + 4 + length]))
            else:
                yield out | {"payload_bytes": None, "payload": None}
        f.seek(end)


def read_records(f, compressed: bool, keep=lambda columns: True, payloads: bool = True) -> Iterator[dict]:
    """The records of an open archive whose header columns ``keep`` accepts."""
    return (_gzip_records if compressed else _plain_records)(f, keep, payloads)


# Data source

#: The predicates on header columns that the reader decides, by kind.
TESTS = {
    EqualTo: lambda value, x: value is not None and value == x.value,
    EqualNullSafe: lambda value, x: value == x.value,
    In: lambda value, x: value is not None and value in x.value,
    IsNotNull: lambda value, x: value is not None,
    StringStartsWith: lambda value, x: value is not None and value.startswith(x.value),
    StringEndsWith: lambda value, x: value is not None and value.endswith(x.value),
    StringContains: lambda value, x: value is not None and x.value in value,
}
#: Known before the block is read. The content type of an HTTP record is not.
EARLY = set(HEADERS) - {"content_type"}


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payloads = str(options.get("payload", "true")).lower() != "false"
        self.packed = int(options.get("partition_bytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for x in filters:
            if type(x) in TESTS and len(x.attribute) == 1 and x.attribute[0] in EARLY:
                self.filters.append(x)
            else:
                yield x

    def partitions(self):
        files, base = store(self.path)
        info = files.get_file_info(base)
        found = [info] if info.type == arrow_fs.FileType.File else files.get_file_info(arrow_fs.FileSelector(base, recursive=True))
        found = sorted((x.path, x.size) for x in found if x.type == arrow_fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path) and not x.base_name.startswith((".", "_")))
        packs: list[list[str]] = []
        room = 0
        for path, size in found:
            if not packs or size > room:
                packs.append([])
                room = self.packed
            packs[-1].append(path)
            room -= size
        return [Files(tuple(x)) for x in packs] or [Files(())]

    def keep(self, columns: dict) -> bool:
        return all(TESTS[type(x)](columns[x.attribute[0]], x) for x in self.filters)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = store(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with io.BufferedReader(files.open_input_file(path), 1 << 20) as f:
                for row in read_records(f, path.endswith(".gz"), self.keep, self.payloads):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceArrowWriter):
    TEMPORARY = ".unfinished"

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.most = int(options.get("max_file_bytes", 1 << 30))
        self.date = options.get("date") or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base = store(self.path)
        files.create_dir(base, recursive=True)
        context = TaskContext.get()
        stem = f"{base}/part-{context.partitionId() if context else 0:05d}-{self.job}-{uuid.uuid4().hex[:12]}"
        paths: list[str] = []
        out = None
        size = 0
        for batch in iterator:
            columns = [batch.column(name) if name in batch.schema.names else None for name in ARROW.names]
            for i in range(batch.num_rows):
                data = member(record_bytes({name: None if c is None else c[i].as_py() for name, c in zip(ARROW.names, columns, strict=True)}, self.date))
                if out is None or size + len(data) > self.most and size:
                    if out is not None:
                        out.close()
                    paths.append(f"{stem}-{len(paths):03d}.warc.gz")
                    out, size = io.BufferedWriter(files.open_output_stream(paths[-1] + self.TEMPORARY), 1 << 20), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(paths)

    def commit(self, messages) -> None:
        files, base = store(self.path)
        files.create_dir(base, recursive=True)
        made = [p for m in messages if m is not None for p in m.paths]
        before = files.get_file_info(arrow_fs.FileSelector(base, recursive=True)) if self.overwrite else []
        # New archives are in place before old ones go, so what fails between leaves both, never neither.
        for path in made:
            files.move(path + self.TEMPORARY, path)
        for x in before:
            if x.type == arrow_fs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path):
                files.delete_file(x.path)
        self._sweep(files, base)

    def abort(self, messages) -> None:
        files, base = store(self.path)
        self._sweep(files, base)

    def _sweep(self, files, base: str) -> None:
        """Removes what tasks of this job that did not count have left."""
        for x in files.get_file_info(arrow_fs.FileSelector(base, allow_not_found=True)):
            if self.job in x.base_name and x.base_name.endswith(self.TEMPORARY):
                files.delete_file(x.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``format("warc")`` known to a session, with its predicates pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# Pages


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """The records of pages: of equal payloads of at least ``least`` bytes, the one of the smallest id is a response.

    Only digests and ids are grouped, with partial aggregation; each page then meets the row of its own id, so no
    payload follows a group.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    # A key that is never null: the join and the numbering of repeated pages then share one shuffle of the payloads.
    rows = rows.withColumn("page_key", F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    narrow = rows.where(F.col("payload_bytes") >= least).select("page_id", "page_key", F.unhex("payload_digest").alias("d"))
    firsts = narrow.groupBy("d").agg(F.min("page_id").alias("first"))
    ids = narrow.distinct().join(firsts, "d").select("page_key", F.lower(F.hex("d")).alias("payload_digest"), "first", F.lit(True).alias("known"))
    rows = rows.join(ids, ["page_key", "payload_digest"], "left")
    again = F.row_number().over(Window.partitionBy("page_key", "payload_digest").orderBy("target_uri"))
    rows = rows.withColumn("again", again)
    revisit = F.coalesce("known", F.lit(False)) & (~F.col("page_id").eqNullSafe(F.col("first")) | (F.col("again") > 1))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("again") > 1, F.concat(name("page_id"), F.lit(":"), F.col("again"))).otherwise(name("page_id")).alias("record_id"),
        "target_uri",
        F.when(revisit, name("first")).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str, **columns: str) -> None:
    """Writes the records of pages into archives below ``path``."""
    register(pages.sparkSession)
    with_revisits(pages, **columns).write.format("warc").mode("append").save(path)


def pages_in(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of ``archive``'s: ``page_id, record_type, payload_bytes, payload_digest, refers_to, target_uri``.

    A response's digest is computed from the payload that was read; a revisit's is what its headers say.
    """
    register(spark)
    number = lambda c: F.regexp_extract(F.col(c), r"^urn:page:(-?\d+)", 1).try_cast("long")
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    return spark.read.format("warc").load(path).select(number("record_id").alias("page_id"), "record_type", "payload_bytes", digest.alias("payload_digest"), number("refers_to").alias("refers_to"), "target_uri")


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    path = scratch(pages.sparkSession, "warc")
    archive(pages, path)
    return pages_in(pages.sparkSession, path)
