"""WARC archives as a PySpark data source.

``spark.read.format("sluice_warc").load(folder)`` plans one partition per stretch of files, takes
filters on the header columns, parses each record's headers first and skips the payload of
records that the filters refuse or that nobody asked for. Records are gzip members of their own
whose extra field holds the member's length, so a skipped record is passed over by its length,
without inflating it. Plain records and foreign members without that field are read as well.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

from .common import read, shared_path

SCHEMA = ("warc_type string, record_id string, refers_to_id string, target_uri string, warc_date string, "
          "content_type string, payload_digest string, payload_length long, payload binary")
#: Header of each column; all but the payload's can be filtered on.
HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to_id": "WARC-Refers-To",
           "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "content_type": "Content-Type",
           "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 4 << 20
GZIP = b"\x1f\x8b\x08\x04"


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member whose 'sl' extra field holds its own and the record's length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    head = GZIP + struct.pack("<IBBH2sHII", 0, 0, 255, 12, b"sl", 8, 24 + len(body) + 8, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"{k}: {v}".replace("\r", " ").replace("\n", " ") for k, v in headers.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


@dataclass
class Stretch(InputPartition):
    files: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]
    rows: int


def _system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Any store that Arrow opens by its address; a bare path is a local or mounted folder."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.stretch = int(options.get("stretchBytes", 64 << 20))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name not in HEADERS or name == "payload_length":
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files are packed into stretches of about ``stretchBytes``; a large file is one by itself."""
        fs, root = _system(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        found = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")))
        packed, now, size = [], [], 0
        for path, n in found:
            if now and size + n > self.stretch:
                packed.append(Stretch(tuple(now)))
                now, size = [], 0
            now.append(path)
            size += n
        return [*packed, Stretch(tuple(now))]

    def wanted(self, headers: dict[str, str]) -> bool:
        for column, how, values in self.tests:
            have = headers.get(HEADERS[column].lower())
            if have is None or not (have in values if how == "in" else have.startswith(values[0])):
                return False
        return True

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64() if c == "payload_length" else pa.string()) for c in HEADERS]
                           + [("payload", pa.binary())])
        fs = _system(self.path)[0]
        rows, size = [], 0
        for path in partition.files:
            with fs.open_input_file(path) as file:
                for headers, block in self.records(file):
                    rows.append((headers, block))
                    size += len(block or b"") + 200
                    if size >= BATCH_BYTES:
                        yield self.batch(rows, schema)
                        rows, size = [], 0
        if rows:
            yield self.batch(rows, schema)

    @staticmethod
    def batch(rows: list[tuple[dict[str, str], bytes | None]], schema: pa.Schema) -> pa.RecordBatch:
        columns = []
        for column, header in HEADERS.items():
            values = [h.get(header.lower()) for h, _ in rows]
            if column == "payload_length":
                columns.append(pa.array([None if v is None else int(v) for v in values], pa.int64()))
            else:
                columns.append(pa.array(values, pa.string()))
        columns.append(pa.array([b for _, b in rows], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def records(self, file) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """Headers and, where asked for, payload of each wanted record of one open file."""
        at, end = 0, file.size()
        while at < end:
            file.seek(at)
            start = file.read(8192)
            if start[:3] == GZIP[:3]:
                at = yield from self._packed(file, at, start)
            else:
                at = yield from self._plain(file, at, start)

    def _packed(self, file, at: int, start: bytes) -> Iterator:
        length = None
        if start[3] & 4 and start[12:14] == b"sl":
            length = struct.unpack("<I", start[16:20])[0]
        inflate = zlib.decompressobj(31)
        read_to = at + len(start)
        out = inflate.decompress(start, 4096)
        left = inflate.unconsumed_tail

        def more(n: int) -> bytes:
            nonlocal left, read_to
            if not left and not inflate.eof:
                file.seek(read_to)
                left = file.read(1 << 16)
                read_to += len(left)
                if not left:
                    raise ValueError("WARC record ends early")
            got = inflate.decompress(left, n)
            left = inflate.unconsumed_tail
            return got

        while (cut := out.find(b"\r\n\r\n")) < 0 and not inflate.eof:
            out += more(4096)
        headers = parse_headers(out[:cut])
        wanted = self.wanted(headers)
        if wanted and not self.payload:
            yield headers, None
        if wanted and self.payload:
            size = int(headers.get("content-length", 0))
            parts, have = [out[cut + 4:]], len(out) - cut - 4
            while have < size and not inflate.eof:
                parts.append(more(1 << 20))
                have += len(parts[-1])
            yield headers, b"".join(parts)[:size]
        if length:
            return at + length
        while not inflate.eof:
            more(1 << 20)
        return read_to - len(left) - len(inflate.unused_data)

    def _plain(self, file, at: int, start: bytes) -> Iterator:
        while (cut := start.find(b"\r\n\r\n")) < 0:
            more = file.read(8192)
            if not more:
                if start.strip():
                    raise ValueError("WARC record ends early")
                return at + len(start)
            start += more
        headers = parse_headers(start[:cut])
        size = int(headers.get("content-length", 0))
        if self.wanted(headers):
            if self.payload:
                file.seek(at + cut + 4)
            yield headers, file.read(size) if self.payload else None
        return at + cut + 4 + size + 4


class WarcWriter(DataSourceArrowWriter):
    """One archive per task and ``fileBytes``. Files get names of the attempt and count only once they
    are renamed at commit, so a repeated task leaves nothing behind."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]
        self.level = int(options.get("level", 6))
        self.most = int(options.get("fileBytes", 1 << 30))
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _system(self.path)
        names, rows, out = [], 0, None
        try:
            for batch in iterator:
                columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
                for i in range(batch.num_rows):
                    if out is None or out.tell() > self.most:
                        if out is not None:
                            out.close()
                        fs.create_dir(root, recursive=True)
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out = fs.open_output_stream(f"{root}/{names[-1]}.part", compression=None)
                        info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
                                "Content-Type": "application/warc-fields"}
                        out.write(member(record(info, b"format: WARC File Format 1.1\r\n"), self.level))
                    row = {c: columns[c][i] for c in HEADERS if c in columns}
                    headers = {HEADERS[c]: None if v is None else str(v) for c, v in row.items()}
                    if headers.get("WARC-Type") == "revisit":
                        headers["WARC-Profile"] = REVISIT
                    out.write(member(record(headers, columns["payload"][i] or b""), self.level))
                    rows += 1
        finally:
            if out is not None:
                out.close()
        return Written(tuple(names), rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _system(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pyarrow.fs.FileSelector(root)):
                if f.path.endswith((".warc", ".warc.gz")):
                    fs.delete_file(f.path)
        for name in (n for m in messages if m for n in m.names):
            fs.move(f"{root}/{name}.part", f"{root}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _system(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{root}/{name}.part")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sluice_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known; filters reach a Python source only with this setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """One record per row of ``pages`` (page_id, url, html), as the writer takes it.

    Of equal payloads of at least ``least`` bytes the largest page_id is the response (all rows
    that have it, where it repeats; NULL ids are smaller than any), the others revisit it and carry
    no payload. NULL html is an empty payload, a NULL url leaves its header out, and a row without
    page_id gets a random record id. Digests are counted per digest before they are joined, so a
    group of copies of any size meets one row.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"),
                        payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_length"),
                        F.sha1(payload).alias("digest"))
    last = rows.filter(F.col("payload_length") >= least).groupBy(F.col("digest").alias("of_digest")).agg(
        F.max("page_id").alias("last"))
    joined = rows.join(last, F.col("digest") == F.col("of_digest"), "left")
    first = F.col("last").isNull() | F.coalesce(F.col("page_id") == F.col("last"), F.lit(False))
    urn = lambda c: F.when(c.isNotNull(), F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">")))
    return joined.select(
        F.when(first, "response").otherwise("revisit").alias("warc_type"),
        F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).alias("record_id"),
        F.when(~first, urn(F.col("last"))).alias("refers_to_id"), "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"), F.lit("text/html; charset=utf-8").alias("content_type"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"), "payload_length",
        F.when(first, F.col("payload")).alias("payload"))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per record, from the archives:
    a response's figures are taken from its payload, a revisit's from its headers."""
    register(spark)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    some = lambda c: F.when(number(c) != "", number(c).cast("long"))
    load = lambda kind, payload: spark.read.format("sluice_warc").option("payload", payload).load(folder).filter(
        F.col("warc_type") == kind)
    full = load("response", "true").select(
        some(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), F.col("warc_type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"))
    again = load("revisit", "false").select(
        some(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), some(F.col("refers_to_id")).alias("refers_to"))
    return full.unionByName(again)


def write_pages(pages: DataFrame, folder: str, least: int = 1000) -> None:
    register(pages.sparkSession)
    with_revisits(pages, least).write.format("sluice_warc").mode("append").save(folder)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    write_pages(read(spark, sf_dir, "pages"), folder)
    return read_pages(spark, folder)


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM q
"""

QUERIES = {"op2_warc": op2_warc}
ORACLES = {"op2_warc": SQL}
