"""Web archives (WARC) as a Python data source, for reading and writing.

``register(spark)`` makes the format ``warc`` known.

* Writing: one archive per task, each record a gzip member of its own.  Tasks write under names of
  their attempt; the driver moves the files of successful tasks into place, so a lost executor
  leaves nothing behind.
* Reading: files are planned into partitions by size.  Conditions on ``record_type`` and on headers
  (equality and ``IN``) are pushed down.  A record's headers are parsed first; the payload of a
  record that is not wanted, or of all if the option ``payload`` is ``false``, is skipped undecoded.

Paths may be of any file system that pyarrow knows.
"""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from lodestone.session import checkpoint_dir

# Records with payloads of at least this size are stored once.
REVISIT_BYTES = 1000
PARTITION_BYTES = 64 << 20
_ROWS = 256
_READ = 1 << 20
SCHEMA = (
    "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, "
    "refers_to string, payload binary"
)
# Columns and the headers they are kept in.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
    "refers_to": "WARC-Refers-To",
}


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema.names)


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]) -> None:
        super().__init__(0)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.size = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {str(f.value)} if isinstance(f, EqualTo) else {str(v) for v in f.value}
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Small files together, a file in one partition, none of much more than the given size."""
        system, path = _file_system(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=False))
        plan: list[list[str]] = []
        held = 0
        for info in sorted(found, key=lambda i: i.path):
            if info.type != fs.FileType.File or not info.base_name.endswith(".warc.gz"):
                continue
            if not plan or held + info.size > self.size:
                plan.append([])
                held = 0
            plan[-1].append(info.path)
            held += info.size
        return [Files(p) for p in plan] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = [*HEADERS, "payload"]
        kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]
        system = _file_system(self.path)[0]
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with system.open_input_stream(path, compression=None) as stream:
                for headers, payload in records(stream, self._wants, self.payload):
                    values = [headers.get(h.lower()) for h in HEADERS.values()]
                    values[4] = int(values[4]) if values[4] else None
                    rows.append((*values, payload))
                    held += len(payload or b"")
                    if len(rows) >= _ROWS or held > _READ * 8:
                        yield _batch(rows, names, kinds)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, names, kinds)

    def _wants(self, headers: dict[str, str]) -> bool:
        return all(headers.get(HEADERS[c].lower()) in values for c, values in self.wanted.items())


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


class _Bytes:
    """Decompressed bytes of gzip members, read and skipped piece by piece."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.ready = stream, b"", b""
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.raw = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(_READ)
                if not self.raw:
                    return False
            out = self.inflate.decompress(self.raw)
            self.raw = b""
            if out:
                self.ready += out
                return True

    def line(self) -> bytes | None:
        while b"\n" not in self.ready:
            if not self._more():
                return None
        line, _, self.ready = self.ready.partition(b"\n")
        return line.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        parts = []
        while n:
            if not self.ready and not self._more():
                raise ValueError("an archive ends within a record")
            parts.append(self.ready[:n])
            self.ready = self.ready[n:]
            n -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while n:
            if not self.ready and not self._more():
                raise ValueError("an archive ends within a record")
            gone = min(n, len(self.ready))
            self.ready = self.ready[gone:]
            n -= gone


def records(stream, wants=lambda headers: True, payload: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers, by lower-case name, and payloads of the wanted records of a gzip archive."""
    data = _Bytes(stream)
    while True:
        line = data.line()
        if line is None:
            return
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not the start of a record")
        headers: dict[str, str] = {}
        while line := data.line():
            name, _, value = line.partition(b":")
            headers[name.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
        length = int(headers.get("content-length", 0))
        if not wants(headers):
            data.skip(length)
        elif payload:
            yield headers, data.take(length)
        else:
            data.skip(length)
            yield headers, None


def record(values: dict, payload: bytes | None) -> bytes:
    """One record as a gzip member."""
    body = payload or b""
    head = ["WARC/1.1", *[f"{h}: {_plain(values[c])}" for c, h in HEADERS.items() if values.get(c) is not None]]
    head += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html", f"Content-Length: {len(body)}"]
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as member:
        member.write(whole)
    return out.getvalue()


def _plain(value) -> str:
    """A header must stay one line."""
    return str(value).replace("\r", " ").replace("\n", " ")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns
        self.attempt = f"_attempt-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, path = _file_system(self.path)
        name = f"{uuid.uuid4().hex}.warc.gz"
        folder = f"{path}/{self.attempt}"
        system.create_dir(folder, recursive=True)
        written = 0
        with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in iterator:
                columns = {c: batch.column(i) for i, c in enumerate(self.columns)}
                for row in range(batch.num_rows):
                    values = {c: columns[c][row].as_py() for c in self.columns if c != "payload"}
                    out.write(record(values, columns["payload"][row].as_py()))
                    written += 1
        return Written([name] if written else [])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path = _file_system(self.path)
        for message in messages:
            for name in message.files if message else []:
                system.move(f"{path}/{self.attempt}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path = _file_system(self.path)
        if system.get_file_info(f"{path}/{self.attempt}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.attempt}")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """A record per row of ``pages(page_id, url, html)``, in the columns of the format.

    Of equal payloads of ``revisit_bytes`` or more the record with the largest page id holds the
    payload, the others refer to it.  A null html is an empty payload; a null page id counts as
    smaller than all others; rows that repeat the largest id all hold their payload.
    """
    page = F.col("page_id").cast("long")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(page.alias("page_id"), F.col("url"), payload.alias("payload"), F.sha1(payload).alias("digest")).withColumn(
        "bytes", F.octet_length("payload").cast("long")
    )
    # Only ids and digests are grouped; digests that occur once need no second look.
    best = (
        pages.select(page.alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
        .where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
        .where("n > 1 and best is not null").select(F.col("digest").alias("__digest"), "best")
    )
    revisit = F.col("best").isNotNull() & (F.coalesce(F.col("page_id") < F.col("best"), F.lit(True)))
    return rows.join(best, F.col("digest") == F.col("__digest"), "left").select(
        F.col("page_id").cast("string").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"), F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.col("bytes").alias("payload_bytes"), F.when(revisit, F.col("best").cast("string")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    register(pages.sparkSession)
    page_records(pages, revisit_bytes).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of pages written and read again.

    Size and digest of a response are computed from the payload read; a revisit names those of the
    payload it stands for.
    """
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_pages(pages, path)
    held = F.col("record_type") == "response"
    return read_archives(spark, path).select(
        F.col("record_id").cast("long").alias("page_id"),
        F.when(held, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        _bare(held).alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    )


def _bare(held: Column) -> Column:
    return F.when(held, F.sha1("payload")).otherwise(F.substring_index("payload_digest", ":", -1))
