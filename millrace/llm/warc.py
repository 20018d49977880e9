"""WARC archives as a PySpark Python data source, read and written.

    spark.dataSource.register(WarcDataSource)
    df.write.format("warc").mode("append").save(folder)
    spark.read.format("warc").load(folder).filter("record_type = 'response'")

Writing: each task writes one .warc.gz of its own name, one gzip member per
record. A member's header carries the 'SL' extra field: its compressed and
uncompressed length. The commit writes a manifest that lists the files of tasks
that succeeded, with a place to start about every `chunk` bytes; files of failed
or repeated tasks, which their names tell, are in no manifest and never read.

Reading: partitions are planned from the manifests, a file's chunks apart from
one another; archives of other tools, in subfolders too, are one partition each, and
plain .warc files are refused. Equality and IN on
record_type and on the header columns, and prefixes of target_uri, are pushed to
the source (with spark.sql.python.filterPushdown.enabled). The headers of a
record are inflated and parsed first, from the first bytes of its member; the
rest is inflated only if the record passes and its payload is wanted. Option
payload=false leaves payloads null. With an SL field an unwanted member is
skipped by its length; without one it must be inflated to find its end, but is
never kept.

Folders are reached through pyarrow.fs, so a URI of any store it knows will do.

Defined results: a null payload is the empty one; a null url leaves out the
target URI and a null page_id its header, and both read back as null; rows that
repeat page_id and payload are all written, as responses if they have the
smallest page_id; an empty table gives no records. write_pages() needs page_id,
url and html and ignores other columns, so their names cannot clash. Payloads
are written and read whole.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from millrace.llm import _store
from millrace.llm._arrow import slices

SCHEMA = (
    "record_type string, record_id string, refers_to_id string, target_uri string, page_id long, refers_to_page long, "
    "payload_digest string, payload_bytes long, payload binary"
)
#: Column of the source -> its WARC header. The last three are this writer's own.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "refers_to_id": "WARC-Refers-To",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "page_id": "Millrace-Page-ID",
    "refers_to_page": "Millrace-Refers-To-Page",
    "payload_bytes": "Millrace-Payload-Length",
}
_LONGS = {"page_id", "refers_to_page", "payload_bytes"}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_FIXED = struct.Struct("<4sIBB")
_READ = 1 << 20
#: How the names of this writer's archives begin; those that no manifest lists are of failed tasks.
_OWN = "millrace-part-"
#: Rows of a broadcast table, about 100 bytes each.
_BROADCAST_ROWS = 400_000


def _system(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def member(data: bytes) -> bytes:
    """One gzip member with its lengths in an SL extra field."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra = struct.pack("<2sHII", b"SL", 8, (len(body) + 32) & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return (
        _FIXED.pack(b"\x1f\x8b\x08\x04", 0, 0, 255) + struct.pack("<H", len(extra)) + extra + body
        + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    )


def record(headers: dict[str, str | None], payload: bytes | None) -> bytes:
    """A WARC/1.1 record. payload None: a revisit, whose block is empty."""
    block = b"" if payload is None else _HTTP + payload
    told = {k: v for k, v in headers.items() if v is not None}
    if payload is None:
        told["WARC-Profile"] = _REVISIT
    else:
        told["Content-Type"] = "application/http; msgtype=response"
    told["Content-Length"] = str(len(block))
    clean = lambda v: "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in v)
    head = "WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in told.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_headers(head: bytes) -> dict[str, str]:
    """Header names in lower case -> values; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class _Source:
    """A file's bytes from a place on, read as they are asked for."""

    def __init__(self, file, start: int):
        file.seek(start)
        self.file, self.held, self.used, self.at = file, b"", 0, start

    def peek(self, n: int) -> bytes:
        while len(self.held) - self.used < n and (more := self.file.read(max(_READ, n))):
            self.held, self.used = self.held[self.used :] + more, 0
        return self.held[self.used : self.used + n]

    def skip(self, n: int) -> None:
        if n <= len(self.held) - self.used:
            self.used += n
        else:
            self.file.seek(self.at + n)
            self.held, self.used = b"", 0
        self.at += n

    def back(self, data: bytes) -> None:
        """Give back what was skipped last."""
        self.held, self.used = data + self.held[self.used :], 0
        self.at -= len(data)


class _Member:
    """The gzip member that begins where the source stands; inflated step by step."""

    def __init__(self, source: _Source):
        self.source, self.known, self.done = source, None, False
        fixed = source.peek(12)
        if len(fixed) == 12 and fixed[:2] == b"\x1f\x8b" and fixed[3] & 4:
            n = struct.unpack("<H", fixed[10:])[0]
            extra, k = source.peek(12 + n)[12:], 0
            while k + 4 <= len(extra):
                name, size = struct.unpack("<2sH", extra[k : k + 4])
                if name == b"SL" and size == 8:
                    packed, plain = struct.unpack("<II", extra[k + 4 : k + 12])
                    # The length of a member over 4 GiB does not fit the field.
                    self.known = packed if plain < 0xFFFFFFFF - (1 << 20) else None
                k += 4 + size
        self.inflater, self.start, self.eaten = zlib.decompressobj(31), source.at, 0

    def read(self, most: int) -> bytes:
        """At most `most` further bytes; none at the member's end."""
        while not self.done:
            if self.inflater.unconsumed_tail:
                out = self.inflater.decompress(self.inflater.unconsumed_tail, most)
            else:
                # Not past the member's end, where that is known.
                fed = self.source.peek(1 << 14 if self.known is None else min(1 << 14, self.known - self.eaten))
                if not fed:
                    raise EOFError("a gzip member is cut short")
                self.source.skip(len(fed))
                self.eaten += len(fed)
                out = self.inflater.decompress(fed, most)
            if self.inflater.eof:
                self.done = True
                self.spare = self.inflater.unused_data
            if out:
                return out
        return b""

    def finish(self) -> None:
        """Leave the source at the next member."""
        if not self.done and self.known is not None:
            self.source.skip(self.known - self.eaten)
            return
        while not self.done:
            self.read(_READ)
        self.source.back(self.spare)


def read_records(file, start: int, end: int, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and payload of each record that begins in [start, end) and whose headers `wanted` accepts."""
    source = _Source(file, start)
    while source.at < end and source.peek(1):
        unit = _Member(source)
        data = b""
        while b"\r\n\r\n" not in data:
            if not (more := unit.read(1024)):
                raise EOFError("a record has no end of headers")
            data += more
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        if not wanted(headers):
            unit.finish()
            continue
        payload = None
        if with_payload and headers.get("warc-type") != "revisit":
            parts = [rest]
            while more := unit.read(_READ):
                parts.append(more)
            block = b"".join(parts)[: int(headers["content-length"])]
            if headers.get("content-type", "").startswith("application/http"):
                block = block.partition(b"\r\n\r\n")[2]
            payload = block
        unit.finish()
        yield headers, payload


@dataclass
class _Piece(InputPartition):
    file: str
    start: int
    end: int

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


@dataclass
class _Written(WriterCommitMessage):
    file: str
    size: int
    records: int
    starts: list[int]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema):
        self.path, self.schema = options["path"], schema
        self.with_payload = options.get("payload", "true").lower() != "false" and "payload" in schema.fieldNames()
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith) and column not in _LONGS:
                self.tests.append((column, "prefix", f.value))
            else:
                yield f

    def partitions(self):
        system, root = _system(self.path)
        found = [x for x in system.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File]
        pieces = []
        for x in sorted(found, key=lambda x: x.path):
            if x.base_name.startswith("_manifest-"):
                folder = x.path.rpartition("/")[0]
                with system.open_input_stream(x.path) as f:
                    for told in json.loads(f.read()):
                        ends = [*told["starts"][1:], told["size"]]
                        pieces += [_Piece(f"{folder}/{told['file']}", a, b) for a, b in zip(told["starts"], ends)]
            elif x.base_name.endswith((".warc.gz", ".warc.gzip")) and not x.base_name.startswith(_OWN):
                pieces.append(_Piece(x.path, 0, x.size))
            elif x.base_name.endswith(".warc"):
                raise ValueError(f"{x.path}: archives are read with one gzip member per record, not plain")
        return pieces

    def value(self, column: str, headers: dict[str, str]):
        told = headers.get(HEADERS[column].lower())
        return told if told is None or column not in _LONGS else int(told)

    def wanted(self, headers: dict[str, str]) -> bool:
        for column, how, what in self.tests:
            value = self.value(column, headers)
            if value is None or (value not in what if how == "in" else not value.startswith(what)):
                return False
        return True

    def read(self, partition: _Piece):
        if partition is None:  # a folder without archives
            return
        system, _ = _system(self.path)
        names = self.schema.fieldNames()
        kinds = {n: pa.int64() if n in _LONGS else pa.binary() if n == "payload" else pa.string() for n in names}
        held, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kinds[n]) for k, n in enumerate(names)], names)

        with system.open_input_file(partition.file) as file:
            for headers, payload in read_records(file, partition.start, partition.end, self.wanted, self.with_payload):
                held.append([payload if n == "payload" else self.value(n, headers) for n in names])
                size += len(payload or b"") + 512
                if size > 4 << 20 or len(held) == 10_000:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        if overwrite:
            raise ValueError("a WARC folder can be appended to, not overwritten")
        self.path, self.chunk = options["path"], int(options.get("chunk", 16 << 20))

    def write(self, iterator):
        system, root = _system(self.path)
        system.create_dir(root, recursive=True)
        name = f"{_OWN}{uuid.uuid4().hex}.warc.gz"
        at, starts, n = 0, [], 0
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in slices(iterator, 64):
                columns = batch.to_pydict()
                for k in range(batch.num_rows):
                    row = {c: columns[c][k] for c in columns}
                    headers = {HEADERS[c]: None if row.get(c) is None else str(row[c]) for c in HEADERS}
                    packed = member(record(headers, row["payload"]))
                    if not starts or at - starts[-1] >= self.chunk:
                        starts.append(at)
                    out.write(packed)
                    at += len(packed)
                    n += 1
        return _Written(name, at, n, starts)

    def commit(self, messages):
        system, root = _system(self.path)
        system.create_dir(root, recursive=True)
        told = [{"file": m.file, "size": m.size, "starts": m.starts} for m in messages if m and m.records]
        with system.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(told).encode())

    def abort(self, messages):
        system, root = _system(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{root}/{m.file}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(pages: DataFrame, folder: str, least: int = 100) -> None:
    """Write a record per page. Payloads of `least` bytes or more are stored once; later ones revisit the first."""
    spark = pages.sparkSession
    register(spark)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    known = _store.materialise(rows.select("page_id", "sha", F.octet_length("payload").cast("long").alias("n")), "payloads")
    firsts = (
        known.filter(F.col("n") >= least).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1 AND first IS NOT NULL")
    )
    again = _store.materialise(
        known.join(firsts, ["sha", "n"]).filter(~F.col("page_id").eqNullSafe(F.col("first")))
        .select(F.col("page_id").alias("again_id"), F.col("sha").alias("again_sha"), "first").distinct(),
        "again",
    )
    # Few are broadcast, so no payload moves. Many: dealt by page and digest, so copies
    # spread; the hash join holds the small side and does not sort payloads.
    few = again.count() <= _BROADCAST_ROWS
    joined = rows.join(
        F.broadcast(again) if few else again.hint("shuffle_hash"),
        F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("sha") == F.col("again_sha")),
        "left",
    )
    named = lambda c: F.concat(F.lit("<urn:millrace:page:"), c.cast("string"), F.lit(">"))
    joined.select(
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.coalesce(named(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">"))).alias("record_id"),
        named(F.col("first")).alias("refers_to_id"),
        F.col("url").alias("target_uri"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("first").cast("long").alias("refers_to_page"),
        F.concat(F.lit("sha256:"), F.lower(F.hex("sha"))).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(F.col("first").isNull(), F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(folder)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages as WARC, read the archives back; a response's digest and length are taken anew from its payload."""
    folder = _store.fresh_path(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    back = spark.read.format("warc").load(folder)
    whole = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        F.col("refers_to_page").alias("refers_to"),
    )


QUERIES = {"op8_warc": op8_warc}
ORACLES = {
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, payload_bytes, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes = f.payload_bytes
"""
}
