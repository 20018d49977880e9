"""File sources: seed lists, pages, text repositories, frontier queue logs."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text, urls

_QUEUE = r"([^/]+)/(-?\d+)/(q\d+)$"


def seed_lines(lines: DataFrame) -> DataFrame:
    """url and domain of a seed list's lines (column value): not blank, and the raw line does not begin with #."""
    kept = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return kept.select(F.trim("value").alias("url")).withColumn("dominio", urls.domain(F.col("url")))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    return seed_lines(spark.read.text(path))


def seed_requests(found: DataFrame, priority: int) -> DataFrame:
    """Level 0 of the frontier: seeds pass by the test of URLs seen before."""
    return found.select(
        "url", "dominio", F.lit(0).alias("profundidad"), F.lit(priority).alias("prioridad"), F.lit(1).alias("es_semilla")
    )


def pages(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Fetched pages, without those over `most` bytes."""
    found = spark.read.parquet(path)
    return found if most is None else found.filter(F.octet_length("html") <= most)


def corpus_files(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of a repository: path, dominio (two folders up), length, text. Bytes that are no UTF-8 are replaced.

    Empty files do not appear: Spark's file sources skip them.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder)
    )
    return found.select(
        "path",
        F.element_at(F.split("path", "/"), -3).alias("dominio"),
        "length",
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )


def queue_files(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of frontier queues: path, slot, suffix, prioridad, chunk, content, and whether the slot's MD5 is its suffix."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    named = found.withColumn("_slot", F.regexp_extract("path", _QUEUE, 1)).filter("_slot != ''")
    slot, suffix = F.regexp_extract("_slot", "^(.*)-([^-]*)$", 1), F.regexp_extract("_slot", "^(.*)-([^-]*)$", 2)
    return named.select(
        "path",
        slot.alias("slot"),
        suffix.alias("suffix"),
        F.regexp_extract("path", _QUEUE, 2).cast("int").alias("prioridad"),
        F.regexp_extract("path", _QUEUE, 3).alias("chunk"),
        "content",
        (F.md5(slot.cast("binary")) == suffix).alias("valid"),
    )


def complete_records(data: bytes) -> tuple[int, int]:
    """Records with a big-endian length before them that are whole, and the bytes they take."""
    n = at = 0
    while at + 4 <= len(data):
        end = at + 4 + struct.unpack_from(">L", data, at)[0]
        if end > len(data):
            break
        n, at = n + 1, end
    return n, at


def decoded_queues(files: DataFrame) -> DataFrame:
    """queue_files() with registros and utiles (bytes of whole records) in place of content, and truncado."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [complete_records(x or b"") for x in batch.column("content").to_pylist()]
            size = [len(x or b"") for x in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("path", "slot", "suffix", "prioridad", "chunk", "valid")],
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([b for _, b in found], pa.int64()),
                    pa.array([b < s for (_, b), s in zip(found, size)]),
                ],
                ["path", "slot", "suffix", "prioridad", "chunk", "valid", "registros", "utiles", "truncado"],
            )

    return files.select("path", "slot", "suffix", "prioridad", "chunk", "valid", "content").mapInArrow(
        batches,
        "path string, slot string, suffix string, prioridad int, chunk string, valid boolean, registros long, utiles long, truncado boolean",
    )


def line_count(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).agg(F.count("*").alias("lineas"))


def repository_stats(files: DataFrame) -> DataFrame:
    """Files, bytes and bytes on disk."""
    return files.agg(
        F.count("*").alias("docs"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_texto"),
        F.coalesce(F.sum(text.disk_bytes(F.col("length"))), F.lit(0)).alias("bytes_disco"),
    )


def arrival(df: DataFrame, *order: str) -> DataFrame:
    """Add seq, the place of each row in an order that the caller makes unique. One task: for small tables."""
    return df.withColumn("seq", F.row_number().over(Window.orderBy(*order)))
