"""Corpus pipeline: quality rules, exact dedup, near-dedup, mixing, token ids.

Each stage takes all that the stage before it kept, from Parquet in the shared
folder. All but the last return the columns of documents:

1. quality: documents that the quality rules reject go;
2. exact dedup: of equal texts, one row stays;
3. near-dedup: of each SimHash component, one document stays;
4. mix: documents are laid out in the order of the mix to target weights; the
   stage drops and repeats none;
5. tokens: doc_id, source, n_ids, ids and round_trip, laid out in the order of
   the mix again.

The order of a laid-out table is that of its part files' numbers, and of the
rows in a file. Spark's scan deals files by length and so reads them in another
order; in_order() puts rows back, and any consecutive files are a stretch of the
mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _store, exact_dedup, mixing, pieces, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def in_order(laid: DataFrame, *columns: str) -> DataFrame:
    """Columns of a table read from files, in the order in which they were written: partitions in order, and rows in order within them."""
    name = F.col("_metadata.file_name")
    places = {"_part": F.regexp_extract(name, r"^part-(\d+)", 1).cast("bigint"), "_file": name, "_at": F.col("_metadata.row_index")}
    rows = laid.select(*columns, *[place.alias(k) for k, place in places.items()])
    return rows.repartitionByRange(*places).sortWithinPartitions(*places).select(*columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(in_order(docs, "doc_id", "source", "text"), keep=("doc_id", "source"), lasting=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("source_mixing", mix),
    ("sentencepiece", tokens),
]

#: SQL cannot express the vote model, SimHash components or token ids; tests
#: compare run() with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _store.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
