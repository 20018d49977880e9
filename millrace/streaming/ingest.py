"""Incremental ingestion: the document funnel as a streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.config import EngineConfig
from millrace.operators import documents, sinks
from millrace.sources import tables


def landing(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Pages as they land in a folder; files_per_batch sets how much one commit holds."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def start(pages: DataFrame, seed_domains: DataFrame, config: EngineConfig, checkpoint: str, texts: str) -> StreamingQuery:
    """Run pages through the funnel, batch by batch, into the table documentos and the folder of texts.

    State is in the tables alone: hashes and URLs stored by earlier batches, and by
    earlier runs, are left out by anti-joins, so the first copy wins across runs. A
    batch that is repeated after a failure finds its own URLs stored and adds none.
    The query stops once the goal of stored bytes is reached; it can be started
    again from its checkpoint with a higher goal.
    """
    spark = pages.sparkSession
    tables.create_tables(spark)
    goal = int(config.goal_gib * 1073741824)
    running: list[StreamingQuery] = []

    def batch(rows: DataFrame, number: int) -> None:
        stored = spark.table("documentos").agg(F.coalesce(F.sum("bytes_texto"), F.lit(0))).first()[0]
        if goal and stored >= goal:
            if running:
                running[0].stop()
            return
        found = documents.assembled(rows, seed_domains, config)
        judged = documents.funnel(found, config, tables.seen_hashes(spark))
        kept = tables.materialise(documents.saved(judged), "batch")
        sinks.write_texts(kept, texts)
        sinks.insert_documents(spark, kept)

    query = pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
    running.append(query)
    return query


def deduplicated(pages: DataFrame, key: str = "hash_texto") -> DataFrame:
    """Streaming rows with each key once. The state holds every key ever seen: start() keeps them in a table instead."""
    return pages.dropDuplicates([key])


def counts_by_domain(pages: DataFrame) -> DataFrame:
    """Running page count of each domain (output mode update or complete)."""
    return pages.groupBy("dominio").agg(F.count("*").alias("paginas"))
