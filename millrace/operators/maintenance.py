"""Upkeep of a repository and of frontier queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import EngineConfig
from millrace.functions import urls


def _rejected(config: EngineConfig) -> Column:
    dom = F.coalesce("dominio", F.lit(""))
    return urls.is_vetoed(dom, config.policy) | urls.is_other_language(dom, config.policy)


def purge_candidates(documents: DataFrame, config: EngineConfig) -> DataFrame:
    """Documents whose domain the policy now rejects."""
    return documents.filter(_rejected(config))


def purge_report(candidates: DataFrame) -> DataFrame:
    """Candidates by domain, most first, ties in order of the domain."""
    by_domain = candidates.groupBy(F.coalesce("dominio", F.lit("")).alias("dominio")).agg(F.count("*").alias("docs"))
    return by_domain.orderBy(F.desc("docs"), "dominio")


def orphans(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files (ruta) that no document refers to. Those of documents about to be purged are still referred to."""
    used = documents.select(F.regexp_replace("ruta_archivo", r"\\", "/").alias("_used")).filter("_used IS NOT NULL")
    return files.withColumn("ruta", F.regexp_replace("ruta", r"\\", "/")).join(used, F.col("ruta") == F.col("_used"), "left_anti")


def present(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents whose file exists."""
    return documents.join(files.select(F.col("ruta").alias("_f")), F.col("ruta_archivo") == F.col("_f"), "left_semi")


def purged(documents: DataFrame, config: EngineConfig) -> DataFrame:
    """Documents that stay. Write them to a new path and swap: never over the table being read."""
    return documents.filter(~_rejected(config))


def queue_totals(decoded: DataFrame) -> DataFrame:
    """Records of each slot and priority, the last chunk and its useful bytes, and how many chunks were cut short."""
    return (
        decoded.filter("valid")
        .groupBy("slot", "suffix", "prioridad")
        .agg(
            F.sum("registros").alias("registros"),
            F.max("chunk").alias("ultimo"),
            F.max_by("utiles", "chunk").alias("utiles_ultimo"),
            F.sum(F.col("truncado").cast("int")).alias("truncados"),
        )
    )


def queue_indexes(totals: DataFrame, chunk_size: int = 100_000) -> DataFrame:
    """Index of each queue as JSON: nothing is read yet, and writing goes on after the last record."""
    number = F.regexp_replace("ultimo", "^q", "").cast("int")
    return totals.filter("registros > 0").select(
        "slot",
        "prioridad",
        F.to_json(
            F.struct(
                F.lit(chunk_size).alias("chunksize"),
                F.col("registros").alias("size"),
                F.array(F.lit(0), F.lit(0), F.lit(0)).alias("tail"),
                F.array(number.cast("bigint"), F.col("registros") % chunk_size).alias("head"),
            )
        ).alias("info"),
    )


def active_slots(totals: DataFrame) -> DataFrame:
    """One JSON object: the priorities of each slot that has records, in order."""
    by_slot = totals.filter("registros > 0").groupBy("slot").agg(F.array_sort(F.collect_set("prioridad")).alias("p"))
    return by_slot.agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "p"))))).alias("active")
    )
