"""Corpus statistics: word frequencies, ranks, Zipf's curve, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text


def word_frequencies(docs: DataFrame, column: str = "text") -> DataFrame:
    return docs.select(F.explode(text.stats_tokens(F.col(column))).alias("palabra")).groupBy("palabra").agg(
        F.count("*").alias("frecuencia")
    )


def ranked(frequencies: DataFrame) -> DataFrame:
    """Add rango: 1 for the commonest word, ties in order of the word; no rank is used twice.

    Ranks are found in pieces and not by one global sort: the words of one frequency
    that begin alike are numbered among themselves, after running sums over the
    beginnings of its words and over the distinct frequencies. Words that occur once,
    almost half of a vocabulary, are so many pieces.
    """
    cut = frequencies.withColumn("_lead", F.left("palabra", F.lit(3)))
    sizes = cut.groupBy("frecuencia", "_lead").agg(F.count("*").alias("_n"))
    earlier = Window.unboundedPreceding, -1
    leads = sizes.withColumn("_inner", F.sum("_n").over(Window.partitionBy("frecuencia").orderBy("_lead").rowsBetween(*earlier)))
    whole = sizes.groupBy("frecuencia").agg(F.sum("_n").alias("_m"))
    starts = whole.select("frecuencia", F.sum("_m").over(Window.orderBy(F.desc("frecuencia")).rowsBetween(*earlier)).alias("_outer"))
    pieces = leads.join(starts, "frecuencia").select(
        "frecuencia", "_lead", (F.coalesce("_inner", F.lit(0)) + F.coalesce("_outer", F.lit(0))).alias("_start")
    )
    within = F.row_number().over(Window.partitionBy("frecuencia", "_lead").orderBy("palabra"))
    return (
        cut.withColumn("_k", within).join(pieces, ["frecuencia", "_lead"])
        .select((F.col("_start") + F.col("_k")).alias("rango"), "palabra", "frecuencia")
    )


def zipf(frequencies: DataFrame) -> DataFrame:
    """ranked() and zipf_ideal: the commonest word's frequency over the rank."""
    top = frequencies.agg(F.max("frecuencia").cast("double").alias("_top"))
    return ranked(frequencies).join(F.broadcast(top)).select(
        "rango", "palabra", "frecuencia", (F.col("_top") / F.col("rango")).alias("zipf_ideal")
    )


def top_words(frequencies: DataFrame, k: int = 30) -> DataFrame:
    total = frequencies.agg(F.sum("frecuencia").alias("_total"))
    return (
        frequencies.orderBy(F.desc("frecuencia"), "palabra").limit(k).join(F.broadcast(total))
        .select("palabra", "frecuencia", F.round(100.0 * F.col("frecuencia") / F.col("_total"), 2).alias("porcentaje"))
    )


def top_domains(docs: DataFrame, domain: str = "source", k: int = 15) -> DataFrame:
    total = docs.agg(F.count("*").alias("_total"))
    return (
        docs.groupBy(F.col(domain).alias("dominio")).agg(F.count("*").alias("docs"))
        .orderBy(F.desc("docs"), "dominio").limit(k).join(F.broadcast(total))
        .select("dominio", "docs", F.round(100.0 * F.col("docs") / F.col("_total"), 1).alias("porcentaje"))
    )


def hapax(frequencies: DataFrame) -> DataFrame:
    """Words that occur once, the vocabulary, and their share in percent."""
    return frequencies.agg(
        F.count_if(F.col("frecuencia") == 1).alias("hapax"), F.count("*").alias("vocabulario")
    ).withColumn("porcentaje", F.round(100.0 * F.try_divide("hapax", "vocabulario"), 1))


def summary(docs: DataFrame, column: str = "text", domain: str = "source") -> DataFrame:
    """One row of totals and ratios; ratios are null where there is nothing to divide by."""
    tokens = F.size(text.stats_tokens(F.col(column)))
    whole = docs.agg(
        F.count("*").alias("docs"),
        F.coalesce(F.sum(F.octet_length(F.coalesce(column, F.lit("")))), F.lit(0)).cast("bigint").alias("bytes_texto"),
        F.coalesce(F.sum(text.disk_bytes(F.octet_length(F.coalesce(column, F.lit(""))))), F.lit(0)).cast("bigint").alias("bytes_disco"),
        F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("palabras"),
        F.count_distinct(domain).alias("dominios"),
    )
    kinds = word_frequencies(docs, column).agg(F.count("*").alias("palabras_distintas"))
    return whole.join(F.broadcast(kinds)).withColumns(
        {
            "mb": F.round(text.mebibytes(F.col("bytes_texto")), 2),
            "gb": F.round(text.gibibytes(F.col("bytes_texto")), 3),
            "palabras_por_doc": F.round(F.try_divide("palabras", "docs")),
            "kb_por_doc": F.round(F.try_divide(F.col("bytes_texto") / F.lit(1024.0), F.col("docs")), 1),
            "riqueza": F.round(F.try_divide("palabras_distintas", "palabras"), 4),
        }
    )
