"""Policies as tables: for lists too large to be literals, by equi-joins instead of nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text


def suffixes(domain: Column) -> Column:
    """The domain and all domains above it: a.b.c, b.c, c."""
    parts = F.split(domain, "[.]")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))


def _flagged(rows: DataFrame, hits: DataFrame, key: str, flag: str) -> DataFrame:
    found = hits.select(F.col(key).alias("_hit")).distinct()
    return rows.join(found, F.col(key) == F.col("_hit"), "left").withColumn(flag, F.col("_hit").isNotNull()).drop("_hit")


def below_hosts(rows: DataFrame, hosts: DataFrame, flag: str, key: str = "dominio") -> DataFrame:
    """Add flag: whether the domain is one of hosts (host) or below one. Each domain is looked at once."""
    domains = rows.select(key).distinct().select(key, F.explode(suffixes(F.col(key))).alias("_suffix"))
    return _flagged(rows, domains.join(hosts.select(F.col("host").alias("_suffix")).distinct(), "_suffix"), key, flag)


def labels_with(rows: DataFrame, words: DataFrame, flag: str, longest: int, shortest: int = 1, key: str = "dominio") -> DataFrame:
    """Add flag: whether a label of the domain contains one of words (palabra), which have shortest to longest characters."""
    labels = rows.select(key).distinct().select(key, F.explode(F.array_distinct(F.split(key, "[.]"))).alias("_label"))
    starts = labels.filter(F.length("_label") >= shortest).select(
        key, "_label", F.explode(F.sequence(F.lit(1), F.length("_label") - shortest + 1)).alias("_from")
    )
    parts = starts.select(key, F.explode(F.sequence(F.lit(shortest), F.lit(longest))).alias("_n"), "_label", "_from").filter(
        F.col("_from") + F.col("_n") - 1 <= F.length("_label")
    )
    grams = parts.select(key, F.substring(F.col("_label"), F.col("_from"), F.col("_n")).alias("_gram")).distinct()
    return _flagged(rows, grams.join(words.select(F.col("palabra").alias("_gram")).distinct(), "_gram"), key, flag)


def topic_scores(docs: DataFrame, vocabulary: DataFrame, key: str, column: str) -> DataFrame:
    """key, puntaje and menciones of each row, for a vocabulary table (palabra, nucleo: 0 or 1). Rows without terms have 0.

    key must be unique. Terms are counted per row before they meet the vocabulary.
    """
    terms = docs.select(key, F.explode(text.topic_tokens(F.col(column))).alias("palabra")).groupBy(key, "palabra").agg(F.count("*").alias("_n"))
    known = vocabulary.groupBy("palabra").agg(F.max("nucleo").alias("nucleo"))
    scored = terms.join(known, "palabra").groupBy(F.col(key).alias("_k")).agg(
        (F.count("*") + F.sum("nucleo")).alias("puntaje"), F.sum("_n").alias("menciones")
    )
    return docs.select(key).join(scored, F.col(key) == F.col("_k"), "left").select(
        key, F.coalesce("puntaje", F.lit(0)).alias("puntaje"), F.coalesce("menciones", F.lit(0)).alias("menciones")
    )
