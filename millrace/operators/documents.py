"""From pages to documents: assembly, scoring, the filter funnel and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.config import EngineConfig
from millrace.functions import html, text, urls

#: Reasons a document is dropped for, in the order they are tested.
REASONS = ("idioma", "longitud", "tema", "densidad", "duplicado")


def with_features(df: DataFrame, config: EngineConfig, texto: str = "texto", declared: str | None = "idioma") -> DataFrame:
    """Add palabras, bytes_texto, hash_texto, puntaje_tema, densidad_tema and idioma of a text column.

    Tokens are made once per row and shared by the three that need them.
    """
    t, tokens = F.col(texto), F.col("_tokens")
    return (
        df.withColumn("_tokens", text.topic_tokens(t))
        .withColumns(
            {
                "palabras": text.word_count(t),
                "bytes_texto": text.byte_length(F.coalesce(t, F.lit(""))),
                "hash_texto": text.sha256(F.coalesce(t, F.lit(""))),
                "puntaje_tema": text.topic_score(tokens, config.policy),
                "densidad_tema": text.topic_density(tokens, config.policy),
                "idioma": text.language(F.col(declared) if declared else F.lit(None).cast("string"), tokens, config),
            }
        )
        .drop("_tokens")
    )


def drop_reason(config: EngineConfig):
    """The first test that a scored document fails, or null."""
    return (
        F.when(~F.col("idioma").isin(*config.languages), REASONS[0])
        .when(F.col("palabras") < config.min_words, REASONS[1])
        .when(F.col("puntaje_tema") < config.min_topic_score, REASONS[2])
        .when(F.col("densidad_tema") < config.min_topic_density, REASONS[3])
    )


def funnel(scored: DataFrame, config: EngineConfig, seen: DataFrame | None = None, order: str = "seq") -> DataFrame:
    """Add motivo: why the row is dropped, null if it is saved.

    Of rows that pass all tests, the first of each hash in `order` is saved, unless
    its hash is in `seen` (hash_texto): copies before it that failed do not count.
    """
    judged = scored.withColumn("motivo", drop_reason(config))
    if seen is not None:
        known = seen.select(F.col("hash_texto").alias("_seen")).distinct()
        judged = judged.join(known, F.col("hash_texto") == F.col("_seen"), "left")
    else:
        judged = judged.withColumn("_seen", F.lit(None).cast("string"))
    # Only rows that pass meet at their hash; each of the others keeps to itself.
    alone = F.when(F.col("motivo").isNull(), F.lit(0)).otherwise(F.xxhash64(order))
    first = F.row_number().over(Window.partitionBy("hash_texto", alone).orderBy(order))
    return (
        judged.withColumn("_first", first)
        .withColumn(
            "motivo",
            F.when(F.col("motivo").isNull() & ((F.col("_first") > 1) | F.col("_seen").isNotNull()), REASONS[4]).otherwise(
                F.col("motivo")
            ),
        )
        .drop("_first", "_seen")
    )


def saved(judged: DataFrame) -> DataFrame:
    return judged.filter("motivo IS NULL").drop("motivo")


def funnel_counts(judged: DataFrame) -> DataFrame:
    """Rows, words and bytes by reason; saved rows are `guardado`."""
    return judged.groupBy(F.coalesce("motivo", F.lit("guardado")).alias("motivo")).agg(
        F.count("*").alias("docs"), F.sum("palabras").alias("palabras"), F.sum("bytes_texto").alias("bytes_texto")
    )


def first_wins(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The first row of each key in order; null keys are one key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def assembled(pages: DataFrame, seed_domains: DataFrame, config: EngineConfig) -> DataFrame:
    """Documents of pages, with text and features, before the funnel.

    pages: seq, url, html and, where known, url_final, profundidad, es_semilla,
    http_status, content_type, last_modified, etag, referer, fecha_descarga.
    seed_domains: dominio, one row per seed domain.
    """
    given = set(pages.columns)
    told = lambda name, other: F.coalesce(F.col(name), other) if name in given else other
    empty, p = F.lit(""), config.policy
    final = told("url_final", F.col("url"))
    rows = pages.select(
        "seq",
        "url",
        final.alias("url_final"),
        urls.domain(final).alias("dominio"),
        told("referer", empty).alias("referer"),
        told("profundidad", F.lit(0)).cast("int").alias("profundidad"),
        told("es_semilla", F.lit(0)).cast("int").alias("es_semilla"),
        told("http_status", F.lit(200)).cast("int").alias("http_status"),
        told("content_type", F.lit("text/html")).alias("content_type"),
        text.byte_length(F.coalesce("html", empty)).alias("bytes_html"),
        told("last_modified", empty).alias("last_modified"),
        told("etag", empty).alias("etag"),
        told("fecha_descarga", empty).alias("fecha_descarga"),
        html.title(F.col("html")).alias("titulo"),
        html.declared_language(F.col("html")).alias("idioma"),
        html.main_text(F.col("html"), p).alias("texto"),
    )
    known = seed_domains.select(F.col("dominio").alias("_seed")).distinct()
    rows = rows.join(known, F.col("dominio") == F.col("_seed"), "left").withColumn(
        "dominio_semilla", F.col("_seed").isNotNull().cast("int")
    )
    return with_features(rows.drop("_seed"), config).withColumn(
        "ruta_archivo", text.storage_path(F.col("dominio"), F.col("hash_texto"))
    )


def content_type_reason(header: str, config: EngineConfig):
    """Why a response is dropped by its type, or null; an empty type passes."""
    kind = text.content_type(F.coalesce(F.col(header), F.lit("")))
    fits = kind == ""
    for accepted in config.policy.content_types:
        fits = fits | kind.startswith(accepted)
    return F.when(~fits, F.concat(F.lit("tipo_descartado/"), kind))
