"""Event lines of a run, and stages that follow one another."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text


def document_line() -> Column:
    """What identifies a document, never its text."""
    return F.format_string(
        "%s | %d palabras | dens %s | %s",
        F.coalesce("dominio", F.lit("-")),
        F.coalesce("palabras", F.lit(0)),
        F.coalesce("densidad_tema", F.lit(0.0)).cast("string"),
        text.cut(F.coalesce(F.nullif("url_final", F.lit("")), F.nullif("url", F.lit("")), F.lit("-")), 160),
    )


def visits(documents: DataFrame) -> DataFrame:
    """One line per page read."""
    return documents.select(
        F.lit("VISITA").alias("evento"),
        F.format_string(
            "d=%d dom=%s status=%d bytes=%d url=%s ref=%s",
            "profundidad", "dominio", "http_status", "bytes_html", "url_final", F.coalesce(F.nullif("referer", F.lit("")), F.lit("-")),
        ).alias("linea"),
    )


def outcomes(judged: DataFrame) -> DataFrame:
    """One line per document: saved, or dropped and why (motivo)."""
    kept = F.col("motivo").isNull()
    return judged.select(
        F.when(kept, "GUARDADO").otherwise("DESCARTE").alias("evento"),
        F.when(kept, document_line()).otherwise(text.cut(F.concat(F.col("motivo"), F.lit(": "), F.col("url")), 220)).alias("linea"),
    )


def failures(errors: DataFrame) -> DataFrame:
    return errors.select(F.lit("FALLO").alias("evento"), F.concat_ws(" ", text.cut(F.col("url"), 120), "motivo").alias("linea"))


def run_stages(frame: DataFrame, stages: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """frame through the stages in order; stages are functions from DataFrame to DataFrame."""
    for stage in stages:
        frame = frame.transform(stage)
    return frame
