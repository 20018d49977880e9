"""Reports over the metadata tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text


def registered(documents: DataFrame, errors: DataFrame) -> None:
    """Make the tables known to SQL as documentos and errores."""
    documents.createOrReplaceTempView("documentos")
    errors.createOrReplaceTempView("errores")


def totals(documents: DataFrame) -> DataFrame:
    """Documents, words and bytes; sums of no rows are 0."""
    return documents.agg(
        F.count("*").alias("docs"),
        F.coalesce(F.sum("palabras"), F.lit(0)).alias("palabras"),
        F.coalesce(F.sum("bytes_texto"), F.lit(0)).alias("bytes_texto"),
    )


def summary(documents: DataFrame) -> DataFrame:
    size = F.sum("bytes_texto")
    return documents.agg(
        F.count("*").alias("docs"),
        F.sum("palabras").alias("palabras"),
        F.round(text.mebibytes(size), 2).alias("mb"),
        F.round(text.gibibytes(size), 3).alias("gb"),
    )


def _by_domain(documents: DataFrame, *more) -> DataFrame:
    return documents.groupBy("dominio").agg(
        F.count("*").alias("docs"), *more, F.round(F.avg("densidad_tema"), 1).alias("densidad_prom")
    )


def by_domain(documents: DataFrame, k: int = 20) -> DataFrame:
    """Ties go to the lesser domain."""
    return _by_domain(documents, F.sum("palabras").alias("palabras")).orderBy(F.desc("docs"), "dominio").limit(k)


def by_depth(documents: DataFrame) -> DataFrame:
    return documents.groupBy("profundidad").agg(
        F.count("*").alias("docs"),
        F.round(F.avg("palabras")).alias("palabras_prom"),
        F.round(F.avg("densidad_tema"), 1).alias("densidad_prom"),
    ).orderBy("profundidad")


def new_domains(documents: DataFrame, k: int = 15) -> DataFrame:
    return _by_domain(documents.filter("dominio_semilla = 0")).orderBy(F.desc("docs"), "dominio").limit(k)


def densest(documents: DataFrame, k: int = 10) -> DataFrame:
    return (
        documents.orderBy(F.desc("densidad_tema"), "id").limit(k)
        .select(F.round("densidad_tema", 1).alias("densidad"), "palabras", text.cut(F.col("titulo"), 55).alias("titulo"))
    )


def failures(errors: DataFrame, k: int = 10) -> DataFrame:
    return (
        errors.groupBy("dominio").agg(F.count("*").alias("fallos"), F.max("fecha").alias("ultimo"))
        .orderBy(F.desc("fallos"), "dominio").limit(k)
    )


def real_failures(failures_: DataFrame) -> DataFrame:
    """Failed requests (url, error_class, motivo, fecha) as rows of errores; policy rejections are no errors, a null class is one."""
    from millrace.functions import urls

    return failures_.filter(~F.col("error_class").eqNullSafe("IgnoreRequest")).select(
        "url", urls.domain(F.col("url")).alias("dominio"), text.cut(F.col("motivo"), 300).alias("motivo"), "fecha"
    )


def distinct_domains(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count_distinct("dominio").alias("dominios"))


def latest(documents: DataFrame) -> DataFrame:
    """Time and domain of the row with the greatest id; marks where there is none."""
    last = documents.agg(F.max_by(F.struct("fecha_descarga", "dominio"), "id").alias("x"))
    return last.select(
        F.coalesce(F.substring("x.fecha_descarga", 12, 8), F.lit("--:--:--")).alias("hora"),
        F.coalesce("x.dominio", F.lit("-")).alias("dominio"),
    )


def snapshot(documents: DataFrame, errors: DataFrame) -> DataFrame:
    """What a monitor shows: totals, domains, errors, and the last document's time and domain. Reads one version of each table."""
    return (
        totals(documents)
        .join(F.broadcast(distinct_domains(documents)))
        .join(F.broadcast(row_count(errors).withColumnRenamed("filas", "errores")))
        .join(F.broadcast(latest(documents)))
    )


def depth_histogram(documents: DataFrame) -> DataFrame:
    return documents.groupBy("profundidad").agg(F.count("*").alias("docs")).orderBy("profundidad")


def seed_origin(documents: DataFrame) -> DataFrame:
    return documents.groupBy("dominio_semilla").agg(F.count("*").alias("docs")).orderBy("dominio_semilla")


def row_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("filas"))


def numbered(documents: DataFrame, start: int = 0) -> DataFrame:
    """Add id in order of seq. Ids are global, so the last step is one task on a narrow table: for a batch of new rows."""
    return documents.withColumn("id", F.lit(start) + F.row_number().over(Window.orderBy("seq")))


def inserted(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of new that inserting would add: the first of each url by seq, unless stored has the url."""
    first = F.row_number().over(Window.partitionBy("url").orderBy("seq"))
    return (
        new.withColumn("_k", first).filter("_k = 1").drop("_k")
        .join(stored.select(F.col("url").alias("_old")), F.col("url") == F.col("_old"), "left_anti")
    )
