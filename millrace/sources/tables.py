"""Schemas, tables in the shared folder, ad-hoc SQL and the catalog."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names and order of the metadata tables, which ad-hoc SQL relies on.
DOCUMENTS_SCHEMA = (
    "id long, url string, url_final string, dominio string, referer string, profundidad int, es_semilla int, "
    "dominio_semilla int, http_status int, content_type string, bytes_html long, last_modified string, etag string, "
    "fecha_descarga string, titulo string, idioma string, palabras int, bytes_texto long, hash_texto string, "
    "puntaje_tema int, densidad_tema double, ruta_archivo string"
)
ERRORS_SCHEMA = "id long, url string, dominio string, motivo string, fecha string"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of its own where a local master has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/millrace/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def create_tables(spark: SparkSession) -> None:
    """Create documentos and errores where they do not exist."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS documentos ({DOCUMENTS_SCHEMA}) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS errores ({ERRORS_SCHEMA}) USING parquet")


def stored(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """A table as it stands now, or an empty one of that schema where there is none yet."""
    try:
        return spark.table(table)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def seen_hashes(spark: SparkSession) -> DataFrame:
    return stored(spark, "documentos", DOCUMENTS_SCHEMA).select("hash_texto").filter("hash_texto IS NOT NULL").distinct()


def run_sql(spark: SparkSession, *words: str) -> tuple[DataFrame | None, str | None]:
    """Run the words, joined by spaces, as SQL: the result, or what is wrong with it."""
    try:
        return spark.sql(" ".join(words)), None
    except PySparkException as e:
        return None, str(e).splitlines()[0]


def catalog(spark: SparkSession) -> DataFrame:
    """One row per column of each table or view: tabla, columna, tipo, filas."""
    parts = []
    for t in sorted(spark.catalog.listTables(), key=lambda t: t.name):
        rows = spark.table(t.name).agg(F.count("*").alias("filas"))
        columns = [(t.name, c.name, c.dataType) for c in spark.catalog.listColumns(t.name)]
        parts.append(spark.createDataFrame(columns, "tabla string, columna string, tipo string").join(F.broadcast(rows)))
    out = parts[0] if parts else spark.createDataFrame([], "tabla string, columna string, tipo string, filas long")
    for p in parts[1:]:
        out = out.union(p)
    return out
