"""Sinks: texts, metadata, statistics files and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import corpus_stats, metadata
from millrace.sources import tables

_COLUMNS = [part.split()[0] for part in tables.DOCUMENTS_SCHEMA.split(", ")]


def write_texts(saved: DataFrame, folder: str) -> None:
    """Texts of saved documents as Parquet by the first two digits of their hash; the domain is a column to prune by."""
    saved.select("dominio", "hash_texto", "texto", F.substring("hash_texto", 1, 2).alias("hash_prefix")).write.mode(
        "append"
    ).partitionBy("hash_prefix").parquet(folder)


def export_text_files(saved: DataFrame, folder: str) -> int:
    """Each text as a file at its ruta_archivo, written by the executors through their file systems; how many."""
    import pyarrow.fs as pafs

    def write(batches):
        import pyarrow as pa

        system, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for path, text in zip(batch.column("ruta_archivo").to_pylist(), batch.column("texto").to_pylist()):
                system.create_dir(f"{root}/{path.rpartition('/')[0]}", recursive=True)
                with system.open_output_stream(f"{root}/{path}", compression=None) as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return saved.select("ruta_archivo", "texto").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def insert_documents(spark: SparkSession, saved: DataFrame) -> int:
    """Add saved documents to the table documentos unless their url is there; ids go on from the last. How many."""
    tables.create_tables(spark)
    stored = spark.table("documentos")
    last = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = tables.materialise(
        metadata.numbered(metadata.inserted(saved, stored).drop("texto"), last).select(*_COLUMNS), "insert"
    )
    rows.write.mode("append").insertInto("documentos")
    spark.catalog.refreshTable("documentos")  # the rows may be of another session, as in a stream's batches
    return rows.count()


def insert_errors(spark: SparkSession, failures: DataFrame) -> None:
    """Append failures (url, error_class, motivo, fecha) to the table errores, without policy rejections."""
    tables.create_tables(spark)
    start = spark.table("errores").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    metadata.real_failures(failures).select(
        (F.monotonically_increasing_id() + start + 1).alias("id"), "url", "dominio", "motivo", "fecha"
    ).write.mode("append").insertInto("errores")
    spark.catalog.refreshTable("errores")


def write_frequencies(frequencies: DataFrame, folder: str) -> None:
    """Vocabulary by falling frequency, and by rank, as CSV with headers: frecuencias and zipf."""
    ordered = frequencies.orderBy(F.desc("frecuencia"), "palabra").select("palabra", "frecuencia")
    ordered.write.mode("overwrite").option("header", True).csv(f"{folder}/frecuencias")
    corpus_stats.zipf(frequencies).select("rango", "palabra", "frecuencia").orderBy("rango").write.mode("overwrite").option(
        "header", True
    ).csv(f"{folder}/zipf")


def rewrite(rows: DataFrame, folder: str) -> None:
    """Replace a Parquet folder by rows that may have been read from it: written beside it, then swapped in."""
    spark = rows.sparkSession
    fresh, old = f"{folder}.fresh-{uuid.uuid4().hex}", f"{folder}.old-{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    system = at(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.rename(at(folder), at(old))
    system.rename(at(fresh), at(folder))
    system.delete(at(old), True)


def report(docs: DataFrame, label: str, column: str = "text", domain: str = "source") -> str:
    """Summary, commonest words and domains, and words that occur once, as text."""
    words = corpus_stats.word_frequencies(docs, column)
    s = corpus_stats.summary(docs, column, domain).first()
    once = corpus_stats.hapax(words).first()
    lines = [
        f"Corpus {label}",
        f"texto: {s['bytes_texto']:,} bytes = {s['mb']:.2f} MB = {s['gb']:.3f} GB; en disco {s['bytes_disco']:,} bytes",
        f"documentos: {s['docs']:,}; palabras: {s['palabras']:,}; distintas: {s['palabras_distintas']:,}; dominios: {s['dominios']:,}",
        f"hapax: {once['hapax']:,} ({once['porcentaje'] or 0:.1f} %)",
        *[f"{r['palabra']}: {r['frecuencia']:,} ({r['porcentaje']:.2f} %)" for r in corpus_stats.top_words(words).collect()],
        *[f"{r['dominio']}: {r['docs']:,} ({r['porcentaje']:.1f} %)" for r in corpus_stats.top_domains(docs, domain).collect()],
    ]
    return "\n".join(lines) + "\n"


def plot_zipf(frequencies: DataFrame, path: str, points: int = 5000) -> bool:
    """Log-log plot of the `points` commonest words and the ideal curve; False without a plotting library."""
    try:
        from matplotlib import pyplot
    except ImportError:
        print("no plotting library: the curve's data are in zipf()")
        return False
    rows = corpus_stats.zipf(frequencies).filter(F.col("rango") <= points).orderBy("rango").collect()
    _, (linear, log) = pyplot.subplots(1, 2)
    for axes, draw in ((linear, "plot"), (log, "loglog")):
        getattr(axes, draw)([r["rango"] for r in rows], [r["frecuencia"] for r in rows])
        getattr(axes, draw)([r["rango"] for r in rows], [r["zipf_ideal"] for r in rows], "--")
    pyplot.savefig(path)
    return True
