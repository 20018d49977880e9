"""Every registered query against its oracle at the smallest scale; the stream; the package's borders."""

import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.config import EngineConfig
from millrace.operators import sinks
from millrace.plans import catalog
from millrace.streaming import ingest

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def compared(frame, oracle):
    columns = sorted(frame.columns)
    assert columns == sorted(d[0] for d in oracle.description)
    told = [d[0] for d in oracle.description]
    a = sorted(tuple(repr(r[c]) for c in columns) for r in frame.collect())
    b = sorted(tuple(repr(dict(zip(told, r))[c]) for c in columns) for r in oracle.fetchall())
    assert a == b


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, duck, name):
    compared(catalog.queries()[name](spark, SF), duck.execute(catalog.oracle_sql()[name]))


def test_stream_is_first_wins_across_batches_and_runs(spark, tmp_path):
    body = "<html lang='en'><body><p>" + "fossil dinosaur bone amber skull claw femur rock " * 20 + "{}</p></body></html>"
    rows = [(1, "http://a.org/1", body.format("x")), (2, "http://a.org/2", body.format("x")), (3, "http://a.org/3", body.format("y"))]
    schema = "seq long, url string, html string"
    land = str(tmp_path / "land")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(land)
    seeds = spark.createDataFrame([("a.org",)], "dominio string")
    for table in ("documentos", "errores"):
        spark.catalog.dropTempView(table)
        spark.sql(f"DROP TABLE IF EXISTS {table}")

    def run():
        q = ingest.start(ingest.landing(spark, land, schema), seeds, EngineConfig(), str(tmp_path / "cp"), str(tmp_path / "texts"))
        q.awaitTermination(120)

    run()
    assert sorted(r["url"] for r in spark.table("documentos").collect()) == ["http://a.org/1", "http://a.org/3"]
    more = [(4, "http://a.org/4", body.format("y")), (5, "http://a.org/1", body.format("z")), (6, "http://a.org/6", body.format("w"))]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(land)
    run()
    got = spark.table("documentos").orderBy("id").collect()
    assert [(r["id"], r["url"]) for r in got][-1] == (3, "http://a.org/6") and len(got) == 3
    assert spark.read.parquet(str(tmp_path / "texts")).count() >= 3
    sinks.insert_errors(spark, spark.createDataFrame([("http://a.org/9", "Timeout", "m", "t")], "url string, error_class string, motivo string, fecha string"))
    assert spark.table("errores").count() == 1
    for table in ("documentos", "errores"):
        spark.sql(f"DROP TABLE {table}")


def test_text_export(spark, tmp_path):
    saved = spark.createDataFrame([("h/ab/ab.txt", "uno"), ("h/cd/cd.txt", None)], "ruta_archivo string, texto string")
    assert sinks.export_text_files(saved, str(tmp_path)) == 2
    assert (tmp_path / "h/ab/ab.txt").read_text() == "uno" and (tmp_path / "h/cd/cd.txt").read_text() == ""


def test_nothing_outside_imports_the_training_data_operators():
    for f in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"millrace\.llm|corpus_pipeline", f.read_text()), f


def test_filters_and_columns_reach_the_scan(spark):
    plan = spark.read.parquet(f"{SF}/documents.parquet").filter(F.col("doc_id") < 10).select("lang")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,10)]" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
