import re

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import _store, mixing, pieces, quality
from tests.llm import edge
from tests.llm.test_simhash import fingerprint

SF = "/root/testdata/sf0.001"


def test_run_as_brute_force(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).filter("kept").collect()}
    norm = lambda d: re.sub(r"[\x20\x09-\x0D]", "", docs[d]["text"])
    best = {}
    for d in sorted(kept, key=lambda d: (-len(docs[d]["text"]), d)):
        best.setdefault(norm(d), d)
    left = sorted(best.values())
    root = edge.roots(left, lambda a, b: (fingerprint(docs[a]["text"]) ^ fingerprint(docs[b]["text"])).bit_count() <= 3)
    left = sorted(set(root.values()))
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == left
    assert all(got[d]["ids"] == library.encode(docs[d]["text"]) and got[d]["source"] == docs[d]["source"] and got[d]["round_trip"] for d in left)


def test_stages_and_the_order_of_the_mix(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "source_mixing", "sentencepiece"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    laid = _store.materialise(corpus_pipeline.mix(spark, docs, SF), "laid")
    want = [r["doc_id"] for r in mixing.mix(docs).orderBy("position").collect()]
    names = laid.select("doc_id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("k")).orderBy("f", "k")
    assert [r["doc_id"] for r in names.collect()] == want


def in_files(table):
    place = F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("k"))
    return table.select("doc_id", place.alias("place")).orderBy("place").collect()


def test_tokens_of_several_files_keep_the_order_of_the_mix(spark, monkeypatch):
    made = {}
    keep = lambda df, label: made.setdefault(label, materialise(df, label))
    materialise = _store.materialise
    monkeypatch.setattr(corpus_pipeline._store, "materialise", keep)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    laid, got = in_files(made["pipeline-source_mixing"]), in_files(out)
    assert len({r["place"]["f"] for r in laid}) > 1 and len({r["place"]["f"] for r in got}) > 1
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in laid]
    before = made["pipeline-simhash_near_dedup"]
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in mixing.mix(before).orderBy("position").collect()]


def test_awkward_documents_pass_all_stages(spark):
    docs, _ = edge.documents(spark)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = _store.materialise(stage(spark, docs, SF), name)
        assert docs.columns == columns or k == 4
    assert docs.columns == ["doc_id", "source", "n_ids", "ids", "round_trip"] and docs.count() > 0


def test_an_empty_table_passes_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = _store.materialise(stage(spark, docs, SF), name)
    assert docs.count() == 0
