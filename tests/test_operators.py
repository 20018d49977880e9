"""Funnel, frontier, metadata, statistics, maintenance and progress on small literal tables."""

import hashlib
import struct

from pyspark.sql import functions as F

from millrace.config import EngineConfig
from millrace.operators import corpus_stats, documents, events, frontier, maintenance, metadata, progress, sinks
from millrace.sources import files, tables

C = EngineConfig()
SCORED = "seq long, hash_texto string, idioma string, palabras int, puntaje_tema int, densidad_tema double, bytes_texto long"


def test_funnel_thresholds_and_first_wins(spark):
    rows = [
        (1, "a", "xx", 500, 9, 50.0, 10), (2, "b", "en", 119, 9, 50.0, 10), (3, "c", "en", 120, 5, 50.0, 10),
        (4, "d", "en", 120, 6, 19.99, 10), (5, "e", "en", 120, 6, 20.0, 10), (6, "e", "en", 120, 6, 20.0, 10),
        (7, "e", "xx", 120, 6, 20.0, 10), (8, "f", "en", 120, 6, 20.0, 10), (9, "a", "en", 120, 6, 20.0, 10),
    ]
    seen = spark.createDataFrame([("f",)], "hash_texto string")
    judged = documents.funnel(spark.createDataFrame(rows, SCORED), C, seen)
    got = {r["seq"]: r["motivo"] for r in judged.collect()}
    assert got == {1: "idioma", 2: "longitud", 3: "tema", 4: "densidad", 5: None, 6: "duplicado", 7: "idioma", 8: "duplicado", 9: None}
    assert sum(r["docs"] for r in documents.funnel_counts(judged).collect()) == len(rows)
    assert {r["seq"] for r in documents.saved(judged).collect()} == {5, 9}


def test_insert_or_ignore_keeps_the_first_url(spark):
    new = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v"), (4, "w")], "seq long, url string")
    stored = spark.createDataFrame([("v",)], "url string")
    assert sorted((r["seq"], r["url"]) for r in metadata.inserted(new, stored).collect()) == [(1, "u"), (4, "w")]


def test_link_decisions(spark):
    links = [
        ("https://seed.org/any", "", 1), ("https://seed.org/any2", "", 0), ("https://seed.org/x", "fossil hunt", 0),
        ("https://seed.org/search", "", 1), ("https://x.com/fossil", "", 1), ("https://es.wikipedia.org/wiki/Fossil", "", 1),
        ("https://full.org/fossil", "", 1), ("https://new.org/fossil", "", 0), ("https://new.org/none", "", 1),
    ]
    frame = spark.createDataFrame(links, "url string, anchor string, rica int")
    seeds = spark.createDataFrame([("seed.org",)], "dominio string")
    counts = spark.createDataFrame([("full.org", 20_000), ("seed.org", 5)], "dominio string, paginas long")
    got = {r["url"]: (r["decision"], r["prioridad"]) for r in frontier.decide(frame, seeds, counts, C).collect()}
    assert [got[u] for u, _, _ in links] == [
        ("seguido_semilla", 10), ("enlaces_pagina_pobre", None), ("seguido_semilla", 10), ("enlaces_trampa", None),
        ("enlaces_dominio_vetado", None), ("enlaces_otro_idioma", None), ("enlaces_tope_dominio", None),
        ("dominios_nuevos_seguidos", 0), ("enlaces_fuera_de_tema", None),
    ]


def test_expansion_levels_cycle_depth_and_anchor_rule(spark):
    chain = [f"https://seed.org/{i}" for i in range(9)]
    edges = [(chain[i], i, 0, chain[i + 1], "", 1) for i in range(8)] + [
        (chain[1], 1, 1, chain[0], "", 1),
        (chain[0], 0, 1, "https://new.org/page", "fossil", 1),
        (chain[0], 0, 2, "https://new.org/fossil", "", 1),
        (chain[0], 0, 3, "https://seed.org/gone", "", 1),
    ]
    links = spark.createDataFrame(edges, "src string, seq long, n int, url string, anchor string, rica int")
    pages = spark.createDataFrame([(u,) for u in [*chain, "https://new.org/page", "https://new.org/fossil"]], "url string")
    seeds = spark.createDataFrame([(chain[0], "seed.org")], "url string, dominio string")
    out = frontier.expand(seeds, pages, links, C)
    got = {r["url"]: (r["profundidad"], r["prioridad"], r["motivo"]) for r in out.collect()}
    assert out.count() == len(got)
    assert [got[u][0] for u in chain[:7]] == list(range(7)) and chain[7] not in got
    assert got["https://new.org/page"][2] == "frontera_fuera_de_tema"
    assert got["https://new.org/fossil"] == (1, 0, None)
    assert got["https://seed.org/gone"][2] == "no_encontrada"
    assert [r["url"] for r in frontier.in_order(out, "url").collect()][:2] == chain[:2]


def test_reports_on_empty_tables(spark):
    docs = spark.createDataFrame([], tables.DOCUMENTS_SCHEMA)
    assert metadata.totals(docs).first().asDict() == {"docs": 0, "palabras": 0, "bytes_texto": 0}
    assert metadata.latest(docs).first().asDict() == {"hora": "--:--:--", "dominio": "-"}
    assert metadata.summary(docs).first()["docs"] == 0 and metadata.by_domain(docs).count() == 0


def test_sql_errors_are_told(spark):
    metadata.registered(spark.createDataFrame([], tables.DOCUMENTS_SCHEMA), spark.createDataFrame([], tables.ERRORS_SCHEMA))
    good, none = tables.run_sql(spark, "SELECT", "count(*)", "AS n", "FROM documentos")
    assert good.first()["n"] == 0 and none is None
    bad, why = tables.run_sql(spark, "SELECT nothing FROM nowhere")
    assert bad is None and "nowhere" in why
    told = tables.catalog(spark).filter("tabla = 'errores'").collect()
    assert [r["columna"] for r in told] == ["id", "url", "dominio", "motivo", "fecha"] and told[0]["filas"] == 0


def test_statistics(spark, tmp_path):
    docs = spark.createDataFrame([("d", "uno dos dos"), ("d", "tres dos"), ("e", None)], "source string, text string")
    words = corpus_stats.word_frequencies(docs)
    assert [tuple(r) for r in corpus_stats.zipf(words).orderBy("rango").collect()] == [
        (1, "dos", 3, 3.0), (2, "tres", 1, 1.5), (3, "uno", 1, 1.0)
    ]
    s = corpus_stats.summary(docs).first()
    assert (s["docs"], s["palabras"], s["palabras_distintas"], s["dominios"], s["bytes_disco"]) == (3, 5, 3, 2, 3 * 4096)
    sinks.write_frequencies(words, str(tmp_path))
    back = spark.read.option("header", True).csv(f"{tmp_path}/zipf")
    assert back.columns == ["rango", "palabra", "frecuencia"] and back.count() == 3
    assert "dos: 3 (60.00 %)" in sinks.report(docs, "x")
    empty = docs.limit(0)
    assert corpus_stats.summary(empty).first()["palabras"] == 0 and corpus_stats.hapax(corpus_stats.word_frequencies(empty)).first()["hapax"] == 0


def test_queue_records(spark, tmp_path):
    record = lambda b: struct.pack(">L", len(b)) + b
    slot = tmp_path / ("a-b.org-" + hashlib.md5(b"a-b.org").hexdigest())
    (slot / "-1").mkdir(parents=True)
    (slot / "-1" / "q00000").write_bytes(record(b"one") + record(b"") + record(b"three"))
    (slot / "-1" / "q00001").write_bytes(record(b"four") + record(b"five")[:-1])
    (tmp_path / "bad-0000" / "0").mkdir(parents=True)
    (tmp_path / "bad-0000" / "0" / "q00000").write_bytes(record(b"x"))
    assert files.complete_records(b"\0\0") == (0, 0)
    decoded = files.decoded_queues(files.queue_files(spark, str(tmp_path)))
    totals = maintenance.queue_totals(decoded)
    row = totals.first()
    assert totals.count() == 1 and (row["slot"], row["prioridad"], row["registros"], row["ultimo"], row["utiles_ultimo"], row["truncados"]) == (
        "a-b.org", -1, 4, "q00001", 8, 1
    )
    assert maintenance.queue_indexes(totals).first()["info"] == '{"chunksize":100000,"size":4,"tail":[0,0,0],"head":[1,4]}'
    assert maintenance.active_slots(totals).first()["active"] == '{"a-b.org":[-1]}'


def test_repository_files_and_orphans(spark, tmp_path):
    for path, data in {"h.org/ab/ab1.txt": "uno".encode(), "h.org/cd/cd2.txt": b"\xff\xfe bad", "k.org/ef/ef3.txt": b"x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    found = files.corpus_files(spark, str(tmp_path))
    got = {r["path"].split("/")[-1]: (r["dominio"], r["length"], r["text"]) for r in found.collect()}
    assert got["ab1.txt"] == ("h.org", 3, "uno") and "�" in got["cd2.txt"][2]
    assert files.repository_stats(found).first()["bytes_disco"] == 3 * 4096
    listed = found.select(F.array_join(F.slice(F.split("path", "/"), -3, 3), "/").alias("ruta"))
    docs = spark.createDataFrame([(1, "h.org/ab/ab1.txt"), (2, "h.org\\cd\\cd2.txt"), (3, "z/zz/none.txt")], "id long, ruta_archivo string")
    assert [r["ruta"] for r in maintenance.orphans(listed, docs).collect()] == ["k.org/ef/ef3.txt"]
    assert [r["id"] for r in maintenance.present(docs, listed).collect()] == [1]


def test_seed_lists(spark):
    lines = spark.createDataFrame([("# note",), ("",), ("  ",), (" https://www.a.org/x ",), (" # odd",)], "value string")
    assert [tuple(r) for r in files.seed_lines(lines).collect()] == [("https://www.a.org/x", "a.org"), ("# odd", "")]
    row = files.seed_requests(files.seed_lines(lines), 100).first()
    assert (row["prioridad"], row["profundidad"], row["es_semilla"]) == (100, 0, 1)


def test_rewrite_a_folder_from_itself(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.range(10).write.parquet(folder)
    sinks.rewrite(spark.read.parquet(folder).filter("id < 4"), folder)
    assert spark.read.parquet(folder).count() == 4 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_stages_and_event_lines(spark):
    errors = spark.createDataFrame([("http://a.org/" + "x" * 300, "Timeout")], "url string, motivo string")
    line = events.run_stages(errors, [events.failures, lambda d: d.select("linea")]).first()[0]
    assert line.endswith("x Timeout") and len(line) == 128


def test_goal_and_rates(spark):
    rows = spark.createDataFrame([(i, 10) for i in range(1000)], "seq long, n long")
    assert progress.until_goal(rows, "n", 5005, pieces=64).count() == 501
    assert progress.until_goal(rows, "n", 5005, stored=5000).count() == 1
    assert progress.until_goal(rows, "n", 0).count() == 1000
    samples = spark.createDataFrame([(0, 0, 0), (60, 30, 1 << 20), (120, 30, 1 << 20)], "t long, docs long, bytes long")
    got = [(r["docs_min"], r["mb_h"], r["goal"]) for r in progress.rates(samples).orderBy("t").collect()]
    assert got == [(0.0, 0.0, 1.0), (30.0, 60.0, 1.0), (0.0, 0.0, 1.0)]


def test_policy_rejections_are_no_errors(spark):
    rows = [("https://www.a.org/x", "IgnoreRequest", "m", "t"), ("https://www.a.org/y", "Timeout", "m" * 400, "t")]
    got = metadata.real_failures(spark.createDataFrame(rows, "url string, error_class string, motivo string, fecha string")).collect()
    assert [(r["dominio"], len(r["motivo"])) for r in got] == [("a.org", 300)]


def test_failures_without_a_class_are_kept_and_reports_are_ordered(spark):
    rows = [("https://a.org/x", None, "m", "t"), ("https://a.org/y", "IgnoreRequest", "m", "t")]
    failed = spark.createDataFrame(rows, "url string, error_class string, motivo string, fecha string")
    assert [r["url"] for r in metadata.real_failures(failed).collect()] == ["https://a.org/x"]
    docs = spark.createDataFrame([(i, d) for i, d in enumerate(["es.b.org", "x.com", "x.com", "ok.org", None])], "id long, dominio string")
    assert [tuple(r) for r in maintenance.purge_report(maintenance.purge_candidates(docs, C)).collect()] == [("x.com", 2), ("es.b.org", 1)]
    assert sorted(r["id"] for r in maintenance.purged(docs, C).collect()) == [3, 4]
    deep = spark.createDataFrame([(k % 4, 10, 1.0, k % 2) for k in range(20)], "profundidad int, palabras int, densidad_tema double, dominio_semilla int")
    assert [r["profundidad"] for r in metadata.by_depth(deep).collect()] == [r["profundidad"] for r in metadata.depth_histogram(deep).collect()] == [0, 1, 2, 3]
    assert [r["dominio_semilla"] for r in metadata.seed_origin(deep).collect()] == [0, 1]


def test_ranks_of_many_words_of_one_frequency(spark):
    words = [(f"{a}{b}{k}", 1 + (k == 0)) for a in "zañb" for b in "éxa" for k in range(7)]
    out = corpus_stats.ranked(spark.createDataFrame(words, "palabra string, frecuencia long")).orderBy("rango").collect()
    assert [r["palabra"] for r in out] == [w for w, _ in sorted(words, key=lambda x: (-x[1], x[0].encode()))]
    assert [r["rango"] for r in out] == list(range(1, len(words) + 1))
