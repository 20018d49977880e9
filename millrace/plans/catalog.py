"""Registered queries of the corpus operators over the driver's tables, and their oracle SQL.

The driver's documents are invented words, so the queries set a vocabulary of
such words; it is a parameter of the operators like any other.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import EngineConfig, Policy
from millrace.functions import html, sql, text, urls
from millrace.operators import corpus_stats, documents, events, frontier, maintenance, metadata, policy_tables, progress
from millrace.plans import oracles as o
from millrace.sources import files

_TERMS = tuple("ble ly ther tion ou sh thon thth than wh thre thnt thes thhe thha thed erin thble anea thor".split())
CONFIG = EngineConfig(policy=replace(Policy(), topic=_TERMS, core=("ble", "tion", "sh"), probes=("tion", "thth", "ther")))
#: For pages: mobile hosts and language paths of the driver's URLs are not turned away.
OPEN = replace(CONFIG, policy=replace(CONFIG.policy, traps=(r"[?&]utm_", r"[?&]ref="), topic=(*_TERMS, "therin", "tionsh", "to", "and")))
#: For the link graph, where any host is on topic.
WIDE = replace(OPEN, policy=replace(OPEN.policy, topic=(*OPEN.policy.topic, "example")))
GOAL_BYTES = 1_000_000


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- documents -------------------------------------------------------------


def _scored(spark, sf) -> DataFrame:
    docs = _table(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"), F.col("text").alias("texto"), F.col("lang").alias("idioma"), "source"
    )
    return documents.with_features(docs, CONFIG)


_tokens = o.topic_tokens("text")
_SCORED = (
    f"scored AS (SELECT doc_id AS seq, {o.words('text')} AS palabras, octet_length(encode(text)) AS bytes_texto, sha256(text) AS hash_texto, "
    f"{o.score(_tokens, CONFIG)} AS puntaje_tema, {o.density(_tokens, CONFIG)} AS densidad_tema, "
    f"{o.language('lang', _tokens, CONFIG)} AS idioma, source FROM documents), "
    f"judged AS (SELECT *, {o.reason(CONFIG)} AS m FROM scored), "
    "fun AS (SELECT *, CASE WHEN m IS NULL AND row_number() OVER (PARTITION BY hash_texto, m IS NULL ORDER BY seq) > 1 THEN 'duplicado' ELSE m END AS motivo FROM judged)"
)


def doc_features(spark, sf) -> DataFrame:
    return _scored(spark, sf).select("seq", "palabras", "bytes_texto", "hash_texto", "puntaje_tema", "densidad_tema")


def doc_language(spark, sf) -> DataFrame:
    docs = _table(spark, sf, "documents")
    declared = F.when(F.col("lang") != "de", F.col("lang"))  # German documents declare none
    return docs.select("doc_id", text.language(declared, text.topic_tokens(F.col("text")), CONFIG).alias("idioma"))


def filter_funnel(spark, sf) -> DataFrame:
    return documents.funnel_counts(documents.funnel(_scored(spark, sf), CONFIG))


def funnel_saved(spark, sf) -> DataFrame:
    return documents.saved(documents.funnel(_scored(spark, sf), CONFIG)).select("seq", "hash_texto")


def funnel_incremental(spark, sf) -> DataFrame:
    """All other sources, after an earlier run has stored what src0 holds."""
    scored = _scored(spark, sf)
    seen = scored.filter("source = 'src0'").select("hash_texto")
    return documents.funnel_counts(documents.funnel(scored.filter("source <> 'src0'"), CONFIG, seen))


def dedup_first_wins(spark, sf) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", text.sha256(F.col("text")).alias("hash_texto"))
    return documents.first_wins(docs, "hash_texto", "doc_id")


def text_normalize(spark, sf) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", text.sha256(text.clean(F.col("text"))).alias("digest"))


# --- URLs ------------------------------------------------------------------


def url_predicates(spark, sf) -> DataFrame:
    p, u, d = CONFIG.policy, F.col("url"), F.col("dominio")
    return _table(spark, sf, "pages").select("page_id", "url", urls.domain(F.col("url")).alias("dominio")).select(
        "page_id",
        "dominio",
        urls.is_trap(u, p).alias("trampa"),
        urls.is_vetoed(d, p).alias("vetado"),
        urls.is_other_language(d, p).alias("otro_idioma"),
        urls.is_promising(u, None, p).alias("prometedora"),
        urls.is_denied_extension(u, p).alias("extension"),
        urls.canonical(u).alias("canonica"),
        text.storage_path(d, F.md5(u)).alias("ruta"),
    )


#: The driver's pages name no seeds: those with this beginning stand for them.
SEED_PREFIX = "https://www."


def _seed_domains(spark, sf) -> DataFrame:
    seeds_ = _table(spark, sf, "pages").filter(F.col("url").startswith(SEED_PREFIX))
    return seeds_.select(urls.domain(F.col("url")).alias("dominio")).distinct()


_SEEDS = f"seeds AS (SELECT DISTINCT {o.domain('url')} AS dominio FROM pages WHERE starts_with(url, '{SEED_PREFIX}'))"


def seed_domains(spark, sf) -> DataFrame:
    """Seed list of all URLs, those that are no seeds commented out."""
    url = F.col("url")
    lines = _table(spark, sf, "pages").select(F.when(url.startswith(SEED_PREFIX), url).otherwise(F.concat(F.lit("# "), url)).alias("value"))
    return files.seed_lines(lines).select("dominio").distinct()


def frontier_filter_reasons(spark, sf) -> DataFrame:
    known = _seed_domains(spark, sf).select(F.col("dominio").alias("_seed"))
    rows = _table(spark, sf, "pages").select("url", urls.domain(F.col("url")).alias("dominio"))
    reason = urls.frontier_reason(F.col("url"), F.col("dominio"), F.col("_seed").isNotNull(), OPEN.policy)
    return (
        rows.join(known, F.col("dominio") == F.col("_seed"), "left")
        .groupBy(F.coalesce(reason, F.lit("aceptada")).alias("motivo")).agg(F.count("*").alias("urls"))
    )


def host_tables(spark, sf) -> DataFrame:
    """Hosts and label words as tables."""
    rows = _table(spark, sf, "pages").select("page_id", urls.domain(F.col("url")).alias("dominio"))
    hosts = spark.createDataFrame([("example.org",), ("tionsh.example.net",), ("net.example",)], "host string")
    words = spark.createDataFrame([("casino",), ("thn",), ("le.c",)], "palabra string")
    return policy_tables.labels_with(policy_tables.below_hosts(rows, hosts, "listado"), words, "palabra_vetada", 6, 3)


def topic_table(spark, sf) -> DataFrame:
    terms = [(t, int(t in CONFIG.policy.core)) for t in CONFIG.policy.topic]
    return policy_tables.topic_scores(_table(spark, sf, "documents"), spark.createDataFrame(terms, "palabra string, nucleo int"), "doc_id", "text")


# --- HTML ------------------------------------------------------------------


def html_features(spark, sf) -> DataFrame:
    h = F.col("html")
    return _table(spark, sf, "pages").select(
        "page_id",
        html.title(h).alias("titulo"),
        html.declared_language(h).alias("idioma"),
        text.sha256(html.main_text(h, CONFIG.policy)).alias("digest"),
        html.probe_mentions(h, CONFIG.policy).alias("menciones"),
        html.is_rich(h, CONFIG.policy, CONFIG.rich_page_mentions).alias("rica"),
    )


def page_richness(spark, sf) -> DataFrame:
    rich = html.is_rich(F.col("html"), CONFIG.policy, CONFIG.rich_page_mentions)
    return _table(spark, sf, "pages").agg(
        F.count_if(rich).alias("paginas_ricas"), F.count_if(~rich).alias("paginas_pobres")
    )


def _links(spark, sf) -> DataFrame:
    return frontier.page_links(_table(spark, sf, "pages").withColumn("seq", F.col("page_id")), OPEN)


_LINKS = (
    f"raw AS (SELECT page_id AS seq, url AS src, {o.mentions('html', OPEN)} >= {OPEN.rich_page_mentions} AS rica, "
    f"unnest({o.links('html')}) AS l, unnest(range(0, len({o.links('html')}))) AS n FROM pages), "
    f"target AS (SELECT seq, src, rica, n, {o.resolve('src', 'l[1]')} AS t, l[2] AS anchor FROM raw), "
    f"links AS (SELECT seq, src, CAST(rica AS INT) AS rica, min_by(anchor, n) AS anchor, CAST(min(n) AS INT) AS n, {o.canonical('t')} AS url FROM target GROUP BY seq, src, rica, {o.canonical('t')}), "
    f"allowed AS (SELECT * FROM links WHERE regexp_matches(url, '^https?://') AND NOT {o.extension_denied('url', OPEN)})"
)


def html_links(spark, sf) -> DataFrame:
    return _links(spark, sf).select("seq", "n", "url", "anchor", "rica")


def link_decisions(spark, sf) -> DataFrame:
    pages = _table(spark, sf, "pages").groupBy(urls.domain(F.col("url")).alias("dominio")).agg(F.count("*").alias("paginas"))
    decided = frontier.decide(_links(spark, sf), _seed_domains(spark, sf), pages, replace(OPEN, max_pages_per_domain=20))
    return frontier.decision_counts(decided)


_DECIDED = (
    f"decided AS (SELECT CASE WHEN {o.trap('url', OPEN)} THEN 'enlaces_trampa' WHEN {o.vetoed('d', OPEN)} THEN 'enlaces_dominio_vetado' "
    f"WHEN {o.other_language('d', OPEN)} THEN 'enlaces_otro_idioma' WHEN coalesce(had, 0) >= 20 THEN 'enlaces_tope_dominio' "
    f"WHEN d IN (SELECT dominio FROM seeds) AND (rica = 1 OR {o.promising('url', 'anchor', OPEN)}) THEN 'seguido_semilla' "
    "WHEN d IN (SELECT dominio FROM seeds) THEN 'enlaces_pagina_pobre' "
    f"WHEN {o.promising('url', 'anchor', OPEN)} THEN 'dominios_nuevos_seguidos' ELSE 'enlaces_fuera_de_tema' END AS decision "
    f"FROM (SELECT *, {o.domain('url')} AS d FROM allowed) LEFT JOIN (SELECT {o.domain('url')} AS dom, count(*) AS had FROM pages GROUP BY 1) ON d = dom)"
)


def domain_cap(spark, sf) -> DataFrame:
    rows = _table(spark, sf, "pages").select(F.col("page_id").alias("seq"), urls.domain(F.col("url")).alias("dominio"))
    return frontier.capped(rows, 3).select("seq", "dominio", F.col("n_dominio").cast("bigint").alias("n_dominio"), "dentro")


def bfs_levels(spark, sf) -> DataFrame:
    """A link graph over the pages: page k links to 3k + 1 and 5k + 2, modulo their number."""
    pages = _table(spark, sf, "pages").select("page_id", "url")
    n = pages.agg((F.max("page_id") + 1).alias("n"))
    edges = pages.join(F.broadcast(n)).select(
        F.col("url").alias("src"),
        F.col("page_id").alias("seq"),
        F.posexplode(F.array((F.col("page_id") * 3 + 1) % F.col("n"), (F.col("page_id") * 5 + 2) % F.col("n"))).alias("n", "dst"),
    )
    links = edges.join(pages.select(F.col("page_id").alias("dst"), "url"), "dst").select(
        "src", "seq", "n", "url", F.lit("").alias("anchor"), F.lit(1).alias("rica")
    )
    seeds = pages.filter(F.col("url").startswith(SEED_PREFIX)).select("url", urls.domain(F.col("url")).alias("dominio"))
    return frontier.expand(seeds, pages, links, WIDE).select(
        "url", "profundidad", "es_semilla", F.coalesce("motivo", F.lit("leida")).alias("motivo")
    )


_BFS = f"""
WITH RECURSIVE m AS (SELECT max(page_id) + 1 AS n FROM pages),
seeds AS (SELECT url, {o.domain('url')} AS dominio FROM pages WHERE starts_with(url, '{SEED_PREFIX}')),
e AS (SELECT p.url AS src, d.url AS url, {o.domain('d.url')} AS dom FROM pages p, m, pages d WHERE d.page_id IN ((p.page_id * 3 + 1) % n, (p.page_id * 5 + 2) % n)),
ok AS (SELECT * FROM e WHERE NOT {o.trap('url', WIDE)} AND NOT ({o.vetoed('dom', WIDE)}) AND NOT ({o.other_language('dom', WIDE)})
    AND (dom IN (SELECT dominio FROM seeds) OR {o.promising('url', o.q(''), WIDE)})),
f AS (SELECT url, {o.frontier_reason('url', o.domain('url'), f"({o.domain('url')} IN (SELECT dominio FROM seeds))", WIDE)} AS motivo FROM pages),
r(url, depth) AS (SELECT url, 0 FROM seeds UNION
    SELECT ok.url, r.depth + 1 FROM r JOIN f ON f.url = r.url AND f.motivo IS NULL JOIN ok ON ok.src = r.url WHERE r.depth < {WIDE.depth_limit})
SELECT url, min(depth) AS profundidad, CAST(min(depth) = 0 AS INT) AS es_semilla, coalesce(any_value(motivo), 'leida') AS motivo
FROM r JOIN f USING (url) GROUP BY url
"""


# --- metadata --------------------------------------------------------------


def _documentos(spark, sf) -> DataFrame:
    pages = _table(spark, sf, "pages").select(
        F.col("page_id").alias("seq"),
        "url",
        "html",
        F.regexp_count("url", F.lit("/")).alias("profundidad"),
        F.when(F.col("url").startswith(SEED_PREFIX), 1).otherwise(0).alias("es_semilla"),
        F.format_string("2026-01-%02dT%02d:00:00+00:00", F.col("page_id") % 28 + 1, F.col("page_id") % 24).alias("fecha_descarga"),
    )
    return documents.assembled(pages, _seed_domains(spark, sf), CONFIG).withColumn("id", F.col("seq")).drop("seq")


_ptokens = o.topic_tokens("texto")
_DOCUMENTOS = (
    f"{_SEEDS}, base AS (SELECT page_id AS id, url, url AS url_final, {o.domain('url')} AS dominio, '' AS referer, CAST(len(regexp_extract_all(url, '/')) AS INT) AS profundidad, "
    f"CAST(starts_with(url, '{SEED_PREFIX}') AS INT) AS es_semilla, 200 AS http_status, 'text/html' AS content_type, octet_length(encode(html)) AS bytes_html, '' AS last_modified, "
    "'' AS etag, format('2026-01-{:02d}T{:02d}:00:00+00:00', page_id % 28 + 1, page_id % 24) AS fecha_descarga, "
    f"{o.title('html')} AS titulo, {o.declared('html')} AS lang, {o.main_text('html', CONFIG)} AS texto FROM pages), "
    f"documentos AS (SELECT base.* EXCLUDE (lang), CAST(dominio IN (SELECT dominio FROM seeds) AS INT) AS dominio_semilla, {o.words('texto')} AS palabras, "
    f"octet_length(encode(texto)) AS bytes_texto, sha256(texto) AS hash_texto, {o.score(_ptokens, CONFIG)} AS puntaje_tema, {o.density(_ptokens, CONFIG)} AS densidad_tema, "
    f"{o.language('lang', _ptokens, CONFIG)} AS idioma, dominio || '/' || substr(sha256(texto), 1, 2) || '/' || sha256(texto) || '.txt' AS ruta_archivo FROM base)"
)


def _errores(spark, sf) -> DataFrame:
    """Events of type error as failed requests; those of small value were policy rejections."""
    events = _table(spark, sf, "events").filter("event_type = 'error'")
    return metadata.real_failures(
        events.select(
            F.concat(F.lit("http://h"), F.col("user_id") % 40, F.lit(".example.org/"), "event_id").alias("url"),
            F.when(F.col("value") < 5, "IgnoreRequest").otherwise("TimeoutError").alias("error_class"),
            F.coalesce("props", F.lit("")).alias("motivo"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("fecha"),
        )
    )


_ERRORES = (
    "errores AS (SELECT 'h' || (user_id % 40) || '.example.org' AS dominio, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS fecha "
    "FROM events WHERE event_type = 'error' AND NOT coalesce(value < 5, false))"
)


def adhoc_sql(spark, sf) -> DataFrame:
    metadata.registered(_documentos(spark, sf), _errores(spark, sf))
    return spark.sql("SELECT idioma, count(*) AS docs, max(palabras) AS mayor FROM documentos WHERE dominio_semilla = 1 GROUP BY idioma")


def policy_sql(spark, sf) -> DataFrame:
    sql.register(spark, CONFIG)
    _table(spark, sf, "pages").createOrReplaceTempView("paginas")
    return spark.sql(
        "SELECT page_id, dominio_de(url) AS dominio, url_es_trampa(url) AS trampa, dominio_vetado(dominio_de(url)) AS vetado, "
        "host_otro_idioma(dominio_de(url)) AS otro_idioma, url_es_prometedora(url, NULL) AS prometedora, "
        "puntaje_tema(html) AS puntaje, densidad_tema(html) AS densidad FROM paginas"
    )


def event_log(spark, sf) -> DataFrame:
    judged = documents.funnel(_documentos(spark, sf), CONFIG, order="id")
    return events.visits(judged).union(events.outcomes(judged))


def progress_snapshot(spark, sf) -> DataFrame:
    return metadata.snapshot(_documentos(spark, sf), _errores(spark, sf))


def insert_or_ignore(spark, sf) -> DataFrame:
    """All URLs without scheme, query and fragment, inserted over those that plain http has."""
    rows = _table(spark, sf, "pages").select(
        F.col("page_id").alias("seq"), F.regexp_replace("url", "[?#].*$|^https?://", "").alias("url"), F.col("url").startswith("http://").alias("old")
    )
    return metadata.inserted(rows, rows.filter("old")).select("seq", "url")


# --- statistics ------------------------------------------------------------


def _frequencies(spark, sf) -> DataFrame:
    return corpus_stats.word_frequencies(_table(spark, sf, "documents"))


_FREQ = f"f AS (SELECT palabra, count(*) AS frecuencia FROM (SELECT unnest({o.stats_tokens('text')}) AS palabra FROM documents) GROUP BY palabra)"


def goal_cutoff(spark, sf) -> DataFrame:
    docs = _table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.octet_length("text").alias("bytes"))
    return progress.until_goal(docs, "bytes", GOAL_BYTES).select("seq")


def progress_rates(spark, sf) -> DataFrame:
    """Samples of each user's cumulated events and bytes, an hour apart."""
    hours = _table(spark, sf, "events").groupBy("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("h")).agg(
        F.count("*").alias("n"), F.sum(F.floor(F.coalesce("value", F.lit(0.0)) * 100000)).alias("b")
    )
    from pyspark.sql import Window

    so_far = Window.partitionBy("user_id").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    samples = hours.select("user_id", (F.col("h") * 3600).alias("t"), F.sum("n").over(so_far).alias("docs"), F.sum("b").over(so_far).alias("bytes"))
    out = progress.rates(samples, by=("user_id",))
    return out.select("user_id", "t", "docs", F.round("docs_min", 6).alias("docs_min"), F.round("mb_h", 6).alias("mb_h"), "goal", F.round("eta_h", 4).alias("eta_h"))


def queue_decode(spark, sf) -> DataFrame:
    """Queues made of events: a chunk per user and type, the last record of every third cut short."""
    events = _table(spark, sf, "events")
    payload = F.concat(F.coalesce("props", F.lit("")), F.lit("#"), F.col("event_id").cast("string")).cast("binary")
    told = events.select("user_id", "event_type", F.concat(F.lpad(F.hex(F.octet_length(payload).cast("bigint")), 8, "0"), F.hex(payload)).alias("h"))
    chunks = told.groupBy("user_id", "event_type").agg(F.concat_ws("", F.array_sort(F.collect_list("h"))).alias("h"))
    whole = F.unhex("h")
    content = F.when(F.col("user_id") % 3 == 0, F.substring(whole, F.lit(1), F.octet_length(whole) - 1)).otherwise(whole)
    slot = F.col("event_type")
    made = chunks.select(
        F.lit("").alias("path"), slot.alias("slot"), F.md5(slot.cast("binary")).alias("suffix"),
        (F.col("user_id") % 5 - 2).cast("int").alias("prioridad"), F.format_string("q%05d", "user_id").alias("chunk"),
        content.alias("content"), F.lit(True).alias("valid"),
    )
    return maintenance.queue_totals(files.decoded_queues(made)).select("slot", "prioridad", "registros", "ultimo", F.col("truncados").cast("bigint").alias("truncados"))


_QUEUE = """
WITH c AS (SELECT user_id, event_type AS slot, CAST(user_id % 5 - 2 AS INT) AS prioridad, format('q{:05d}', user_id) AS chunk, count(*) - CAST(user_id % 3 = 0 AS INT) AS n,
    CAST(user_id % 3 = 0 AS INT) AS cut FROM events GROUP BY user_id, event_type)
SELECT slot, prioridad, CAST(sum(n) AS BIGINT) AS registros, max(chunk) AS ultimo, CAST(sum(cut) AS BIGINT) AS truncados FROM c GROUP BY slot, prioridad
"""


def orphans(spark, sf) -> DataFrame:
    """Files of every page, against the documents in English."""
    docs = _documentos(spark, sf)
    return maintenance.orphans(docs.select(F.col("ruta_archivo").alias("ruta")).distinct(), docs.filter("idioma = 'en'"))


def content_type_filter(spark, sf) -> DataFrame:
    """Types by the shape of the URL."""
    url = F.col("url")
    kinds = (
        F.when(url.endswith(".html"), "text/html; charset=utf-8").when(url.endswith("/"), "").when(url.endswith("#top"), "TEXT/PLAIN")
        .when(url.contains("?"), "application/pdf").otherwise("image/png;q=1")
    )
    rows = _table(spark, sf, "pages").select(kinds.alias("ct"))
    return rows.groupBy(F.coalesce(documents.content_type_reason("ct", CONFIG), F.lit("aceptado")).alias("motivo")).agg(F.count("*").alias("paginas"))


def _on_documents(f):
    return lambda spark, sf: f(_documentos(spark, sf))


_Q = {
    "doc_features": (doc_features, f"WITH {_SCORED} SELECT seq, palabras, bytes_texto, hash_texto, puntaje_tema, densidad_tema FROM scored"),
    "doc_language": (doc_language, f"SELECT doc_id, {o.language('d', _tokens, CONFIG)} AS idioma FROM (SELECT *, CASE WHEN lang <> 'de' THEN lang END AS d FROM documents)"),
    "filter_funnel": (filter_funnel, f"WITH {_SCORED} SELECT coalesce(motivo, 'guardado') AS motivo, count(*) AS docs, CAST(sum(palabras) AS BIGINT) AS palabras, CAST(sum(bytes_texto) AS BIGINT) AS bytes_texto FROM fun GROUP BY 1"),
    "funnel_saved": (funnel_saved, f"WITH {_SCORED} SELECT seq, hash_texto FROM fun WHERE motivo IS NULL"),
    "funnel_incremental": (funnel_incremental, f"WITH {_SCORED}, rest AS (SELECT *, CASE WHEN m IS NULL AND (row_number() OVER (PARTITION BY hash_texto, m IS NULL ORDER BY seq) > 1 OR hash_texto IN (SELECT hash_texto FROM scored WHERE source = 'src0')) THEN 'duplicado' ELSE m END AS motivo FROM judged WHERE source <> 'src0') SELECT coalesce(motivo, 'guardado') AS motivo, count(*) AS docs, CAST(sum(palabras) AS BIGINT) AS palabras, CAST(sum(bytes_texto) AS BIGINT) AS bytes_texto FROM rest GROUP BY 1"),
    "dedup_first_wins": (dedup_first_wins, "SELECT min(doc_id) AS doc_id, sha256(text) AS hash_texto FROM documents GROUP BY 2"),
    "text_normalize": (text_normalize, f"SELECT doc_id, sha256({o.clean('text')}) AS digest FROM documents"),
    "url_predicates": (url_predicates, f"SELECT page_id, dominio, {o.trap('url', CONFIG)} AS trampa, {o.vetoed('dominio', CONFIG)} AS vetado, {o.other_language('dominio', CONFIG)} AS otro_idioma, {o.promising('url', o.q(''), CONFIG)} AS prometedora, {o.extension_denied('url', CONFIG)} AS extension, {o.canonical('url')} AS canonica, dominio || '/' || substr(md5(url), 1, 2) || '/' || md5(url) || '.txt' AS ruta FROM (SELECT *, {o.domain('url')} AS dominio FROM pages)"),
    "seed_domains": (seed_domains, f"WITH {_SEEDS} SELECT dominio FROM seeds"),
    "frontier_filter_reasons": (frontier_filter_reasons, f"WITH {_SEEDS} SELECT coalesce({o.frontier_reason('url', 'dominio', '(dominio IN (SELECT dominio FROM seeds))', OPEN)}, 'aceptada') AS motivo, count(*) AS urls FROM (SELECT url, {o.domain('url')} AS dominio FROM pages) GROUP BY 1"),
    "host_tables": (host_tables, f"SELECT page_id, dominio, regexp_matches(dominio, '(^|[.])(example[.]org|tionsh[.]example[.]net|net[.]example)$') AS listado, regexp_matches(dominio, 'casino|thn') AS palabra_vetada FROM (SELECT page_id, {o.domain('url')} AS dominio FROM pages)"),
    "topic_table": (topic_table, f"SELECT doc_id, CAST({o.score(_tokens, CONFIG)} AS BIGINT) AS puntaje, CAST({o.hits(_tokens, CONFIG.policy.topic)} AS BIGINT) AS menciones FROM documents"),
    "html_features": (html_features, f"SELECT page_id, {o.title('html')} AS titulo, {o.declared('html')} AS idioma, sha256({o.main_text('html', CONFIG)}) AS digest, {o.mentions('html', CONFIG)} AS menciones, {o.mentions('html', CONFIG)} >= {CONFIG.rich_page_mentions} AS rica FROM pages"),
    "page_richness": (page_richness, f"SELECT count(*) FILTER (r) AS paginas_ricas, count(*) FILTER (NOT r) AS paginas_pobres FROM (SELECT {o.mentions('html', CONFIG)} >= {CONFIG.rich_page_mentions} AS r FROM pages)"),
    "html_links": (html_links, f"WITH {_LINKS} SELECT seq, n, url, anchor, rica FROM allowed"),
    "link_decisions": (link_decisions, f"WITH {_SEEDS}, {_LINKS}, {_DECIDED} SELECT decision, count(*) AS enlaces FROM decided GROUP BY 1"),
    "domain_cap": (domain_cap, f"SELECT *, n_dominio <= 3 AS dentro FROM (SELECT page_id AS seq, {o.domain('url')} AS dominio, row_number() OVER (PARTITION BY {o.domain('url')} ORDER BY page_id) AS n_dominio FROM pages)"),
    "bfs_levels": (bfs_levels, _BFS),
    "documentos": (lambda spark, sf: _documentos(spark, sf).drop("texto"), f"WITH {_DOCUMENTOS} SELECT * EXCLUDE (texto) FROM documentos"),
    "report_summary": (_on_documents(metadata.summary), f"WITH {_DOCUMENTOS} SELECT count(*) AS docs, CAST(sum(palabras) AS BIGINT) AS palabras, round(sum(bytes_texto) / 1048576.0, 2) AS mb, round(sum(bytes_texto) / 1073741824.0, 3) AS gb FROM documentos"),
    "report_totals": (_on_documents(metadata.totals), f"WITH {_DOCUMENTOS} SELECT count(*) AS docs, CAST(coalesce(sum(palabras), 0) AS BIGINT) AS palabras, CAST(coalesce(sum(bytes_texto), 0) AS BIGINT) AS bytes_texto FROM documentos"),
    "report_by_domain": (_on_documents(metadata.by_domain), f"WITH {_DOCUMENTOS} SELECT dominio, count(*) AS docs, CAST(sum(palabras) AS BIGINT) AS palabras, round(avg(densidad_tema), 1) AS densidad_prom FROM documentos GROUP BY dominio ORDER BY docs DESC, dominio LIMIT 20"),
    "report_by_depth": (_on_documents(metadata.by_depth), f"WITH {_DOCUMENTOS} SELECT profundidad, count(*) AS docs, round(avg(palabras)) AS palabras_prom, round(avg(densidad_tema), 1) AS densidad_prom FROM documentos GROUP BY profundidad"),
    "report_new_domains": (_on_documents(metadata.new_domains), f"WITH {_DOCUMENTOS} SELECT dominio, count(*) AS docs, round(avg(densidad_tema), 1) AS densidad_prom FROM documentos WHERE dominio_semilla = 0 GROUP BY dominio ORDER BY docs DESC, dominio LIMIT 15"),
    "report_densest": (_on_documents(metadata.densest), f"WITH {_DOCUMENTOS} SELECT round(densidad_tema, 1) AS densidad, palabras, substr(titulo, 1, 55) AS titulo FROM documentos ORDER BY densidad_tema DESC, id LIMIT 10"),
    "report_failures": (lambda spark, sf: metadata.failures(_errores(spark, sf)), f"WITH {_ERRORES} SELECT dominio, count(*) AS fallos, max(fecha) AS ultimo FROM errores GROUP BY dominio ORDER BY fallos DESC, dominio LIMIT 10"),
    "error_count": (lambda spark, sf: metadata.row_count(_errores(spark, sf)), f"WITH {_ERRORES} SELECT count(*) AS filas FROM errores"),
    "domain_distinct": (_on_documents(metadata.distinct_domains), f"WITH {_DOCUMENTOS} SELECT count(DISTINCT dominio) AS dominios FROM documentos"),
    "latest_doc": (_on_documents(metadata.latest), f"WITH {_DOCUMENTOS} SELECT substr(fecha_descarga, 12, 8) AS hora, dominio FROM documentos ORDER BY id DESC LIMIT 1"),
    "depth_histogram": (_on_documents(metadata.depth_histogram), f"WITH {_DOCUMENTOS} SELECT profundidad, count(*) AS docs FROM documentos GROUP BY 1"),
    "seed_origin": (_on_documents(metadata.seed_origin), f"WITH {_DOCUMENTOS} SELECT dominio_semilla, count(*) AS docs FROM documentos GROUP BY 1"),
    "adhoc_sql": (adhoc_sql, f"WITH {_DOCUMENTOS} SELECT idioma, count(*) AS docs, CAST(max(palabras) AS INT) AS mayor FROM documentos WHERE dominio_semilla = 1 GROUP BY idioma"),
    "policy_sql": (policy_sql, f"SELECT page_id, dominio, {o.trap('url', CONFIG)} AS trampa, {o.vetoed('dominio', CONFIG)} AS vetado, {o.other_language('dominio', CONFIG)} AS otro_idioma, {o.promising('url', o.q(''), CONFIG)} AS prometedora, CAST({o.score(o.topic_tokens('html'), CONFIG)} AS INT) AS puntaje, {o.density(o.topic_tokens('html'), CONFIG)} AS densidad FROM (SELECT *, {o.domain('url')} AS dominio FROM pages)"),
    "event_log": (event_log, f"WITH {_DOCUMENTOS}, j AS (SELECT *, {o.reason(CONFIG)} AS m FROM documentos), k AS (SELECT *, CASE WHEN m IS NULL AND row_number() OVER (PARTITION BY hash_texto, m IS NULL ORDER BY id) > 1 THEN 'duplicado' ELSE m END AS motivo FROM j) SELECT 'VISITA' AS evento, format('d={{}} dom={{}} status={{}} bytes={{}} url={{}} ref=-', profundidad, dominio, http_status, bytes_html, url_final) AS linea FROM k UNION ALL SELECT CASE WHEN motivo IS NULL THEN 'GUARDADO' ELSE 'DESCARTE' END, CASE WHEN motivo IS NULL THEN format('{{}} | {{}} palabras | dens {{}} | {{}}', dominio, palabras, densidad_tema, substr(url_final, 1, 160)) ELSE substr(motivo || ': ' || url, 1, 220) END FROM k"),
    "progress_snapshot": (progress_snapshot, f"WITH {_DOCUMENTOS}, {_ERRORES} SELECT count(*) AS docs, CAST(sum(palabras) AS BIGINT) AS palabras, CAST(sum(bytes_texto) AS BIGINT) AS bytes_texto, count(DISTINCT dominio) AS dominios, (SELECT count(*) FROM errores) AS errores, substr(max_by(fecha_descarga, id), 12, 8) AS hora, max_by(dominio, id) AS dominio FROM documentos"),
    "insert_or_ignore": (insert_or_ignore, "WITH u AS (SELECT page_id AS seq, regexp_replace(url, '[?#].*$|^https?://', '', 'g') AS url, starts_with(url, 'http://') AS old FROM pages) SELECT min(seq) AS seq, url FROM u WHERE url NOT IN (SELECT url FROM u WHERE old) GROUP BY url"),
    "word_frequency": (_frequencies, f"WITH {_FREQ} SELECT * FROM f"),
    "zipf_rank": (lambda spark, sf: corpus_stats.zipf(_frequencies(spark, sf)), f"WITH {_FREQ} SELECT row_number() OVER (ORDER BY frecuencia DESC, encode(palabra)) AS rango, palabra, frecuencia, max(frecuencia) OVER () / row_number() OVER (ORDER BY frecuencia DESC, encode(palabra)) AS zipf_ideal FROM f"),
    "hapax": (lambda spark, sf: corpus_stats.hapax(_frequencies(spark, sf)), f"WITH {_FREQ} SELECT count(*) FILTER (frecuencia = 1) AS hapax, count(*) AS vocabulario, round(100.0 * count(*) FILTER (frecuencia = 1) / count(*), 1) AS porcentaje FROM f"),
    "top_words": (lambda spark, sf: corpus_stats.top_words(_frequencies(spark, sf)), f"WITH {_FREQ} SELECT palabra, frecuencia, round(100.0 * frecuencia / (SELECT sum(frecuencia) FROM f), 2) AS porcentaje FROM f ORDER BY frecuencia DESC, encode(palabra) LIMIT 30"),
    "top_domains": (lambda spark, sf: corpus_stats.top_domains(_table(spark, sf, "documents")), "SELECT source AS dominio, count(*) AS docs, round(100.0 * count(*) / (SELECT count(*) FROM documents), 1) AS porcentaje FROM documents GROUP BY 1 ORDER BY docs DESC, dominio LIMIT 15"),
    "corpus_summary": (lambda spark, sf: corpus_stats.summary(_table(spark, sf, "documents")), f"WITH {_FREQ}, s AS (SELECT count(*) AS docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes_texto, CAST(sum(greatest(1, (octet_length(encode(text)) + 4095) // 4096) * 4096) AS BIGINT) AS bytes_disco, CAST(sum(len({o.stats_tokens('text')})) AS BIGINT) AS palabras, count(DISTINCT source) AS dominios FROM documents), k AS (SELECT count(*) AS palabras_distintas FROM f) SELECT *, round(bytes_texto / 1048576.0, 2) AS mb, round(bytes_texto / 1073741824.0, 3) AS gb, round(palabras / docs) AS palabras_por_doc, round(bytes_texto / 1024.0 / docs, 1) AS kb_por_doc, round(palabras_distintas / palabras, 4) AS riqueza FROM s, k"),
    "goal_cutoff": (goal_cutoff, f"SELECT seq FROM (SELECT doc_id AS seq, coalesce(sum(octet_length(encode(text))) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < {GOAL_BYTES}"),
    "progress_rates": (progress_rates, """WITH h AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, count(*) AS n, CAST(sum(floor(coalesce(value, 0) * 100000)) AS BIGINT) AS b FROM events GROUP BY 1, 2),
s AS (SELECT user_id, h * 3600 AS t, CAST(sum(n) OVER w AS BIGINT) AS docs, CAST(sum(b) OVER w AS BIGINT) AS bytes FROM h WINDOW w AS (PARTITION BY user_id ORDER BY h)),
r AS (SELECT *, coalesce((docs - lag(docs) OVER v) * 60.0::DOUBLE / (t - lag(t) OVER v), 0.0) AS dm, coalesce((bytes - lag(bytes) OVER v) * 3600.0::DOUBLE / (t - lag(t) OVER v), 0.0) / 1048576.0::DOUBLE AS mh,
  CASE WHEN bytes < 1073741824 THEN 1.0::DOUBLE WHEN bytes < 3 * 1073741824 THEN 3.0::DOUBLE END AS goal FROM s WINDOW v AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, t, docs, round(dm, 6) AS docs_min, round(mh, 6) AS mb_h, goal, round(CASE WHEN mh > 1 THEN (goal * 1073741824 - bytes) / 1048576.0::DOUBLE / mh END, 4) AS eta_h FROM r"""),
    "purge_report": (lambda spark, sf: maintenance.purge_report(maintenance.purge_candidates(_documentos(spark, sf), CONFIG)), f"WITH {_DOCUMENTOS} SELECT dominio, count(*) AS docs FROM documentos WHERE ({o.vetoed('dominio', CONFIG)}) OR ({o.other_language('dominio', CONFIG)}) GROUP BY 1"),
    "purged_documents": (lambda spark, sf: maintenance.purged(_documentos(spark, sf), CONFIG).select("id", "dominio"), f"WITH {_DOCUMENTOS} SELECT id, dominio FROM documentos WHERE NOT (({o.vetoed('dominio', CONFIG)}) OR ({o.other_language('dominio', CONFIG)}))"),
    "orphans": (orphans, f"WITH {_DOCUMENTOS} SELECT DISTINCT ruta_archivo AS ruta FROM documentos WHERE ruta_archivo NOT IN (SELECT ruta_archivo FROM documentos WHERE idioma = 'en')"),
    "content_type_filter": (content_type_filter, "SELECT CASE WHEN url LIKE '%.html' OR url LIKE '%/' OR url LIKE '%#top' THEN 'aceptado' WHEN url LIKE '%?%' THEN 'tipo_descartado/application/pdf' ELSE 'tipo_descartado/image/png' END AS motivo, count(*) AS paginas FROM pages GROUP BY 1"),
    "queue_decode": (queue_decode, _QUEUE),
}


def queries() -> dict:
    return {name: f for name, (f, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _Q.items()}
