"""Link decisions and the breadth-first expansion of the frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.config import EngineConfig
from millrace.functions import html, urls
from millrace.sources.tables import materialise


def page_links(pages: DataFrame, config: EngineConfig, exact: bool = False) -> DataFrame:
    """Links of pages (seq, url, html): src, seq, n (place on the page), url, anchor, rica (1 if the page is on topic).

    Targets are resolved, made canonical and unique per page; denied extensions
    go. `exact` resolves dot segments too, in Python.
    """
    target = (urls.resolve_exact if exact else urls.resolve)(F.col("src"), F.col("link.href"))
    found = (
        pages.select(
            F.col("url").alias("src"),
            "seq",
            html.is_rich(F.col("html"), config.policy, config.rich_page_mentions).cast("int").alias("rica"),
            F.posexplode(html.links(F.col("html"))).alias("n", "link"),
        )
        .select("src", "seq", "rica", "n", urls.canonical(target).alias("url"), F.col("link.anchor").alias("anchor"))
        .filter(F.col("url").rlike("^https?://") & ~urls.is_denied_extension(F.col("url"), config.policy))
    )
    first = F.row_number().over(Window.partitionBy("src", "seq", "url").orderBy("n"))
    return found.withColumn("_k", first).filter("_k = 1").drop("_k")


def decide(links: DataFrame, seed_domains: DataFrame, counts: DataFrame | None, config: EngineConfig) -> DataFrame:
    """Add dominio, decision and prioridad (null if the link is not followed) to links (url, anchor, rica).

    counts: dominio and paginas fetched so far. Tests are in order of cost.
    """
    p = config.policy
    known = seed_domains.select(F.col("dominio").alias("_seed")).distinct()
    rows = links.withColumn("dominio", urls.domain(F.col("url"))).join(known, F.col("dominio") == F.col("_seed"), "left")
    if counts is not None:
        had = counts.select(F.col("dominio").alias("_dom"), F.col("paginas").alias("_had"))
        rows = rows.join(had, F.col("dominio") == F.col("_dom"), "left").drop("_dom")
    else:
        rows = rows.withColumn("_had", F.lit(0))
    inside, topical = F.col("_seed").isNotNull(), urls.is_promising(F.col("url"), F.col("anchor"), p)
    decision = (
        F.when(urls.is_trap(F.col("url"), p), "enlaces_trampa")
        .when(urls.is_vetoed(F.col("dominio"), p), "enlaces_dominio_vetado")
        .when(urls.is_other_language(F.col("dominio"), p), "enlaces_otro_idioma")
        .when(F.coalesce("_had", F.lit(0)) >= config.max_pages_per_domain, "enlaces_tope_dominio")
        .when(inside & ((F.col("rica") == 1) | topical), "seguido_semilla")
        .when(inside, "enlaces_pagina_pobre")
        .when(F.lit(config.allow_new_domains) & topical, "dominios_nuevos_seguidos")
        .otherwise("enlaces_fuera_de_tema")
    )
    return (
        rows.withColumn("decision", decision)
        .withColumn(
            "prioridad",
            F.when(F.col("decision") == "seguido_semilla", config.inside_priority).when(
                F.col("decision") == "dominios_nuevos_seguidos", config.outside_priority
            ),
        )
        .drop("_seed", "_had")
    )


def decision_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision").agg(F.count("*").alias("enlaces"))


def capped(rows: DataFrame, cap: int, order: str = "seq") -> DataFrame:
    """Add n_dominio, the place of a page in its domain, and dentro: whether it is within the cap."""
    place = F.row_number().over(Window.partitionBy("dominio").orderBy(order))
    return rows.withColumn("n_dominio", place).withColumn("dentro", F.col("n_dominio") <= cap)


def expand(seeds: DataFrame, pages: DataFrame, links: DataFrame, config: EngineConfig) -> DataFrame:
    """Breadth-first crawl over known pages: url, dominio, profundidad, prioridad, es_semilla, motivo.

    seeds: url, dominio. pages: url (one row each). links: src, url, anchor, rica,
    seq, n. Each level filters what is queued anew, reads it from pages, decides
    its links and queues those not seen before, at most depth_limit levels. motivo
    tells why a queued URL was not read: a frontier reason, or no_encontrada.
    Levels are written to the shared folder, so plans stay short.

    Within a level URLs are taken in order of priority less depth, then of place:
    their parent's, then their own on its page.
    """
    spark = seeds.sparkSession
    p = config.policy
    domains = seeds.select("dominio").distinct()
    known = pages.select(F.col("url").alias("_page")).distinct()
    level = materialise(
        seeds.select(
            "url", "dominio", F.lit(0).alias("profundidad"), F.lit(config.seed_priority).alias("prioridad"), F.lit(1).alias("es_semilla")
        ).dropDuplicates(["url"]),
        "frontier",
    )
    visited, done = [], None
    for depth in range(config.depth_limit + 1):
        inside = domains.select(F.col("dominio").alias("_seed"))
        checked = (
            level.join(inside, F.col("dominio") == F.col("_seed"), "left")
            .join(known, F.col("url") == F.col("_page"), "left")
            .withColumn(
                "motivo",
                F.coalesce(
                    urls.frontier_reason(F.col("url"), F.col("dominio"), F.col("_seed").isNotNull(), p),
                    F.when(F.col("_page").isNull(), "no_encontrada"),
                ),
            )
            .drop("_seed", "_page")
        )
        checked = materialise(checked, "frontier-checked")
        visited.append(checked)
        done = checked if done is None else done.unionByName(checked)
        if depth == config.depth_limit:
            break
        read = checked.filter("motivo IS NULL").select(F.col("url").alias("_src"))
        counts = done.filter("motivo IS NULL").groupBy("dominio").agg(F.count("*").alias("paginas"))
        decided = decide(links.join(read, F.col("src") == F.col("_src"), "left_semi"), domains, counts, config)
        best = Window.partitionBy("url").orderBy(F.desc("prioridad"), "seq", "n")
        level = materialise(
            decided.filter("prioridad IS NOT NULL")
            .withColumn("_k", F.row_number().over(best))
            .filter("_k = 1")
            .join(done.select(F.col("url").alias("_old")), F.col("url") == F.col("_old"), "left_anti")
            .select("url", "dominio", F.lit(depth + 1).alias("profundidad"), "prioridad", F.lit(0).alias("es_semilla")),
            "frontier",
        )
        if level.isEmpty():
            break
    out = visited[0]
    for v in visited[1:]:
        out = out.unionByName(v)
    return out


def in_order(frontier: DataFrame, *tie: str) -> DataFrame:
    """Frontier rows in the order they would be fetched: priority less depth, highest first, then `tie`."""
    return frontier.orderBy(F.desc(F.col("prioridad") - F.col("profundidad")), *tie)
