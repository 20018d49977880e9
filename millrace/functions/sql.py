"""The policy functions under their own names in SQL, as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.config import EngineConfig
from millrace.functions import text, urls


def _raw(pattern: str) -> str:
    if "'" in pattern:
        raise ValueError("patterns in SQL functions cannot hold a single quote")
    return f"r'{pattern}'"


def _in(words) -> str:
    return "(" + ", ".join(_raw(w) for w in words) + ")"


def register(spark: SparkSession, config: EngineConfig = EngineConfig()) -> list[str]:
    """Make the functions known to spark.sql(); their names."""
    p = config.policy
    below = lambda hosts: f"dominio RLIKE {_raw(f'(^|[.])({urls.quoted(hosts)})$')}"
    words = f"regexp_extract_all(lower(coalesce(texto, '')), {_raw(text.TOPIC_TOKEN)}, 0)"
    made = {
        "dominio_de(url STRING) RETURNS STRING": f"regexp_replace(split(lower(regexp_extract(ltrim(url), {_raw(urls.AUTHORITY)}, 1)), ':')[0], '^www[.]', '')",
        "url_es_trampa(url STRING) RETURNS BOOLEAN": f"url RLIKE {_raw('(?i)(' + '|'.join(p.traps) + ')')}",
        "dominio_vetado(dominio STRING) RETURNS BOOLEAN": (
            f"CASE WHEN {below(p.allowed_hosts)} THEN false WHEN startswith(dominio, 'm.') OR contains(dominio, '.m.') THEN true "
            f"WHEN dominio IN {_in(p.vetoed_exact)} THEN true WHEN {below(p.vetoed_hosts)} THEN true ELSE dominio RLIKE {_raw(urls.quoted(p.vetoed_words))} END"
        ),
        "host_otro_idioma(dominio STRING) RETURNS BOOLEAN": (
            f"CASE WHEN {below(p.allowed_hosts)} THEN false WHEN dominio RLIKE {_raw('(' + urls.quoted(p.edition_endings) + ')$')} "
            f"THEN dominio <> {_raw(p.allowed_edition)} ELSE split(dominio, '[.]')[0] IN {_in(p.language_labels)} END"
        ),
        "url_es_prometedora(url STRING, anchor STRING) RETURNS BOOLEAN": (
            f"exists(regexp_extract_all(lower(concat(url, ' ', coalesce(anchor, ''))), r'[a-z]+', 0), t -> t IN {_in(p.topic)})"
        ),
        "puntaje_tema(texto STRING) RETURNS INT": (
            f"size(array_distinct(filter({words}, t -> t IN {_in(p.topic)}))) + "
            f"size(array_distinct(filter({words}, t -> t IN {_in([w for w in p.core if w in p.topic])})))"
        ),
        "densidad_tema(texto STRING) RETURNS DOUBLE": (
            f"round(coalesce(try_divide(1000D * size(filter({words}, t -> t IN {_in(p.topic)})), size({words})), 0D), 2)"
        ),
    }
    for head, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.partition("(")[0] for head in made]
