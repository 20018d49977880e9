"""DuckDB SQL of the engine's functions, for side-by-side checks of the queries."""

from __future__ import annotations

from millrace.config import EngineConfig
from millrace.functions import html, text, urls


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def regex_all(value: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({value}, {q(pattern)}, {group})"


def sub(value: str, pattern: str, replacement: str = "") -> str:
    told = q(replacement).replace("\n", "' || chr(10) || '")
    return f"regexp_replace({value}, {q(pattern)}, {told}, 'g')"


def clean(value: str) -> str:
    for pattern, replacement in text.CLEANING:
        value = sub(value, pattern, replacement)
    return value


def words(value: str) -> str:
    return f"len({regex_all(value, text.WORD)})"


def topic_tokens(value: str) -> str:
    return regex_all(f"lower(coalesce({value}, ''))", text.TOPIC_TOKEN)


def stats_tokens(value: str) -> str:
    return regex_all(f"lower(coalesce({value}, ''))", f"(?i){text.STATS_TOKEN}")


def hits(tokens: str, terms) -> str:
    return f"len(list_filter({tokens}, lambda t: t IN ({', '.join(q(w) for w in terms)})))"


def score(tokens: str, c: EngineConfig) -> str:
    once = f"list_distinct({tokens})"
    return f"({hits(once, c.policy.topic)} + {hits(once, [w for w in c.policy.core if w in c.policy.topic])})"


def density(tokens: str, c: EngineConfig) -> str:
    return f"round(CASE WHEN len({tokens}) = 0 THEN 0.0 ELSE 1000.0::DOUBLE * {hits(tokens, c.policy.topic)} / len({tokens}) END, 2)"


def language(declared: str, tokens: str, c: EngineConfig) -> str:
    first = f"({tokens})[1:{c.language_tokens}]"
    trimmed = sub(declared, rf"^[{text.SPACES}]+|[{text.SPACES}]+$")
    return (
        f"CASE WHEN coalesce({declared}, '') <> '' THEN substr(split_part(lower({trimmed}), '-', 1), 1, 2) "
        f"WHEN len({first}) >= {c.language_min_tokens} AND {hits(first, c.policy.function_words)}::DOUBLE / len({first}) > {c.language_share} "
        "THEN 'en' ELSE 'xx' END"
    )


def reason(c: EngineConfig) -> str:
    return (
        f"CASE WHEN idioma NOT IN ({', '.join(q(x) for x in c.languages)}) THEN 'idioma' WHEN palabras < {c.min_words} THEN 'longitud' "
        f"WHEN puntaje_tema < {c.min_topic_score} THEN 'tema' WHEN densidad_tema < {c.min_topic_density} THEN 'densidad' END"
    )


def domain(url: str) -> str:
    return f"regexp_replace(split_part(lower(regexp_extract(ltrim({url}), {q(urls.AUTHORITY)}, 1)), ':', 1), '^www[.]', '')"


def trap(url: str, c: EngineConfig) -> str:
    return f"regexp_matches({url}, {q('(?i)(' + '|'.join(c.policy.traps) + ')')})"


def below(dom: str, hosts) -> str:
    return f"regexp_matches({dom}, {q('(^|[.])(' + urls.quoted(hosts) + ')$')})"


def vetoed(dom: str, c: EngineConfig) -> str:
    p = c.policy
    return (
        f"CASE WHEN {below(dom, p.allowed_hosts)} THEN false WHEN starts_with({dom}, 'm.') OR contains({dom}, '.m.') THEN true "
        f"WHEN {dom} IN ({', '.join(q(x) for x in p.vetoed_exact)}) THEN true WHEN {below(dom, p.vetoed_hosts)} THEN true "
        f"ELSE regexp_matches({dom}, {q(urls.quoted(p.vetoed_words))}) END"
    )


def other_language(dom: str, c: EngineConfig) -> str:
    p = c.policy
    return (
        f"CASE WHEN {below(dom, p.allowed_hosts)} THEN false "
        f"WHEN regexp_matches({dom}, {q('(' + urls.quoted(p.edition_endings) + ')$')}) THEN {dom} <> {q(p.allowed_edition)} "
        f"ELSE split_part({dom}, '.', 1) IN ({', '.join(q(x) for x in p.language_labels)}) END"
    )


def promising(url: str, anchor: str, c: EngineConfig) -> str:
    return f"list_has_any({regex_all(f'lower({url} || {q(chr(32))} || {anchor})', '[a-z]+')}, {listed(c.policy.topic)})"


def frontier_reason(url: str, dom: str, inside: str, c: EngineConfig) -> str:
    return (
        f"CASE WHEN ({vetoed(dom, c)}) OR ({other_language(dom, c)}) THEN 'frontera_dominio_descartado' "
        f"WHEN {trap(url, c)} THEN 'frontera_trampa_descartada' "
        f"WHEN NOT {inside} AND NOT {promising(url, q(''), c)} THEN 'frontera_fuera_de_tema' END"
    )


def entities(value: str) -> str:
    for name, character in html.ENTITIES:
        value = f"replace({value}, {q(name)}, {q(character)})"
    return value


def main_text(value: str, c: EngineConfig) -> str:
    value = f"coalesce({value}, '')"
    for tag in c.policy.dropped_tags:
        value = sub(value, html.subtree(tag), "\n")
    return clean(entities(sub(sub(value, html.COMMENT), html.TAG, "\n")))


def title(value: str) -> str:
    return f"coalesce(trim({entities(f'regexp_extract({value}, {q(html.TITLE)}, 1)')}), '')"


def declared(value: str) -> str:
    return f"nullif(regexp_extract({value}, {q(html.LANG)}, 1), '')"


def mentions(value: str, c: EngineConfig) -> str:
    low = f"lower(coalesce({value}, ''))"
    return "(" + " + ".join(f"len({regex_all(low, stem)})" for stem in c.policy.probes) + ")"


def links(value: str) -> str:
    """List of structs href, anchor."""
    plain = sub(sub(value, html.subtree("script")), html.COMMENT)
    return (
        f"list_zip(list_transform({regex_all(plain, html.LINK, 1)}, lambda x: trim({entities('x')})), "
        f"list_transform({regex_all(plain, html.LINK, 2)}, lambda x: trim({sub('x', html.TAG)})))"
    )


def resolve(base: str, href: str) -> str:
    part = lambda k: f"regexp_extract({base}, {q(urls._SPLIT)}, {k})"
    return (
        f"CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} "
        f"WHEN starts_with({href}, '//') THEN regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || {href} "
        f"WHEN starts_with({href}, '/') THEN {part(1)} || {href} WHEN starts_with({href}, '?') THEN {part(1)} || {part(2)} || {href} "
        f"WHEN starts_with({href}, '#') OR {href} = '' THEN regexp_replace({base}, '#.*$', '') || {href} "
        f"ELSE {part(1)} || CASE WHEN {part(2)} = '' THEN '/' ELSE regexp_replace({part(2)}, '[^/]*$', '') END || {href} END"
    )


def canonical(url: str) -> str:
    part = lambda k: f"regexp_extract({url}, {q(urls._SPLIT)}, {k})"
    return (
        f"CASE WHEN regexp_matches({url}, {q(urls._SPLIT)}) THEN {part(1)} || CASE WHEN {part(2)} = '' THEN '/' ELSE {part(2)} END "
        f"|| CASE WHEN {part(3)} IN ('', '?') THEN '' ELSE '?' || array_to_string(list_sort(string_split(substr({part(3)}, 2), '&')), '&') END "
        f"ELSE regexp_replace({url}, '#.*$', '') END"
    )


def extension_denied(url: str, c: EngineConfig) -> str:
    path = f"regexp_extract({url}, {q(urls._SPLIT)}, 2)"
    return f"lower(regexp_extract({path}, {q(r'\.([A-Za-z0-9]+)$')}, 1)) IN ({', '.join(q(x) for x in c.policy.extensions)})"
