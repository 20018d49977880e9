"""URL and host functions and predicates as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.config import Policy

AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_SPLIT = r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def quoted(words) -> str:
    """Alternation of literal words for a regex that Java and RE2 read alike."""
    return "|".join("".join(c if c.isalnum() or c in "_" else f"[{c}]" if c not in "-^\\]" else f"\\{c}" for c in w) for w in words)


def domain(url: Column) -> Column:
    """Host of the URL in lower case, cut at its first colon, without one leading www.; empty without an authority."""
    host = F.split(F.lower(F.regexp_extract(F.ltrim(url), AUTHORITY, 1)), ":")[0]
    return F.regexp_replace(host, "^www[.]", "")


def is_trap(url: Column, policy: Policy) -> Column:
    return url.rlike("(?i)(" + "|".join(policy.traps) + ")")


def is_host_of(domain_: Column, hosts) -> Column:
    """Whether the domain is one of the hosts or below one."""
    return domain_.rlike(f"(^|[.])({quoted(hosts)})$")


def is_vetoed(domain_: Column, policy: Policy) -> Column:
    """Allowed hosts never are; mobile hosts, listed hosts, and labels that contain a listed word are."""
    return (
        F.when(is_host_of(domain_, policy.allowed_hosts), False)
        .when(domain_.startswith("m.") | domain_.contains(".m."), True)
        .when(domain_.isin(*policy.vetoed_exact), True)
        .when(is_host_of(domain_, policy.vetoed_hosts), True)
        .otherwise(domain_.rlike(quoted(policy.vetoed_words)))
    )


def is_other_language(domain_: Column, policy: Policy) -> Column:
    """Editions other than the allowed one, and hosts whose first label is a language."""
    edition = domain_.rlike(f"({quoted(policy.edition_endings)})$")
    return (
        F.when(is_host_of(domain_, policy.allowed_hosts), False)
        .when(edition, domain_ != policy.allowed_edition)
        .otherwise(F.split(domain_, "[.]")[0].isin(*policy.language_labels))
    )


def is_promising(url: Column, anchor: Column | None, policy: Policy) -> Column:
    """Whether a whole alphabetic word of the URL or anchor is a topic term."""
    told = F.concat(url, F.lit(" "), F.coalesce(anchor, F.lit("")) if anchor is not None else F.lit(""))
    return F.exists(F.regexp_extract_all(F.lower(told), F.lit("[a-z]+"), F.lit(0)), lambda t: t.isin(*policy.topic))


def is_denied_extension(url: Column, policy: Policy) -> Column:
    path = F.regexp_extract(url, _SPLIT, 2)
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*policy.extensions)


def frontier_reason(url: Column, domain_: Column, in_seeds: Column, policy: Policy) -> Column:
    """Why a queued URL is dropped, or null; the anchor it was found by does not count."""
    return (
        F.when(is_vetoed(domain_, policy) | is_other_language(domain_, policy), "frontera_dominio_descartado")
        .when(is_trap(url, policy), "frontera_trampa_descartada")
        .when(~in_seeds & ~is_promising(url, None, policy), "frontera_fuera_de_tema")
    )


def canonical(url: Column) -> Column:
    """URL without its fragment and with its query's arguments in order; an empty path becomes /."""
    path = F.regexp_extract(url, _SPLIT, 2)
    query = F.regexp_extract(url, _SPLIT, 3)
    ordered = F.array_join(F.array_sort(F.split(F.substr(query, F.lit(2)), "&")), "&")
    return F.when(
        url.rlike(_SPLIT),
        F.concat(
            F.regexp_extract(url, _SPLIT, 1),
            F.when(path == "", "/").otherwise(path),
            F.when(query.isin("", "?"), "").otherwise(F.concat(F.lit("?"), ordered)),
        ),
    ).otherwise(F.regexp_replace(url, "#.*$", ""))


def resolve(base: Column, href: Column) -> Column:
    """Link target against its page, without dot segments: absolute, //host, /path, ?query, #fragment, name."""
    origin = F.regexp_extract(base, _SPLIT, 1)
    path = F.regexp_extract(base, _SPLIT, 2)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(origin, F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", "")), href))
    )


@F.pandas_udf(StringType())
def resolve_exact(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """As resolve(), with dot segments: for pages that need them. Links that cannot be parsed become null."""
    for bases, hrefs in parts:
        out = []
        for base, href in zip(bases, hrefs):
            try:
                out.append(urljoin(base or "", href or ""))
            except ValueError:
                out.append(None)
        yield pd.Series(out, dtype="object")
