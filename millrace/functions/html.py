"""HTML functions as Column expressions: text, title, language, links, richness."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.config import DROPPED_TAGS, Policy
from millrace.functions import text

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
LANG = r"""(?i)<html[^>]*\blang=["']([^"']*)["']"""
LINK = r"""(?is)<a\s[^>]*?href=["']([^"']*)["'][^>]*>(.*?)</a>"""
COMMENT = r"(?s)<!--.*?-->"
TAG = r"(?s)<[^>]*>"
#: In order; the ampersand last, so that what it makes is not decoded again.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"),
)


def subtree(tag: str) -> str:
    return rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"


def decode_entities(value: Column) -> Column:
    for name, character in ENTITIES:
        value = F.replace(value, F.lit(name), F.lit(character))
    return value


def stripped(html: Column, policy: Policy) -> Column:
    """HTML without comments and the subtrees of the dropped tags, the outer of nested ones first, in one pass."""
    tags = "|".join(policy.dropped_tags)
    return F.regexp_replace(F.regexp_replace(html, rf"(?is)<({tags})\b[^>]*+>.*?</\1\s*+>", "\n"), COMMENT, "")


def main_text(html: Column, policy: Policy) -> Column:
    """Text nodes, one per line, cleaned. Same-name tags nested in a dropped one end it at the first close."""
    return text.clean(decode_entities(F.regexp_replace(stripped(F.coalesce(html, F.lit("")), policy), TAG, "\n")))


def title(html: Column) -> Column:
    return F.coalesce(F.trim(decode_entities(F.regexp_extract(html, TITLE, 1))), F.lit(""))


def declared_language(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, LANG, 1), F.lit(""))


def links(html: Column) -> Column:
    """Array of structs href, anchor, in page order."""
    plain = F.regexp_replace(F.regexp_replace(html, subtree("script"), ""), COMMENT, "")
    return F.zip_with(
        F.regexp_extract_all(plain, F.lit(LINK), F.lit(1)),
        F.regexp_extract_all(plain, F.lit(LINK), F.lit(2)),
        lambda href, inner: F.struct(
            F.trim(decode_entities(href)).alias("href"), F.trim(F.regexp_replace(inner, TAG, "")).alias("anchor")
        ),
    )


def probe_mentions(html: Column, policy: Policy) -> Column:
    """How often the probe stems occur in the raw page, without overlaps."""
    low = F.lower(F.coalesce(html, F.lit("")))
    total = F.lit(0)
    for stem in policy.probes:
        total = total + F.regexp_count(low, F.lit(stem))
    return total


def is_rich(html: Column, policy: Policy, mentions: int) -> Column:
    return probe_mentions(html, policy) >= mentions


class _Reader(HTMLParser):
    def __init__(self, dropped):
        super().__init__(convert_charrefs=True)
        self.dropped, self.depth, self.out = set(dropped), [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.dropped:
            self.depth.append(tag)

    def handle_endtag(self, tag):
        if tag in self.depth:
            while self.depth.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


@F.pandas_udf(StringType())
def tree_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As main_text() before cleaning, by a parser that follows nesting: for pages where the expressions fall short."""
    for batch in pages:
        out = []
        for page in batch:
            reader = _Reader(DROPPED_TAGS)
            reader.feed(page or "")
            reader.close()
            out.append("\n".join(reader.out))
        yield pd.Series(out, dtype="object")
