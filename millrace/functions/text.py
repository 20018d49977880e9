"""Text functions as Column expressions: cleaning, counting, topic scores, language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.config import EngineConfig, Policy

#: White space as Unicode and ASCII separators define it, for regex classes.
SPACES = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space that does not end a line.
INLINE = r"[ \t\x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
_EDGE = INLINE[:-1] + r"\n]"
#: Cleaning steps in order: pattern and replacement.
CLEANING = (
    (r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]", "\n"),
    (r"[ \t]+", " "),
    (rf"{INLINE}*\n{INLINE}*", "\n"),
    (r"\n{3,}", "\n\n"),
    (rf"\A{_EDGE}+|{_EDGE}+\z", ""),
)
#: The same steps for an engine that backtracks: no loop takes the stack, and a run
#: of white space is tried from its first character only, so any text takes linear time.
_LINEAR_CLEANING = (
    *CLEANING[:2],
    (rf"(?<!{INLINE}){INLINE}++(?=\n)", ""),
    (rf"(?<=\n){INLINE}++", ""),
    CLEANING[3],
    (rf"\A{_EDGE}++|(?<!{_EDGE}){_EDGE}++\z", ""),
)
# The tokens that topics and statistics count.
TOPIC_TOKEN = r"[a-z]+(?:-[a-z]+)?"
STATS_TOKEN = "[a-záéíóúüñ]+(?:[-'][a-záéíóúüñ]+)*"
#: STATS_TOKEN with loops that do not take the stack.
_LINEAR_STATS_TOKEN = "[a-záéíóúüñ]++(?:[-'][a-záéíóúüñ]++)*+"
WORD = rf"[^{SPACES}]+"


def clean(text: Column) -> Column:
    """Normalised text: one space inside lines, trimmed lines, at most one blank line in a row."""
    for pattern, replacement in _LINEAR_CLEANING:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def word_count(text: Column) -> Column:
    """Runs of characters that are no Unicode white space; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def topic_tokens(text: Column) -> Column:
    """Lower-case ASCII words, of at most one hyphen; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOPIC_TOKEN), F.lit(0))


def topic_score(tokens: Column, policy: Policy) -> Column:
    """Distinct topic terms among the tokens; core terms count twice."""
    present = F.array_distinct(F.filter(tokens, lambda t: t.isin(*policy.topic)))
    return F.size(present) + F.size(F.filter(present, lambda t: t.isin(*policy.core)))


def topic_density(tokens: Column, policy: Policy) -> Column:
    """Topic terms per thousand tokens, at two decimals (half away from zero); 0 without tokens."""
    hits = F.size(F.filter(tokens, lambda t: t.isin(*policy.topic)))
    return F.round(F.coalesce(F.try_divide(F.lit(1000.0) * hits, F.size(tokens)), F.lit(0.0)), 2)


def language(declared: Column, tokens: Column, config: EngineConfig) -> Column:
    """Two letters of the declared language, else en or xx by the share of function words in the first tokens."""
    first = F.slice(tokens, 1, config.language_tokens)
    functional = F.size(F.filter(first, lambda t: t.isin(*config.policy.function_words)))
    guessed = F.when(
        (F.size(first) >= config.language_min_tokens) & (functional / F.size(first) > config.language_share), "en"
    ).otherwise("xx")
    code = F.substring(F.split(F.lower(F.regexp_replace(declared, rf"\A[{SPACES}]++|(?<![{SPACES}])[{SPACES}]++\z", "")), "-")[0], 1, 2)
    return F.when(F.coalesce(declared, F.lit("")) != "", code).otherwise(guessed)


def stats_tokens(text: Column) -> Column:
    """Words for corpus statistics: letters with Spanish accents, joined by any number of hyphens and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?iu){_LINEAR_STATS_TOKEN}"), F.lit(0))


def content_type(header: Column) -> Column:
    return F.lower(F.trim(F.split(header, ";")[0]))


def first_given(*values: Column) -> Column:
    """The first value that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def local_iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ssXXX")


def storage_path(domain: Column, digest: Column) -> Column:
    """Where a text is stored: domain, two digits of its hash, its hash."""
    return F.concat_ws("/", domain, F.substring(digest, 1, 2), F.concat(digest, F.lit(".txt")))


def disk_bytes(length: Column) -> Column:
    """Bytes on disk in blocks of 4096; empty files take one."""
    return F.greatest(F.lit(1), F.floor((length + 4095) / 4096)).cast("bigint") * 4096


def mebibytes(n: Column) -> Column:
    return n / F.lit(1048576.0)


def gibibytes(n: Column) -> Column:
    return n / F.lit(1073741824.0)


def cut(text: Column, length: int) -> Column:
    return F.left(text, F.lit(length))


def event_line(kind: str, *parts: Column) -> Column:
    """One line of an event log."""
    return F.concat_ws(" ", F.rpad(F.lit(kind), 9, " "), *[p.cast("string") for p in parts])
