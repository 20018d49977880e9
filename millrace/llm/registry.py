"""Registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from millrace.llm import (
    chat,
    exact_dedup,
    mixing,
    pieces,
    quality,
    secrets,
    simhash,
    toxicity,
    urls,
    warc,
)

MODULES = (secrets, toxicity, exact_dedup, mixing, simhash, pieces, urls, warc, chat, quality)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
