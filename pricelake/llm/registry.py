"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import chat, decontam, divergence, embedding_dedup, fingerprint, language, lm, manifest, mixing, ngram_join, pii, quality, suffix_dedup

MODULES = (language, quality, pii, lm, fingerprint, chat, decontam, suffix_dedup, mixing, ngram_join, divergence, manifest, embedding_dedup)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
