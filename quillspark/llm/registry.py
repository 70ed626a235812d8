"""Collects the queries and SQL of this subpackage."""

from __future__ import annotations

from quillspark.llm import chat, decontam, langid, licenses, linededup, mixing, negatives, pii, quality, resample, simhash, substrings, urlrank

MODULES = (decontam, simhash, langid, licenses, substrings, quality, linededup, mixing, urlrank, chat, resample, negatives, pii)


def queries() -> dict:
    """Query name to a callable of (spark, sf_dir)."""
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
