"""Collects the queries and their SQL from the operator modules."""

from __future__ import annotations

from quillspark.plans import catalogue, details, jobs, monitoring, normalise, payloads, retrieval, retry, series, skilldocs, skills, textops, tickets, toolbox
from quillspark.streaming import health, incidents, lifecycle, upserts

MODULES: tuple = (catalogue, monitoring, normalise, jobs, retrieval, textops, skills, health, incidents, lifecycle, upserts, tickets, skilldocs, retry, series, toolbox, details, payloads)


def queries() -> dict:
    """Query name to a callable of (spark, sf_dir)."""
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
