"""Registration of queries whose SQL text runs on both engines, and spellings in which the engines differ (s: Spark's)."""

from __future__ import annotations

from quillspark.sources.adapters import on_duckdb, on_spark


def both(sqls: dict[str, str]) -> tuple[dict, dict[str, str]]:
    """QUERIES and ORACLES of SQL texts."""
    runs = {name: (lambda spark, sf_dir, sql=sql: on_spark(spark, sf_dir, sql)) for name, sql in sqls.items()}
    return runs, {name: on_duckdb(sql) for name, sql in sqls.items()}


def each(array: str, s: bool) -> str:
    return f"explode({array})" if s else f"unnest({array})"


def distinct(array: str, s: bool) -> str:
    return f"array_distinct({array})" if s else f"list_distinct({array})"


def length_of(array: str, s: bool) -> str:
    return f"size({array})" if s else f"len({array})"


def filtered(array: str, condition: str, s: bool) -> str:
    """The elements x of an array that meet a condition."""
    return f"filter({array}, x -> {condition})" if s else f"list_filter({array}, lambda x: {condition})"


def mapped(array: str, body: str, s: bool) -> str:
    """body for each element x of an array."""
    return f"transform({array}, x -> {body})" if s else f"list_transform({array}, lambda x: {body})"


def concat_list(array: str, by: str, s: bool) -> str:
    return f"array_join({array}, '{by}')" if s else f"array_to_string({array}, '{by}')"
