"""Rows in the order in which the files hold them, for rules that speak of the last rows of a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns that give a row its place: the file's name, then the row's number in it.
PLACE = ("_file", "_row")


def read_in_order(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The Parquet rows of path with their place; files follow each other by name."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


def tail(ordered: DataFrame, n: int) -> DataFrame:
    """The last n rows in source order; each task keeps n rows at most, nothing is sorted as a whole."""
    return ordered.orderBy(*[F.desc(c) for c in PLACE]).limit(n)
