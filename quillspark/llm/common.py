"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word patterns of this subpackage use it.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of an input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where the setting is missing on a local master (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage: losing an executor later costs a re-read of files that every executor sees, not a
    recomputation. The folder is named after the application, so that it can be cleared with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillspark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hands texts to Python in batches of so many rows, unless the session already asks for fewer than the default.

    A document may be long; with the default of 10000 rows two Python workers hold hundreds of megabytes.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) >= 10_000:
        spark.conf.set(key, str(rows))


#: Rows of a narrow (id or hash) table up to which it may be broadcast; beyond that both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(narrow: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """narrow (materialised, a few longs a row) with a broadcast hint if its counted size allows, else as it is."""
    return F.broadcast(narrow) if narrow.count() <= rows else narrow


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else left alone."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, however often lambdas inside body use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string array; null counts as empty."""
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    return bounds - bounds[0], np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]


def slices(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each; a longer row has a range of its own."""
    start, rows = 0, len(bounds) - 1
    while start < rows:
        end = int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each of 64 bits over all others."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
