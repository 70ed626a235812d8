"""A persisted vector index: coarse cells fitted on a bounded sample, every row filed under its cell.

On disk an index is three Parquet tables: `cells` (cell, centre), `rows`, partitioned by cell, and `probes`. A search
looks up the cells nearest to each query, and only rows of those cells meet the query, which the exact cosine then
ranks. Rows and queries of a cell meet in blocks of a fixed size, so a cell with a third of all rows is many tasks and
no task holds a whole cell. With few queries only the folders of their cells are read.

How many cells a search has to look at depends on the data: with clusters a few, with vectors that point anywhere most
of them. So building ends with a measurement: a fixed number of rows ask, in one pass over all rows, and the number of
cells that would have found the wanted share of their true neighbours is kept as the index's number of probes.

Vectors that are null, empty or without length (all zeros) are filed under cell -1, which every query looks at: nothing
is dropped from the index. Vectors of a width other than the index's are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most cells, and sampled rows for each cell; so the sample has 262144 rows at most.
MOST_CELLS, SAMPLE_PER_CELL = 4096, 64
#: Rows and queries of a cell that meet in one task at a time.
ROWS_AT_ONCE, QUERIES_AT_ONCE = 20_000, 2_000
#: Share of true neighbours that a search is to find, and how many rows ask for how many neighbours to measure it.
RECALL, ASKING, NEIGHBOURS = 0.95, 200, 10
#: Up to so many wanted cells are named in the scan, which then skips the folders of others.
NAMED_CELLS = 512

_NOWHERE = -1


def _unit(column: str):
    """The vector as doubles of length one; null if it has no direction."""
    v = F.transform(column, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(size > 0, F.transform(v, lambda x: x / size))


def build_index(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", cells: int | None = None, seed: int = 1, recall: float = RECALL) -> str:
    """Fits cells on a sample, files every row of vectors under path, measures the probes for recall, and returns the path.

    The number of cells is the square root of the number of rows, MOST_CELLS at most, unless it is given.
    """
    named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    n = named.count()
    widths = [r[0] for r in named.where("size(embedding) > 0").select(F.size("embedding")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError(f"vectors of different widths: {sorted(widths)}")
    cells = cells or max(1, min(MOST_CELLS, round(n**0.5)))
    share = min(1.0, cells * SAMPLE_PER_CELL / max(1, n))
    # by a hash of the vector: a sample that reruns repeat, and in which copies are one
    sample = named.select(_unit("embedding").alias("v")).where("v is not null").where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < share * (1 << 20)).distinct()
    spark = vectors.sparkSession
    centres = _centres(sample, cells, seed)
    table = spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "cell int, centre array<double>")
    table.write.mode("overwrite").parquet(f"{path}/cells")
    file_rows(named, path, mode="overwrite")
    probes = _probes_for(named, path, recall, n)
    spark.createDataFrame([(probes, recall)], "probes int, recall double").write.mode("overwrite").parquet(f"{path}/probes")
    return path


def _probes_for(named: DataFrame, path: str, recall: float, n: int) -> int:
    """How many cells hold the wanted share of the true neighbours of ASKING rows, picked by a hash."""
    spark = named.sparkSession
    centres = _centre_matrix(spark, path)
    if not len(centres):
        return 1
    share = min(1.0, 2 * ASKING / max(1, n))
    own = named.where("embedding is not null").where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20)).limit(ASKING)
    asked = own.toArrow()  # ASKING rows at most
    q, good = _matrix(asked["embedding"].combine_chunks(), centres.shape[1])
    ids, q = asked["id"].combine_chunks().filter(pa.array(good)), q[good]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1, kind="stable").astype(np.int32)  # of each cell for each query
    sent = spark.sparkContext.broadcast((ids, q, place))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, place = sent.value
        score, rank = np.full((len(q), NEIGHBOURS), -2.0), np.zeros((len(q), NEIGHBOURS), np.int32)
        known = {x: i for i, x in enumerate(ids.to_pylist())}
        for batch in batches:
            x, fine = _matrix(batch.column(1), q.shape[1])
            cells = batch.column(2).to_numpy()
            close = q @ x.T
            close[:, ~fine] = -2.0
            for j, x_id in enumerate(batch.column(0).to_pylist()):
                if x_id in known:
                    close[known[x_id], j] = -2.0  # not its own neighbour
            near = place[:, np.maximum(cells, 0)]
            both, ranks = np.concatenate((score, close), axis=1), np.concatenate((rank, near), axis=1)
            top = np.argpartition(-both, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]
            score, rank = np.take_along_axis(both, top, 1), np.take_along_axis(ranks, top, 1)
        i, j = np.nonzero(score > -2.0)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(score[i, j]), pa.array(rank[i, j])], names=["query", "score", "rank"])

    rows = spark.read.parquet(f"{path}/rows").select("id", "embedding", "cell")
    met = rows.mapInArrow(nearest, "query int, score double, rank int")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rank")
    ranks = sorted(r.rank for r in met.withColumn("k", F.row_number().over(best)).where(F.col("k") <= NEIGHBOURS).select("rank").collect())  # ASKING * NEIGHBOURS at most
    if not ranks:
        return 1
    return min(len(centres), ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] + 1)


def _centres(sample: DataFrame, cells: int, seed: int) -> list[list[float]]:
    points = sample.select(array_to_vector("v").alias("features"))
    if points.isEmpty():
        return []
    model = KMeans(k=max(2, cells), seed=seed, maxIter=10, distanceMeasure="cosine", initSteps=2).fit(points) if cells > 1 else None
    if model is None:
        return [[float(x) for x in sample.first()[0]]]
    return [[float(x) for x in c] for c in model.clusterCenters()]


def _centre_matrix(spark: SparkSession, path: str) -> np.ndarray:
    """The centres, MOST_CELLS rows at most."""
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").select("centre").limit(MOST_CELLS + 1).collect()
    return np.array([r[0] for r in rows], np.float64) if rows else np.zeros((0, 0))


def _near_cells(df: DataFrame, centres: np.ndarray, k: int) -> DataFrame:
    """df (id, embedding) with cells: the k nearest centres, nearest first; [-1] for vectors without a direction."""
    sent = df.sparkSession.sparkContext.broadcast(centres)  # bounded by MOST_CELLS
    width = centres.shape[1] if len(centres) else 0

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = sent.value
        for batch in batches:
            column = batch.column(batch.schema.names.index("embedding"))
            out: list[list[int]] = []
            for at in range(0, batch.num_rows, 1024):
                part = column.slice(at, 1024)
                x, good = _matrix(part, width)
                close = x @ middle.T if len(middle) else np.zeros((len(x), 0))
                best = np.argsort(-close, axis=1, kind="stable")[:, :k]
                out += [b.tolist() if ok and len(b) else [_NOWHERE] for b, ok in zip(best, good, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return df.mapInArrow(near, T.StructType([*df.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and whether each has a direction; another width is an error."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy()
    if width and ((sizes != width) & (sizes > 0)).any():
        raise ValueError(f"vector of width {int(sizes[(sizes != width) & (sizes > 0)][0])} in an index of width {width}")
    x = np.zeros((len(column), width))
    full = sizes == width if width else np.zeros(len(column), bool)
    if full.any():
        x[full] = column.filter(pa.array(full)).flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, width)
    size = np.sqrt((x * x).sum(1))
    good = (size > 0) & np.isfinite(size)
    x[good] /= size[good, None]
    x[~good] = 0
    return x, good


def file_rows(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Files rows (id, embedding) under the nearest cell of an index; large cells are spread over several files."""
    spark = rows.sparkSession
    filed = _near_cells(rows.select("id", "embedding"), _centre_matrix(spark, path), 1).select("id", "embedding", F.element_at("cells", 1).alias("cell"))
    dealt = filed.repartitionByRange("cell", F.xxhash64("id"))
    dealt.write.mode(mode).partitionBy("cell").parquet(f"{path}/rows")


def _kept_probes(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/probes").first().probes


def search(queries: DataFrame, path: str, k: int = 10, probes: int | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """query_id, id, score (cosine), rnk: the k nearest rows of the index for each query, ties by id; a row of the query's own id is left out."""
    spark = queries.sparkSession
    centres = _centre_matrix(spark, path)
    probes = probes or _kept_probes(spark, path)
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    wanted = _near_cells(asked, centres, probes).select("id", "embedding", F.explode(F.array_union("cells", F.array(F.lit(_NOWHERE)))).alias("cell"))
    rows = spark.read.schema("id long, embedding array<float>, cell int").parquet(f"{path}/rows") if asked.schema["id"].dataType.simpleString() == "bigint" else spark.read.parquet(f"{path}/rows")
    named = [r[0] for r in wanted.select("cell").distinct().limit(NAMED_CELLS + 1).collect()]
    if len(named) <= NAMED_CELLS:
        rows = rows.where(F.col("cell").isin(named))
    # a grid: each block of a cell's rows meets each block of its queries once
    blocks = rows.groupBy("cell").agg(F.ceil(F.count("*") / ROWS_AT_ONCE).alias("row_blocks"))
    asks = wanted.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES_AT_ONCE).alias("query_blocks"))
    grid = F.broadcast(blocks.join(asks, "cell"))  # a row for each cell, MOST_CELLS + 1 at most
    spread = lambda own, other: (F.pmod(F.xxhash64("id"), F.col(own)).alias(own[:-1]), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other[:-1]))
    left = rows.join(grid, "cell").select("cell", "id", "embedding", *spread("row_blocks", "query_blocks"))
    right = wanted.join(grid, "cell").select("cell", "id", "embedding", *spread("query_blocks", "row_blocks"))
    keys = ["cell", "row_block", "query_block"]
    kind = asked.schema["id"].dataType.simpleString()
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best_of(k, centres.shape[1] if len(centres) else 0), f"query_id {kind}, id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)


def _best_of(k: int, width: int):
    """The k best rows of a block for each of its queries, by cosine rounded to a millionth."""

    def best(rows: pa.Table, queries: pa.Table) -> pa.Table:
        x, _ = _matrix(rows["embedding"].combine_chunks(), width)
        q, _ = _matrix(queries["embedding"].combine_chunks(), width)
        ids, asked = rows["id"].combine_chunks(), queries["id"].combine_chunks()
        order = pa.compute.sort_indices(ids)
        ids, x = ids.take(order), x[order.to_numpy()]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(q), 256):
            score = np.floor((q[at : at + 256] @ x.T) * 1e6 + 0.5) / 1e6
            n = min(k + 1, score.shape[1])
            top = np.argsort(-score, axis=1, kind="stable")[:, :n]
            found.append((np.repeat(np.arange(at, at + len(score)), n), top.ravel(), np.take_along_axis(score, top, 1).ravel()))
        i, j, score = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))
        table = pa.table({"query_id": asked.take(pa.array(i.astype(np.int64))), "id": ids.take(pa.array(j.astype(np.int64))), "score": pa.array(score.astype(np.float64))})
        return table.filter(pa.compute.not_equal(table["query_id"], table["id"]))

    return best
