"""Hard-negative mining with bit-sliced integer products.

Vectors are scaled to integers. A product of an anchor and a row is built from the row's bit planes, the most significant
first: after each plane the rest can only lie between the sums of the anchor's negative and of its positive components
times what the lower planes can hold, so every pair has an interval that halves with each plane. A pair is dropped once
its interval can neither reach the k-th best found so far nor meet a window of wanted scores; what is left at the last
plane has its exact score. Planes run as matrix products while many pairs are alive, and pair by pair after that.

Anchors are a stated query set against all rows. They go to the tasks in blocks of a fixed number of bytes; each task
reads its rows once a block and returns the k best it met of each anchor, and these meet by anchor. The first pass
finds positives (same label), the second the negatives inside the windows that the positives' scores give.

Rows with a null label, a null vector or a null or non-finite component take no part. Rows with a null id do, and come
last in ties. Shorter vectors count as if zeros followed. Components beyond 2^20 after scaling are cut to it, which
keeps products exact. Rows that repeat are rows of their own: an anchor's copy may be its positive. Ids and labels are
integers. Empty tables give no rows; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, table

SCALE, POSITIVES, NEGATIVES, NEAR = 256, 5, 5, 80
#: Largest scaled component.
LARGEST = 1 << 20
#: Bytes of anchors that are sent to all tasks at a time.
ANCHOR_BYTES = 32 << 20
#: Rows and anchors of one matrix product.
ROWS_AT_ONCE, ANCHORS_AT_ONCE = 4096, 512
#: Share of pairs alive below which planes are added pair by pair.
FEW = 0.05

Keep = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def bit_planes(x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(value of a set bit, most that lower planes can hold, plane of zeros and ones) of integers, the highest first."""
    top = int(np.abs(x).max(initial=0)).bit_length()
    yield -(1 << top), (1 << top) - 1, x < 0
    for b in range(top - 1, -1, -1):
        yield 1 << b, (1 << b) - 1, (x >> b) & 1 != 0


def products(q: np.ndarray, x: np.ndarray, keep: Keep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of q, row of x, exact product of the pairs that keep(i, j, low, high) lets pass at every plane.

    keep is asked with arrays that broadcast against each other; it must be true of a pair whose interval may qualify.
    """
    most = int(np.abs(q).sum(1).max(initial=0)) << (int(np.abs(x).max(initial=0)).bit_length() + 1)
    kind = np.float32 if most < 1 << 24 else np.float64  # sums stay exact
    q = q.astype(kind)
    under, over = np.minimum(q, 0).sum(1), np.maximum(q, 0).sum(1)
    every = np.arange(len(q))[:, None], np.arange(len(x))[None, :]
    i = j = None
    part = np.zeros((len(q), len(x)), kind)
    for value, rest, plane in bit_planes(x):
        if i is None:
            part += value * (q @ plane.T.astype(kind))
            alive = keep(*every, part + rest * under[:, None], part + rest * over[:, None])
            if not rest or np.count_nonzero(alive) < FEW * alive.size:
                i, j = np.nonzero(alive)
                part = part[i, j]
        else:
            part = part + value * np.einsum("nd,nd->n", q[i], plane[j].astype(kind))
            alive = keep(i, j, part + rest * under[i], part + rest * over[i])
            i, j, part = i[alive], j[alive], part[alive]
    return i, j, part.astype(np.int64)


class Best:
    """The k best (score, id) of each of n groups, ties by smaller id, null ids last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id, self.none = np.zeros((n, k), np.int64), np.ones((n, k), bool)

    @property
    def bar(self) -> np.ndarray:
        """The k-th best score of each group, the least integer where there are fewer."""
        return self.score[:, -1]

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        if not len(group):
            return
        touched = np.unique(group)
        columns = [np.concatenate((np.repeat(touched, self.k), group))]
        columns += [np.concatenate((old[touched].ravel(), new)) for old, new in ((self.score, score), (self.id, ids), (self.none, none))]
        order = np.lexsort((columns[2], columns[3], -columns[1].astype(np.float64), columns[0]))
        group, score, ids, none = (c[order] for c in columns)
        place = np.arange(len(group)) - np.searchsorted(group, group)
        best = place < self.k
        at = group[best], place[best]
        self.score[at], self.id[at], self.none[at] = score[best], ids[best], none[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Group, score, id of what was found."""
        group, place = np.nonzero(self.score > np.iinfo(np.int64).min)
        return group, self.score[group, place], pa.array(self.id[group, place], mask=self.none[group, place])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer lists as rows of a matrix, filled up with zeros."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return flat.reshape(len(column), width).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def prepare(vectors: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), id, label, anchor, q (integer components) of the rows that take part; written."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(x.cast("double") * float(scale)), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    wanted = vectors.where(label.isNotNull() & v.isNotNull() & finite)
    return materialize(wanted.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("q")))


def _against_all(rows: DataFrame, queries: DataFrame, width: int, task: Callable, schema: str) -> DataFrame:
    """What task(queries as Arrow table) maps the batches of rows to, for all queries in blocks of ANCHOR_BYTES."""
    spark = rows.sparkSession
    n = queries.count()
    blocks = max(1, -(-n * 4 * max(width, 1) // ANCHOR_BYTES))
    found = None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block) if blocks > 1 else queries
        sent = spark.sparkContext.broadcast(own.toArrow().combine_chunks())  # of a bounded size
        part = rows.select("row", "id", "label", "q").mapInArrow(task(sent), schema)
        part = materialize(part) if blocks > 1 else part
        found = part if found is None else found.unionByName(part)
    return found


def positives(rows: DataFrame, k: int = POSITIVES) -> DataFrame:
    """row, ids, scores of each anchor: its k best other rows of the same label."""
    width = rows.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]

    def task(sent):
        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            anchors = sent.value
            own, label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
            q = _matrix(anchors["q"].combine_chunks(), width) if len(own) else np.zeros((0, width), np.int64)
            at = {x: np.flatnonzero(label == x) for x in np.unique(label).tolist()}
            top = Best(len(own), k)
            for batch in batches:
                numbers, labels, x = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3), width)
                ids, none = batch.column(1).fill_null(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
                for value in np.unique(labels).tolist():
                    alike = np.flatnonzero(labels == value)
                    for a in range(0, len(at.get(value, ())), ANCHORS_AT_ONCE):
                        mine = at[value][a : a + ANCHORS_AT_ONCE]
                        for c in range(0, len(alike), ROWS_AT_ONCE):
                            these = alike[c : c + ROWS_AT_ONCE]
                            bar = top.bar[mine].astype(np.float64)

                            def keep(i, j, low, high, bar=bar):
                                if low.ndim == 2 and low.shape[1] > k:  # one of k + 1 may be the anchor itself
                                    np.maximum(bar, np.partition(low, low.shape[1] - k - 1, axis=1)[:, -k - 1], out=bar)
                                return high >= bar[i]

                            i, j, score = products(q[mine], x[these], keep)
                            other = own[mine[i]] != numbers[these[j]]
                            i, j, score = mine[i[other]], these[j[other]], score[other]
                            top.add(i, score, ids[j], none[j])
            group, score, found = top.rows()
            yield pa.RecordBatch.from_arrays([pa.array(own[group]), found, pa.array(score)], names=["row", "id", "score"])

        return best

    met = _against_all(rows, rows.where("anchor"), width, task, "row long, id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    first = met.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)
    lists = first.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "id", "score"))).alias("p"))
    return lists.select("row", F.col("p.id").alias("ids"), F.col("p.score").alias("scores"))


def hard_negatives(rows: DataFrame, near: int = NEAR, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows: what prepare returns.

    A negative's score is at least near percent of the positive's, and at most all of it.
    """
    width = rows.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0]
    found = materialize(positives(rows, n_positives))
    queries = materialize(rows.where("anchor").select("row", "id", "label", "q").join(found, "row"))

    def task(sent):
        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            anchors = sent.value
            n = len(anchors)
            own, label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
            q = _matrix(anchors["q"].combine_chunks(), width) if n else np.zeros((0, width), np.int64)
            scores = _windows(anchors["scores"], n_positives)
            least = -(-near * scores // 100)
            least[scores < least] = np.iinfo(np.int64).max  # no window below zero, nor where there is no positive
            top = Best(n * n_positives, n_negatives)
            for batch in batches:
                labels, x = batch.column(2).to_numpy(), _matrix(batch.column(3), width)
                ids, none = batch.column(1).fill_null(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
                for a in range(0, n, ANCHORS_AT_ONCE):
                    mine = slice(a, min(n, a + ANCHORS_AT_ONCE))
                    most = scores[mine]
                    for c in range(0, len(x), ROWS_AT_ONCE):
                        these = slice(c, c + ROWS_AT_ONCE)
                        bar = np.maximum(least[mine], top.bar.reshape(n, n_positives)[mine])
                        lowest, highest, unlike = bar.min(1).astype(np.float64), most.max(1).astype(np.float64), labels[these]

                        def keep(i, j, low, high, most=most, bar=bar, lowest=lowest, highest=highest, unlike=unlike, mine=mine):
                            if low.ndim == 2:
                                return (high >= lowest[i]) & (low <= highest[i])
                            met = np.zeros(len(low), bool)
                            for w in range(n_positives):
                                met |= (high >= bar[i, w]) & (low <= most[i, w])
                            return met & (label[mine][i] != unlike[j])

                        i, j, score = products(q[mine], x[these], keep)
                        for w in range(n_positives):
                            good = (score >= bar[i, w]) & (score <= most[i, w]) & (label[mine][i] != unlike[j])
                            top.add((a + i[good]) * n_positives + w, score[good], ids[these][j[good]], none[these][j[good]])
            group, score, negative = top.rows()
            take, w = pa.array(group // n_positives), group % n_positives
            positive = anchors["ids"].combine_chunks().take(take)
            positive = positive.flatten().take(pa.array(positive.offsets.to_numpy()[:-1] - (positive.offsets[0].as_py() if len(positive) else 0) + w)) if len(group) else pa.array([], pa.int64())
            columns = [pa.array(own[group // n_positives]), pa.array(w.astype(np.int32)), anchors["id"].combine_chunks().take(take), positive, negative, pa.array(scores[group // n_positives, w]), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "w", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

        return best

    met = _against_all(rows, queries, width, task, "row long, w int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("row", "w").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last())
    first = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return first.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _windows(scores: pa.ChunkedArray, k: int) -> np.ndarray:
    """The positives' scores of each anchor, a row of k, filled up with the least integer."""
    column = scores.combine_chunks()
    out = np.full((len(column), k), np.iinfo(np.int64).min // 200)
    sizes = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over all embeddings."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(prepare(vectors, "vec_id", "embedding", label, F.col("vec_id") % 100 == 0))


QUERIES = {"op11_hard_negatives": op11_hard_negatives}

ORACLES = {
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q, row_number() OVER () AS r
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.r AS a, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) AS k FROM s WHERE alike QUALIFY k <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.id NULLS LAST)::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON p.a = s.a AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM n WHERE rank <= 5
"""
}
