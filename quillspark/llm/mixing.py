"""Mixing sources to target weights with hash-threshold histograms.

A document's size is its word count. Sources share the total of all sizes by weight; no target exceeds `most` times
its source's size, and what is over goes to the others by weight. A source whose target is f times its size takes
every document floor(f) times, and once more the documents whose hash lies under a threshold. The threshold comes
from histograms: sizes are summed by source and leading hash digits, the last bucket that fits the budget is found
by a running sum, and only the bucket after it is looked into by the next digits, down to single hashes; the
document at the boundary is taken if that ends nearer to the target. Documents are never sorted.

The hash is a digest of id and text, so reruns agree, and rows without an id are told apart by their texts; rows equal
in both go together. Null ids count as one id, null texts have size 0, the null source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import broadcast_if_small, materialize, table

DIGITS, LEVELS, MOST = 3, 5, 3


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _digest(id_col: str, text_col: str) -> Column:
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col(text_col), F.lit("")))
    return F.substring(F.md5(key.cast("binary")), 1, DIGITS * LEVELS)


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, digest (15 hex digits) for every row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _size(text_col).alias("size"), _digest(id_col, text_col).alias("digest"))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, weight, target out of source, source_size: weights 1, 2, 3, 1 ... by code point, null last.

    One row for each source goes through one window; targets that hit their ceiling are the sources with the least
    ratio of ceiling to weight, so running sums in that order tell where resharing ends.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = ranked.select(
        "*",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("capped"),
        F.sum("weight").over(after).alias("left"),
        F.sum("source_size").over(everything).alias("total"),
    )
    spare = (F.col("total") - most * F.col("capped")).cast("double")
    fits = most * F.col("source_size") * F.col("left") >= F.col("weight") * (F.col("total") - most * F.col("capped"))
    share = F.min(F.when(fits, F.struct(F.col("capped"), F.col("left"), spare.alias("spare")))).over(everything)
    rated = summed.withColumn("fits", fits).withColumn("share", share)
    uncapped = F.col("share.spare") * F.col("weight") / F.col("share.left")
    target = F.when(F.col("capped") >= F.col("share.capped"), F.when(F.col("fits"), uncapped)).otherwise(None)
    target = F.coalesce(target, (most * F.col("source_size")).cast("double"))
    return rated.select("source", "source_size", "weight", F.least(target, (most * F.col("source_size")).cast("double")).alias("target"))


def mix_rules(sized: DataFrame, most: int = MOST) -> DataFrame:
    """A row for each source: source, source_size, target, whole, budget and, where a threshold is needed, edge and with_edge.

    sized: what sizes_of returns, materialised.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(totals, most)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = materialize(plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    # open: sources whose threshold is still sought, the digits found so far and the budget left below them
    open_ = plan.where("budget > 0").select("source", F.lit("").alias("prefix"), F.col("budget").alias("rest"))
    done = []
    for level in range(LEVELS):
        width = DIGITS * (level + 1)
        bucket = F.substring("digest", 1, width)
        inside = sized.alias("s").join(open_.alias("o"), F.expr("s.source <=> o.source")).where(F.expr(f"substring(s.digest, 1, {width - DIGITS}) = o.prefix"))
        sums = inside.select(F.col("s.source").alias("source"), bucket.alias("bucket"), "size", "rest").groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first("rest").alias("rest"))
        running = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("sum", F.sum("size").over(running)).where("sum > rest")
        found = sums.groupBy("source").agg(F.min(F.struct("bucket", "sum", "size", "n", "rest")).alias("b")).select("source", "b.*")
        found = materialize(found.withColumn("rest", F.col("rest") - (F.col("sum") - F.col("size"))))
        single = (F.col("n") == 1) if level < LEVELS - 1 else F.lit(True)
        # a single row, or rows with one hash: taken if that ends nearer to the budget
        done.append(found.where(single).select("source", F.col("bucket").alias("edge"), (F.col("size") - F.col("rest") < F.col("rest")).alias("with_edge")))
        open_ = found.where(~single).select("source", F.col("bucket").alias("prefix"), "rest")
        if open_.isEmpty():
            break
    edges = done[0]
    for more in done[1:]:
        edges = edges.unionByName(more)
    return materialize(plan.alias("p").join(edges.alias("e"), F.expr("p.source <=> e.source"), "left").select("p.*", "edge", "with_edge"))


def _copies(digest: Column) -> Column:
    """How often a row is taken, by its digest and the columns of mix_rules (as r)."""
    lead = F.substring(digest, F.lit(1), F.length("r.edge"))
    extra = F.when(F.col("r.budget") <= 0, 0).when(F.col("r.edge").isNull(), 1).when(lead < F.col("r.edge"), 1).when((lead == F.col("r.edge")) & F.col("r.with_edge"), 1).otherwise(0)
    return (F.col("r.whole") + extra).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs."""
    sized = materialize(sizes_of(docs, id_col, text_col, source_col))
    joined = sized.alias("s").join(broadcast_if_small(mix_rules(sized, most)).alias("r"), F.expr("s.source <=> r.source"))
    copies = _copies(F.col("s.digest"))
    return joined.select("s.doc_id", "s.source", "s.size", "r.source_size", "r.target", copies.alias("copies"), (copies * F.col("s.size")).alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, each row once, with copies (how often it is taken) and taken (its words times copies).

    Texts stay where they are: only the rules, a row for each source, are joined to them. Columns of these names that
    docs has are replaced.
    """
    rules = broadcast_if_small(mix_rules(materialize(sizes_of(docs))))
    joined = docs.alias("d").join(rules.alias("r"), F.expr("d.source <=> r.source"))
    copies = _copies(_digest("d.doc_id", "d.text"))
    kept = [F.col(f"d.`{c}`") for c in docs.columns if c not in ("copies", "taken")]
    return joined.select(*kept, copies.alias("copies"), (copies * _size("d.text")).alias("taken")).where("copies > 0")


QUERIES = {"op8_mixing": op8_mixing}

ORACLES = {
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    substr(md5(coalesce(doc_id::varchar, '') || chr(10) || coalesce(text, '')), 1, 15) AS digest FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY 1),
r AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight,
    sum(source_size) OVER () AS total FROM r),
f AS (SELECT min(capped) AS capped, max(rest_weight) AS rest_weight, max(total) AS total FROM o
    WHERE 3 * source_size * rest_weight >= weight * (total - 3 * capped)),
t AS (SELECT o.source, o.source_size, CASE WHEN o.capped >= f.capped AND 3 * o.source_size * f.rest_weight >= o.weight * (f.total - 3 * f.capped)
    THEN least((f.total - 3 * f.capped)::double * o.weight / f.rest_weight, (3 * o.source_size)::double)
    ELSE (3 * o.source_size)::double END AS target FROM o, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::bigint ELSE 0 END AS whole FROM t),
q AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, d.digest) AS own FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::bigint AS size, source_size, target,
    (size * (whole + CASE WHEN budget <= 0 THEN 0 WHEN upto <= budget THEN 1
        WHEN upto - own <= budget AND own - (budget - (upto - own)) < budget - (upto - own) THEN 1 ELSE 0 END))::bigint AS taken FROM q
"""
}
