"""Words counted per row of an array and over all rows, with few of them shuffled.

A row has all of its words, so they are counted inside it: sorted, a word's count is the length of its run. How many
rows have a word is broadcast for the most frequent words, which most counts are of; only those of the rest are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.scratch import written

#: Words that all tasks get at most.
FREQUENT = 1 << 18


def _runs(rows: DataFrame, key: str, words: str) -> DataFrame:
    """key, tok, tf: each row's words and how often it has them."""
    ordered = rows.where(F.size(words) > 0).select(key, F.array_sort(words).alias("s"))
    begun = ordered.withColumn("b", F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1))))
    ended = begun.withColumn("e", F.concat(F.slice("b", 2, F.size("s")), F.array(F.size("s"))))
    runs = F.zip_with("b", "e", lambda b, e: F.struct(F.get("s", b).alias("tok"), (e - b).cast("long").alias("tf")))
    return ended.select(key, F.inline(runs))


def counted_rows(rows: DataFrame, key: str, words: str) -> DataFrame:
    """key, tok, tf: how often each key has each word of its arrays; words of keys with several rows are added up."""
    again = written(rows.groupBy(key).count().where("count > 1").select(F.col(key).alias("again")))
    if again.isEmpty():
        return _runs(rows, key, words)
    same = F.col(key).eqNullSafe(F.col("again"))
    shared = _runs(rows.join(again, same, "left_semi"), key, words).groupBy(key, "tok").agg(F.sum("tf").alias("tf"))
    return _runs(rows.join(again, same, "left_anti"), key, words).unionByName(shared)


def with_totals(counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """counts, which has a row for each key and tok and is read twice, with df: how many keys have the word."""
    known = written(counts.groupBy("tok").agg(F.count("*").alias("df")))
    sizes = known.groupBy((F.length(F.bin("df")) - 1).alias("power")).count().orderBy(F.desc("power")).collect()  # 63 rows at most
    least, so_far = None, 0
    for power, n in sizes:
        so_far += n
        if so_far > frequent:
            break
        least = 1 << power
    if least is None:
        return counts.join(known, "tok")
    often = F.broadcast(known.where(F.col("df") >= least))
    found = counts.join(often, "tok")
    if so_far <= frequent:
        return found
    return found.unionByName(counts.join(often, "tok", "left_anti").join(known.where(F.col("df") < least), "tok"))
