"""Closest names by edit distance, found by what is left of a string without some characters: no pair is compared without a clue.

Strings within d edits have a string in common that each becomes by dropping d characters at most (a character that is
replaced is dropped in both). Names are joined on the hashes of these strings, and the edit distance of what meets is
computed. How many names meet depends on how close they lie, not on how many there are: numbers of up to seven digits
have many neighbours, but no more with every row.

A long string has too many of these, so long ones are found by an index of character pairs. One edit changes at most
two of a padded string's pairs of neighbouring characters, so strings within d edits have all but 2d of them in common
(a pair's k-th occurrence counts as an item of its own). With items in one order over the whole corpus, rarest first,
two such strings share an item among their first 2d + 1. Only these are joined; rarest first keeps pairs that everybody
has out of the join. Strings of so few pairs that they might share none have one more item in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.scratch import written

#: Characters of the longest name that is asked for by dropping characters.
EDITS, NEAREST, LONGEST = 2, 5, 24


def _shorter(texts: Column) -> Column:
    """Every text without one of its characters (an empty one stays)."""
    places = lambda t: F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: F.transform(places(t), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1))))))


def _remains(names: DataFrame, edits: int) -> DataFrame:
    """name, h: hashes of a name and of what is left of it without so many characters at most."""
    made = names.withColumn("d0", F.array("name"))
    for n in range(edits):
        made = made.withColumn(f"d{n + 1}", _shorter(F.col(f"d{n}")))
    return made.select("name", F.explode(F.transform(F.concat(*[f"d{n}" for n in range(edits + 1)]), lambda x: F.xxhash64(x))).alias("h"))


def _met_by_remains(known: DataFrame, wanted: DataFrame, edits: int) -> DataFrame:
    return _remains(known, edits).join(_remains(wanted, edits).withColumnRenamed("name", "asked").hint("shuffle_hash"), "h").select("asked", "name")


def _items(name: Column) -> Column:
    """The pairs of neighbouring characters of a padded string, numbered where they repeat."""
    padded = F.concat(F.lit("\x02"), name, F.lit("\x03"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.substring(padded, i, 2))
    return F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, 1, i), lambda x: x == p)).cast("string")))


def _first_items(names: DataFrame, order: DataFrame, edits: int) -> DataFrame:
    """name, item: the first items of each name, rarest first."""
    items = names.select("name", F.explode(_items(F.col("name"))).alias("item")).join(order, "item", "left")
    ranked = items.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy(F.col("n").asc_nulls_first(), "item")))
    short = names.where(F.length("name") < 2 * edits).select("name", F.lit("").alias("item"))
    return ranked.where(F.col("k") <= 2 * edits + 1).select("name", "item").unionByName(short)


def _met_by_pairs(known: DataFrame, wanted: DataFrame, edits: int) -> DataFrame:
    order = written(known.select(F.explode(_items(F.col("name"))).alias("item")).groupBy("item").agg(F.count("*").alias("n")))
    left = _first_items(known, order, edits)
    right = _first_items(wanted, order, edits).withColumnRenamed("name", "asked")
    return left.join(right, "item").select("asked", "name")


def closest(names: DataFrame, asked: DataFrame, edits: int = EDITS, k: int = NEAREST, longest: int = LONGEST) -> DataFrame:
    """asked, name, distance, rnk: the k nearest of names(name) within so many edits of each of asked(asked), ties by name."""
    known = written(names.select("name").where("name is not null").distinct())
    wanted = written(asked.select(F.col("asked").alias("name")).where("name is not null").distinct())
    length = F.length("name")
    met, long = _met_by_remains(known.where(length <= longest + edits), wanted.where(length <= longest), edits), wanted.where(length > longest)
    if not long.isEmpty():
        met = met.unionByName(_met_by_pairs(known.where(length > longest - edits), long, edits))
    met = met.where(F.abs(F.length("name") - F.length("asked")) <= edits)
    near = met.withColumn("distance", F.levenshtein("asked", "name", edits)).where("distance >= 0").distinct()
    best = Window.partitionBy("asked").orderBy("distance", "name")
    return near.withColumn("rnk", F.row_number().over(best)).where(F.col("rnk") <= k)
