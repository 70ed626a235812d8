"""Quality rules in a short-circuit cascade.

Rules are Column expressions over a text and its counts. Their cost and selectivity are estimated on a sample, and
they run in the order of rejections per cost; a document that one rule rejects is not shown to the next. The order
changes what is computed, never the verdict. Null texts have no words, so they fail the base rules; ties in the
order go by name; repeated rows are judged alike. Columns of the input whose names clash with the counts are not
touched: results come under the names below next to the id.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import let, table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Bits of a packed trigram that hold its position; the rest are of its hash, and equal hashes are checked word by word.
#: Longer texts have hash and position side by side.
PLACE_BITS = 24
#: Rows of the sample on which costs are estimated.
SAMPLE_ROWS = 2000

#: Rule name to the condition under which a document is rejected; text-level rules work on `text`, others on counts.
RULES = {
    "symbols": "n_symbols > 0.5 * n_words",
    "word_length": "word_chars < 1.5 * n_words or word_chars > 20 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * size(split(text, '\\n', -1))",
    "letters": "2 * length(regexp_replace(text, r'[^\\p{L}]+', '')) < length(text)",
    "bullets": "10 * regexp_count(text, r'(?m)^[ \\t]*[-*\\u2022] ') > 9 * size(split(text, '\\n', -1))",
    "ellipses": "10 * regexp_count(text, r'(?m)(\\.\\.\\.|\\u2026)[ \\t]*$') > 3 * size(split(text, '\\n', -1))",
}


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that the array holds twice or more.

    Windows are packed as hash and position and sorted as plain longs; neighbours with one hash whose words agree are
    repeats. Sorting keeps the work near linear however often a window repeats. Texts of more words than a packed
    position can tell apart are looked at as pairs of hash and position, which is slower and gives the same.
    """
    low = (1 << PLACE_BITS) - 1

    def windows(w: Column) -> Column:
        def packed(i: Column) -> Column:
            return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))

        return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), packed)).otherwise(F.array().cast("array<bigint>"))

    def alike(w: Column, x: Column, y: Column) -> Column:
        i, j = x.bitwiseAND(F.lit(low)).cast("int"), y.bitwiseAND(F.lit(low)).cast("int")
        same = F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)
        return same & (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    def places(w: Column, s: Column) -> Column:
        def repeats(x: Column, i: Column) -> Column:
            other = F.bitwise_not(x)
            before, after = F.coalesce(F.get(s, i - 1), other), F.coalesce(F.get(s, i + 1), other)
            return alike(w, x, before) | alike(w, x, after)

        return F.sort_array(F.transform(F.filter(s, repeats), lambda x: x.bitwiseAND(F.lit(low))))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
        total = F.aggregate(p, start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n"), x.alias("last")))
        return total["n"]

    def pairs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def same(w: Column, x: Column, y: Column) -> Column:
        i, j = x["i"], y["i"]
        return y.isNotNull() & (x["h"] == y["h"]) & (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    def spots(w: Column, s: Column) -> Column:
        repeats = lambda x, i: F.coalesce(same(w, x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(w, x, F.get(s, i + 1)), F.lit(False))
        return F.sort_array(F.transform(F.filter(s, repeats), lambda x: x["i"].cast("long")))

    def counted(w: Column) -> Column:
        short = let(F.sort_array(windows(w)), lambda s: covered(places(w, s)))
        return F.when(F.size(w) <= 1 << PLACE_BITS, short).otherwise(let(F.sort_array(pairs(w)), lambda s: covered(spots(w, s))))

    return let(words, counted)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    numbers = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOL)),
        "n_dup_lines": let(F.col("lines"), lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_words(F.col("words")),
    }
    return split.select("doc_id", "text", *[c.cast("long").alias(name) for name, c in numbers.items()])


def order_rules(counted: DataFrame, rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejections per second on a sample of at most sample_rows rows, the most effective first.

    Each rule runs over the sample on its own, after a first run that warms it up.
    """
    sample = counted.limit(sample_rows).cache()
    try:
        rows, rates = sample.count(), {}
        for name, condition in sorted(rules.items()):
            rejected = sample.agg(F.count_if(F.expr(condition)))
            rejected.first()
            began = time.perf_counter()
            n = rejected.first()[0]
            rates[name] = ((n + 1) / (rows + 1)) / (time.perf_counter() - began)
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda name: (-rates[name], name))


def cascade(rules: dict[str, str], order: list[str]) -> Column:
    """True if no rule rejects; a CASE goes on to the next rule only if the one before lets the row pass."""
    verdict = None
    for name in order:
        passed = F.expr(rules[name])
        verdict = F.when(passed, F.lit(False)) if verdict is None else verdict.when(passed, F.lit(False))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, str] = RULES) -> DataFrame:
    """The counts of every row with base_failed and kept."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = order_rules(counts(plain.limit(SAMPLE_ROWS)), rules)
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    judged = counts(plain).withColumn("base_failed", failed)
    return judged.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(rules, order))).drop("text")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed and kept of all documents."""
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op6_quality_rules": op6_quality_rules}

ORACLES = {
    "op6_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS r FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d),
k AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM g),
n AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM k),
c AS (SELECT r, sum(least(3, i - before)) AS n_repeat_words FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -9) AS before FROM n WHERE n > 1) GROUP BY 1),
b AS (SELECT doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines FROM d LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::bigint AS n_repeat_words, base_failed,
    NOT (base_failed OR n_symbols > 0.5 * n_words OR word_chars < 1.5 * n_words OR word_chars > 20 * n_words OR 10 * n_dup_lines > 3 * n_lines
    OR 2 * length(regexp_replace(text, '[^\p{L}]+', '', 'g')) < length(text)
    OR 10 * len(regexp_extract_all(text, '(?m)^[ \t]*[-*\x{2022}] ')) > 9 * n_lines
    OR 10 * len(regexp_extract_all(text, '(?m)(\.\.\.|\x{2026})[ \t]*$')) > 3 * n_lines) AS kept FROM f
"""
}
