"""Text and scalar queries: page statistics, previews, paragraphs, highlights, collections, anagrams, merges by position."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators.ranking import sorted_ranks
from quillspark.plans.shared import concat_list, distinct, filtered, length_of
from quillspark.sources.adapters import on_duckdb, on_spark
from quillspark.sources.tables import table


def _texts(s: bool) -> dict[str, str]:
    g = "" if s else ", 'g'"
    words = "regexp_extract_all(text, '[^ \\t\\r\\n]+'" + (", 0)" if s else ")")
    paragraphs = filtered("split(text, '\\n{{2,}}')" if s else "string_split_regex(text, '\\n{2,}')", "trim(x) <> ''", s)
    chars = "split({0}, '')" if s else "string_split({0}, '')"
    chars_of = lambda c: filtered(chars.format(c), "x <> ''", s)
    ordered = (lambda a: f"array_sort({a})") if s else (lambda a: f"list_sort({a})")
    longest = f"coalesce(array_max(transform({paragraphs}, x -> length(x))), 0)" if s else f"coalesce(list_max(list_transform({paragraphs}, lambda x: length(x))), 0)"
    mark = "$1" if s else "\\1"
    return {
        "s1_page_stats": f"SELECT doc_id, length(text) AS chars, {length_of(words, s)} AS words, trim(text) <> '' AS has_text FROM {{documents}}",  # C-08
        "s1_preview": f"SELECT doc_id, CASE WHEN length(t) > 120 THEN rtrim(substr(t, 1, 120)) || '…' ELSE t END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' '{g})) AS t FROM {{documents}}) x",  # C-07
        "s1_paragraphs": f"SELECT doc_id, {length_of(paragraphs, s)} AS paragraphs, {longest} AS longest FROM {{documents}}",  # C-09
        "s1_highlight": f"SELECT doc_id, md5(marked) AS marked_md5, cast((length(marked) - length(text)) / 13 AS int) AS marks FROM (SELECT doc_id, text, regexp_replace(text, '(?i)(license|worthless)', '<mark>{mark}</mark>'{g}) AS marked FROM {{documents}}) x",  # C-34
        "s1_collections": "SELECT source, substr(sha1(source || '|800|150|' || lang), 1, 8) AS fingerprint, count(*) AS n FROM {documents} GROUP BY source, lang",  # C-19
        "s1_grounded": "SELECT doc_id, position('worthless' IN lower(text)) = 0 AS grounded FROM {documents}",  # E-25
        "s6_template": "SELECT c_custkey, replace(replace(replace('Story {{key}}: {{summary}} ({{segment}})', '{{key}}', cast(c_custkey AS varchar(20))), '{{summary}}', c_name), '{{segment}}', c_mktsegment) AS prompt FROM {customer}".replace("{{", "<").replace("}}", ">"),  # C-30
        "s7_response": "SELECT event_id, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), 'none') AS answer FROM (SELECT event_id, " + ("get_json_object(props, '$.text') AS a, get_json_object(props, '$.k') AS b" if s else "json_extract_string(props, '$.text') AS a, json_extract_string(props, '$.k') AS b") + " FROM {events}) x",  # H-24
        # H-32, H-34 over pairs of names
        "s8_anagram": f"SELECT p_partkey, {ordered(chars_of('p_brand'))} = {ordered(chars_of('reverse(p_brand)'))} AS of_reverse, {ordered(chars_of('p_brand'))} = {ordered(chars_of('p_type'))} AS of_type FROM {{part}}",
        "s8_distinct_chars": f"SELECT p_partkey, length({concat_list(distinct(chars_of('p_name'), s), '', s)}) AS n FROM {{part}}",
        "s8_sums": "SELECT l_orderkey, l_linenumber, l_quantity + l_linenumber AS added, l_quantity - l_linenumber AS less, l_quantity * l_linenumber AS times, (l_quantity + l_linenumber) / 2 AS mean FROM {lineitem}",  # H-37
        "s8_squares": "SELECT n, repeat('*', n) AS row_text, lpad(repeat('*', n), 20, ' ') AS right_aligned, repeat('*', 21 - n) AS falling FROM (SELECT l_linenumber + 7 * cast(floor(l_quantity / 25.0) AS int) AS n FROM {lineitem} GROUP BY l_linenumber + 7 * cast(floor(l_quantity / 25.0) AS int)) x",  # H-40
        # G-13 on arrays of words
        "s1_set_ops": f"SELECT a.item_id, {length_of(('array_intersect' if s else 'list_intersect') + '(a.t, b.t)', s)} AS shared, {length_of(filtered('a.t', 'NOT array_contains(b.t, x)' if s else 'NOT list_contains(b.t, x)', s), s)} AS only_here FROM (SELECT item_id, {distinct(words, s)} AS t FROM {{benchmark}}) a JOIN (SELECT item_id, {distinct(words, s)} AS t FROM {{benchmark}}) b ON b.item_id = a.item_id + 1",
        # E-02: the share of query words that a hit has, and the words, the weightiest first, are in s1_bm25_terms; D-33, C-24
        "s1_heatmap": "SELECT vec_id, floor(most * 1e6 + 0.5) / 1e6 AS scale, cast(floor(first / most * 1e3 + 0.5) AS int) AS first_shade FROM (SELECT vec_id, cast(embedding[" + ("0" if s else "1") + "] AS double) AS first, " + ("array_max(transform(embedding, x -> abs(cast(x AS double))))" if s else "list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x)))") + " AS most FROM {embeddings}) x",
    }


_SPARK, _DUCK = _texts(True), _texts(False)
QUERIES = {name: (lambda spark, sf_dir, sql=sql: on_spark(spark, sf_dir, sql)) for name, sql in _SPARK.items()}
ORACLES = {name: on_duckdb(sql) for name, sql in _DUCK.items()}


def _by_position(spark, sf_dir):
    """G-09: rows of two tables side by side, by their places in the order of their ids."""
    left = sorted_ranks(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), [F.asc("p_partkey")], name="pos")
    right = sorted_ranks(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), [F.asc("c_custkey")], name="pos")
    return left.join(right, "pos").select("pos", "p_partkey", "p_brand", "c_custkey", "c_name")


def _zipped(spark, sf_dir):
    """G-18: parallel arrays turned into rows."""
    arrays = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    zipped = arrays.select("conv_id", F.inline(F.arrays_zip(F.col("t.turn").alias("turn"), F.col("t.role").alias("role"))))
    return zipped.select("conv_id", "turn", "role")


QUERIES |= {"s7_by_position": _by_position, "s1_zipped": _zipped}
ORACLES |= {
    "s7_by_position": "SELECT l.pos, p_partkey, p_brand, c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS pos FROM part) l JOIN (SELECT *, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer) r ON l.pos = r.pos",
    "s1_zipped": "SELECT conv_id, turn, role FROM conversations",
}
