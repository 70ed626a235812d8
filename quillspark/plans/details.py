"""Rules that complete others: score breakdowns, lists for hits without a score, all-words search, times, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators.ranking import fused_top, in_blocks
from quillspark.plans import monitoring, retrieval, skills
from quillspark.plans.monitoring import incident_rows
from quillspark.sources.adapters import CHECKS, INCIDENTS, on_duckdb, on_spark
from quillspark.sources.scratch import written
from quillspark.sources.tables import table
from quillspark.streaming.lifecycle import duration_s


def _breakdown(s: bool) -> str:
    """E-02: for the three best hits of each query the share of its words that they have, and the words, the weightiest first."""
    rounded = lambda x, n: f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"
    if s:
        terms = "array_join(transform(array_sort(collect_list(struct(-c AS c, tok))), x -> x.tok), ',')"
        shown = "array_join(transform(array_sort(collect_list(struct(-c AS c, tok, tf))), x -> cast(x.tf AS string)), ',')"
    else:
        terms, shown = "string_agg(tok, ',' ORDER BY c DESC, tok)", "string_agg(tf::VARCHAR, ',' ORDER BY c DESC, tok)"
    return f"""WITH {retrieval._index(s)}, {retrieval._hits(s)}, asked AS (SELECT item_id, count(*) AS n FROM qt GROUP BY item_id),
    c AS (SELECT {'/*+ BROADCAST(kw) */ ' if s else ''}hits.item_id, hits.doc_id, hits.tok, hits.tf, {rounded('w', 4)} AS c FROM hits JOIN kw ON kw.item_id = hits.item_id AND kw.doc_id = hits.doc_id WHERE kw.rnk <= 3)
    SELECT c.item_id, c.doc_id, {rounded('cast(count(*) AS double) / max(n)', 3)} AS coverage, count(*) AS matched, {terms} AS matched_terms, {shown} AS tfs, {rounded('max(c)', 4)} AS most FROM c JOIN asked ON asked.item_id = c.item_id GROUP BY c.item_id, c.doc_id"""


def _hybrid_all(spark, sf_dir):
    """E-08 whole: a query without a positive score has all documents as its keyword list, in their order; E-10: hits that the vectors have and the documents do not are dropped."""
    keyword = retrieval._keyword_scores(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select("item_id").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("item_id")))  # -1 asks for nothing that there is
    unmet = written(items.join(keyword.select("item_id").distinct(), "item_id", "left_anti"))
    docs = table(spark, sf_dir, "documents").select("doc_id")
    every = in_blocks(unmet, F.lit(16), lambda block: docs.join(block, F.lit(True)).select("item_id", "doc_id", F.lit(0.0).alias("score")))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(docs, F.col("vec_id") == F.col("doc_id"), "left_semi")
    return fused_top(keyword.unionByName(every), retrieval.Vectors(spark, sf_dir, written(vectors), first=-1), 10)


def _search_all(s: bool) -> str:
    """E-18 with all words asked for: skills that have every one of them."""
    whole = skills._search(s)
    return whole.replace("FROM phrased WHERE hits > 0 OR", "FROM phrased WHERE hits = told OR").replace("count(CASE WHEN hit THEN 1 END) AS hits FROM part", "count(CASE WHEN hit THEN 1 END) AS hits, count(*) AS told FROM part")


def _vector_summary(s: bool) -> str:
    """C-24: population deviation, the first and the last eight components."""
    if s:
        v = "transform(embedding, x -> cast(x AS double))"
        return f"""SELECT vec_id, floor(sqrt(aggregate(transform(v, x -> (x - m) * (x - m)), 0.0D, (a, x) -> a + x) / size(v)) * 1e6 + 0.5) / 1e6 AS std,
        array_join(transform(slice(v, 1, 8), x -> cast(cast(floor(x * 1e4 + 0.5) AS bigint) AS string)), ',') AS head, array_join(transform(slice(v, greatest(1, size(v) - 7), 8), x -> cast(cast(floor(x * 1e4 + 0.5) AS bigint) AS string)), ',') AS tail
        FROM (SELECT vec_id, v, aggregate(v, 0.0D, (a, x) -> a + x) / size(v) AS m FROM (SELECT vec_id, {v} AS v FROM {{embeddings}} WHERE size(embedding) > 0) a) b"""
    each = "array_to_string(list_transform({0}, lambda x: floor(x * 1e4 + 0.5)::BIGINT), ',')"
    return f"""SELECT vec_id, floor(list_stddev_pop(v) * 1e6 + 0.5) / 1e6 AS std, {each.format('v[1:8]')} AS head, {each.format('v[-8:]')} AS tail FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM {{embeddings}} WHERE len(embedding) > 0)"""


#: Times as sheets write them: without a zone, with one, or not a time at all.
_TIMES = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN {f} WHEN 1 THEN {f} || 'Z' WHEN 2 THEN replace({f}, ' ', 'T') || '+02:00' WHEN 3 THEN 'at noon' ELSE '' END AS said FROM {{events}}"


def _times(s: bool) -> str:
    """H-05: a time without a zone is at +05:30 as sheets mean it, others mean what they say; anything else is no time."""
    two = "[0-9][0-9]"  # a count in braces would be taken for a table
    naive = f"'^{two}{two}-{two}-{two}[ T]{two}:{two}:{two}$'"
    if s:
        rows = _TIMES.format(f="date_format(ts, 'yyyy-MM-dd HH:mm:ss')")
        return f"SELECT event_id, unix_seconds(try_to_timestamp(CASE WHEN regexp_like(said, {naive}) THEN said || '+05:30' ELSE nullif(said, '') END)) AS at FROM ({rows}) x"
    rows = _TIMES.format(f="strftime(ts, '%Y-%m-%d %H:%M:%S')")
    return f"SELECT event_id, floor(epoch(try_cast(CASE WHEN regexp_matches(said, {naive}) THEN said || '+05:30' ELSE nullif(said, '') END AS TIMESTAMPTZ)))::BIGINT AS at FROM ({rows}) x"


def _texts(s: bool) -> dict[str, str]:
    md5 = "md5({0})"
    return {
        "s1_bm25_breakdown": _breakdown(s),
        "s3_search_all": _search_all(s),
        "s1_vector_summary": _vector_summary(s),
        "s4_times": _times(s),
        # C-22: what stands before a text on its way to an embedding
        "s1_prefixed": f"SELECT doc_id, {md5.format(chr(39) + 'search_document: ' + chr(39) + ' || text')} AS as_document, {md5.format(chr(39) + 'search_query: ' + chr(39) + ' || text')} AS as_query FROM {{documents}}",
        # F-08: the number at a key's end, after all others if there is none
        "s2_key_order": "SELECT k, coalesce(try_cast(nullif(regexp_extract(k, '([0-9]+)$', 1), '') AS int), 1000000000) AS pos FROM (SELECT CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_type || '-' || cast(p_partkey AS varchar(20)) END AS k FROM {part}) x",
        # G-02: labels where there are any, else the default; the label's own value wins over the document's
        "s1_labelled": "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic, CASE WHEN l.doc_id IS NULL THEN coalesce(d.source, 'none') ELSE 'labelled' END AS origin FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id",
        # D-12: the summary's newest check, with the id that it has
        "s4_last_checked": f"WITH {CHECKS}, r AS (SELECT environment, event_id, service, row_number() OVER (PARTITION BY environment ORDER BY ts DESC, event_id DESC) AS rn FROM checks) SELECT environment, event_id AS last_checked, service FROM r WHERE rn = 1",
    }


_SPARK, _DUCK = _texts(True), _texts(False)
QUERIES = {name: (lambda spark, sf_dir, sql=sql: retrieval._over_tokens(spark, sf_dir, sql)) for name, sql in _SPARK.items()}
ORACLES = {name: on_duckdb(sql) for name, sql in _DUCK.items()}


def _durations(spark, sf_dir):
    """D-17, H-12: incidents that are over, by severity, with their mean and longest duration."""
    over = incident_rows(spark, sf_dir).where("recovered is not null").withColumn("severity", monitoring.severity(F.col("failures")))
    timed = over.withColumn("s", duration_s(F.col("started").cast("timestamp"), F.col("recovered").cast("timestamp")))
    return timed.groupBy("severity").agg(F.count("*").alias("n"), (F.floor(F.avg("s") * 1e3 + 0.5) / 1e3).alias("mean_s"), F.max("s").alias("longest_s"))


QUERIES |= {"s1_hybrid_all": _hybrid_all, "s4_incident_durations": _durations}
ORACLES |= {
    "s4_incident_durations": on_duckdb(
        f"""WITH {INCIDENTS} SELECT CASE WHEN failures >= 4 THEN 'SEV-1' WHEN failures = 3 THEN 'SEV-2' WHEN failures = 2 THEN 'SEV-3' ELSE 'SEV-4' END AS severity, count(*) AS n, floor(avg(s) * 1e3 + 0.5) / 1e3 AS mean_s, max(s) AS longest_s
    FROM (SELECT *, greatest(0, floor((epoch_ms(recovered) - epoch_ms(started)) / 1000 + 0.5))::BIGINT AS s FROM incidents WHERE recovered IS NOT NULL) GROUP BY 1"""
    ),
    "s1_hybrid_all": (
        f"WITH {retrieval._index(False)}, {retrieval._hits(False)}, {retrieval._cosine()}".replace("{documents}", "documents").replace("{benchmark}", "benchmark")
        + f""", asked AS (SELECT item_id FROM benchmark UNION ALL SELECT -1),
    kall AS (SELECT item_id, doc_id, rnk FROM kw UNION ALL SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) FROM asked, documents WHERE item_id NOT IN (SELECT item_id FROM kw)),
    vall AS (SELECT CASE WHEN item_id = 0 THEN -1 ELSE item_id END AS item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, doc_id) AS rnk FROM sims WHERE doc_id IN (SELECT doc_id FROM documents)),
    fused AS (SELECT coalesce(k.item_id, v.item_id) AS item_id, coalesce(k.doc_id, v.doc_id) AS doc_id, k.rnk AS kw_rank, v.rnk AS vec_rank, {retrieval._q(f'coalesce(1.0 / ({retrieval.RRF_K} + k.rnk), 0) + coalesce(1.0 / ({retrieval.RRF_K} + v.rnk), 0)')} AS score
        FROM kall k FULL OUTER JOIN vall v ON k.item_id = v.item_id AND k.doc_id = v.doc_id)
    SELECT item_id, doc_id, kw_rank, vec_rank, score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, kw_rank ASC NULLS LAST, vec_rank ASC NULLS LAST, doc_id) AS rnk FROM fused) WHERE rnk <= 10"""
    ),
}
