"""Catalogue queries: filters, ordinal ranking, de-duplication, cross-tabs, gaps, paging and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators.ranking import sorted_ranks
from quillspark.plans.shared import both
from quillspark.sources.adapters import CASES, on_duckdb, on_spark

W = f"WITH {CASES}"
COMPACT = "issue_key, module, test_type, priority, status, browser, device, summary"
SCORE = "100 * priority_rank + 10 * status_rank"
_PRIORITIES = ("Highest", "High", "Medium", "Low")
_TYPES = ("Functional", "UI/UX", "Accessibility", "Boundary", "API", "Security", "Performance", "Negative", "Regression")


def _pivot(column: str, values: tuple[str, ...], prefix: str) -> str:
    return ", ".join(f"count(CASE WHEN {column} = '{v}' THEN 1 END) AS {prefix}_{v.lower().replace('/', '_')}" for v in values)


SQLS = {
    # B-01..B-05: conjunctive filters, ordinal floor, keyword over joined fields, projections
    "s2_filter_multi": f"{W} SELECT {COMPACT} FROM cases WHERE module = 'BUILDING' AND priority IN ('Highest', 'High') AND browser IN ('Chrome 148', 'Edge 148') AND status NOT IN ('Deprecated')",
    "s2_min_priority": f"{W} SELECT issue_key, priority, {SCORE} AS score FROM cases WHERE priority_rank >= 3",
    "s2_keyword": f"{W} SELECT issue_key, summary FROM cases WHERE lower(summary || ' ' || module || ' ' || test_type || ' ' || priority) LIKE '%flow 7 building%'",
    # F-07, F-08, B-09: keyed sort (descending turns the tie-break too) and paging with totals
    "s2_sorted_page": f"{W}, hits AS (SELECT {COMPACT}, priority_rank, key_num FROM cases WHERE module = 'MACHINERY'), t AS (SELECT count(*) AS total FROM hits), page AS (SELECT * FROM hits ORDER BY priority_rank DESC, key_num DESC LIMIT 75), s AS (SELECT *, row_number() OVER (ORDER BY priority_rank DESC, key_num DESC) AS rn FROM page) SELECT {COMPACT}, rn, total, total > 75 AS has_more FROM s CROSS JOIN t WHERE rn > 50",
    # B-07, B-08, G-05: point and batch lookups, request order and repeats kept, what is missing
    "s2_by_ids": f"{W}, asked AS (SELECT * FROM (VALUES (1, ' tc-7 '), (2, 'TC-3'), (3, 'tc-7'), (4, 'TC-0')) AS v(pos, k)) SELECT pos, issue_key, summary FROM asked LEFT JOIN cases ON issue_key = upper(trim(k))",
    "s2_missing_ids": f"{W}, asked AS (SELECT * FROM (VALUES (1, 'TC-7'), (2, 'TC-0'), (3, 'TC-none')) AS v(pos, k)) SELECT pos, k FROM asked WHERE NOT EXISTS (SELECT 1 FROM cases WHERE issue_key = k)",
    # D-01, D-02, D-05, D-06
    "s2_value_counts": f"{W} SELECT priority, priority_rank, count(*) AS n FROM cases GROUP BY priority, priority_rank",
    "s2_count_grouped": f"{W} SELECT test_type, count(*) AS n FROM cases WHERE priority_rank >= 2 AND status <> 'Deprecated' GROUP BY test_type",
    "s2_group_counts": f"{W} SELECT module || ' | ' || status || ' | ' || browser AS grp, count(*) AS n FROM cases GROUP BY module, status, browser",
    "s2_facets": f"{W} SELECT 'module' AS field, module AS val FROM cases GROUP BY module UNION ALL SELECT 'browser', browser FROM cases GROUP BY browser UNION ALL SELECT 'device', device FROM cases GROUP BY device UNION ALL SELECT 'status', status FROM cases GROUP BY status",
    # D-03, D-04: cross-tabs, zero-filled, with totals
    "s2_priority_pivot": f"{W} SELECT module, {_pivot('priority', _PRIORITIES, 'p')}, count(*) AS total FROM cases GROUP BY module",
    "s2_coverage_matrix": f"{W} SELECT coalesce(module, '__total__') AS module, {_pivot('test_type', _TYPES, 't')}, count(*) AS total FROM cases GROUP BY ROLLUP (module)",
    # E-16, G-07: every module and type, though no case has the pair
    "s2_coverage_gaps": f"{W}, m AS (SELECT DISTINCT module FROM cases), t AS (SELECT DISTINCT test_type FROM cases), n AS (SELECT module, test_type, count(*) AS n FROM cases WHERE status = 'Ready' GROUP BY module, test_type) SELECT m.module, t.test_type, coalesce(n.n, 0) AS cases, 160 - coalesce(n.n, 0) AS shortfall, CASE WHEN n.n IS NULL THEN 'missing' ELSE 'thin' END AS kind FROM m CROSS JOIN t LEFT JOIN n ON n.module = m.module AND n.test_type = t.test_type WHERE coalesce(n.n, 0) < 160",
    # E-11..E-15, F-03, F-04
    "s2_rank_unique": f"{W}, r AS (SELECT issue_key, design_key, {SCORE} AS score, row_number() OVER (PARTITION BY design_key ORDER BY {SCORE} DESC, key_num) AS rn FROM cases WHERE status <> 'Deprecated') SELECT issue_key, design_key, score FROM r WHERE rn = 1",
    "s2_top_per_module": f"{W}, p AS (SELECT module, count(*) AS pool_size, count(CASE WHEN status <> 'Deprecated' THEN 1 END) AS ranked_pool_size FROM cases GROUP BY module), r AS (SELECT module, issue_key, {SCORE} AS score, row_number() OVER (PARTITION BY module ORDER BY {SCORE} DESC, key_num) AS rnk FROM cases WHERE status <> 'Deprecated') SELECT r.module, rnk, issue_key, score, pool_size, ranked_pool_size FROM r JOIN p ON r.module = p.module WHERE rnk <= 5",
    "s2_smoke_suite": f"{W}, r AS (SELECT module, issue_key, {SCORE} AS score, row_number() OVER (PARTITION BY module ORDER BY {SCORE} DESC, key_num) AS rnk FROM cases WHERE priority_rank >= 4 AND status IN ('Ready', 'Automated')) SELECT module, rnk, issue_key, score FROM r WHERE rnk <= 3",
    # D-23..D-26, G-06
    "s2_unique_designs": f"{W} SELECT design_key, min(key_num) AS first_key, count(*) AS row_count, count(DISTINCT browser) AS browsers, count(DISTINCT device) AS devices, max(priority_rank) AS top_priority FROM cases GROUP BY design_key",
    "s2_duplicate_designs": f"{W} SELECT design_key, count(*) AS n, min(issue_key) AS least_key, max(issue_key) AS last_key FROM cases GROUP BY design_key HAVING count(*) >= 60",
    # D-25: every case with its design and how many siblings it has; the siblings of cases asked for
    "s2_variants": f"{W}, d AS (SELECT design_key, count(*) AS n, min(key_num) AS first_key FROM cases GROUP BY design_key) SELECT issue_key, c.design_key, n - 1 AS siblings, first_key FROM cases c JOIN d ON d.design_key = c.design_key",
    "s2_variants_of": f"{W}, asked AS (SELECT issue_key, design_key FROM cases WHERE issue_key IN ('TC-7', 'TC-64')) SELECT a.issue_key, b.issue_key AS sibling, b.browser, b.device FROM asked a JOIN cases b ON a.design_key = b.design_key AND a.issue_key <> b.issue_key",
    "s2_browser_devices": f"{W} SELECT design_key, browser, count(DISTINCT device) AS devices, min(device) AS first_device FROM cases GROUP BY design_key, browser",
    "s2_validate": f"{W} SELECT count(*) AS n_rows, count(*) - count(DISTINCT issue_key) AS duplicate_keys, count(CASE WHEN trim(summary) = '' THEN 1 END) AS blank_summaries, count(CASE WHEN priority NOT IN ('Highest', 'High', 'Medium', 'Low') THEN 1 END) AS unknown_priorities, count(DISTINCT test_type) AS types FROM cases",
    # H-20: what stands after the first colon; H-21: file names
    "s2_object_under_test": f"{W} SELECT issue_key, CASE WHEN position(':' IN s) > 0 THEN trim(substr(s, position(':' IN s) + 1)) ELSE s END AS object_under_test, regexp_replace(s, '[^A-Za-z0-9._-]', '_'{{g}}) AS file_name FROM (SELECT issue_key, test_type || ': ' || summary AS s FROM cases) x",
}
QUERIES, ORACLES = both({k: v.replace("{g}", "") for k, v in SQLS.items()})
ORACLES["s2_object_under_test"] = ORACLES["s2_object_under_test"].replace("'_')", "'_', 'g')")

# E-11, E-12: every case that is not excluded, by score, with its rank and why
_RANKED = f"{W} SELECT issue_key, key_num, {SCORE} AS score, priority || ' (' || cast(priority_rank AS varchar(20)) || ' x 100) + ' || status || ' (' || cast(status_rank AS varchar(20)) || ' x 10)' AS explanation FROM cases WHERE status <> 'Deprecated'"


def _rank(spark, sf_dir):
    return sorted_ranks(on_spark(spark, sf_dir, _RANKED), [F.desc("score"), F.asc("key_num")]).drop("key_num")


QUERIES["s2_rank"] = _rank
ORACLES["s2_rank"] = f"SELECT issue_key, score, explanation, row_number() OVER (ORDER BY score DESC, key_num) AS rnk FROM ({on_duckdb(_RANKED)})"
