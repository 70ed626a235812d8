"""The tables of an input folder seen as catalogue cases, health checks, jobs and skills.

Every adapter is SQL text in the dialect that Spark and DuckDB share, with {table} placeholders, so a query and its
oracle cannot drift apart in how they see the input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quillspark.sources.tables import table

CASES = """cases AS (SELECT 'TC-' || cast(o_orderkey AS varchar(20)) AS issue_key, o_orderkey AS key_num, c_mktsegment AS module,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Highest' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium' ELSE 'Low' END AS priority,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 ELSE 1 END AS priority_rank,
    CASE WHEN o_orderkey % 12 = 0 THEN 'Deprecated' WHEN o_orderstatus = 'F' THEN 'Ready' WHEN o_orderstatus = 'O' THEN 'Automated' ELSE 'Draft' END AS status,
    CASE WHEN o_orderkey % 12 = 0 THEN 0 WHEN o_orderstatus = 'F' THEN 3 WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS status_rank,
    CASE o_custkey % 9 WHEN 0 THEN 'Functional' WHEN 1 THEN 'UI/UX' WHEN 2 THEN 'Accessibility' WHEN 3 THEN 'Boundary' WHEN 4 THEN 'API'
        WHEN 5 THEN 'Security' WHEN 6 THEN 'Performance' WHEN 7 THEN 'Negative' ELSE 'Regression' END AS test_type,
    CASE o_orderkey % 4 WHEN 0 THEN 'Chrome 148' WHEN 1 THEN 'Safari 19' WHEN 2 THEN 'Edge 148' ELSE 'Firefox 141' END AS browser,
    CASE cast(floor(o_orderkey / 4.0) AS bigint) % 4 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile (iOS)' WHEN 2 THEN 'mobile (Android)' ELSE 'tablet' END AS device,
    '[' || c_mktsegment || '] verify flow ' || cast(o_custkey % 50 AS varchar(20)) AS summary,
    lower(trim('[' || c_mktsegment || '] verify flow ' || cast(o_custkey % 50 AS varchar(20)))) AS design_key
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey)"""

CHECKS = """checks AS (SELECT *, CASE WHEN functional = 'FAIL' THEN 'FUNCTIONAL_FAILURE' WHEN raw_status = 'DOWN' THEN 'DOWN' WHEN raw_status = 'DEGRADED' THEN 'SLOW' WHEN raw_status = 'UP' THEN 'HEALTHY' ELSE 'UNKNOWN' END AS health FROM
    (SELECT *, CASE WHEN http_status = 500 THEN 'DOWN' WHEN response_ms > 3000 THEN 'DEGRADED' ELSE 'UP' END AS raw_status, CASE WHEN k >= 97 THEN 'FAIL' ELSE 'PASS' END AS functional, k % 3 AS retry_count FROM
    (SELECT event_id, ts, 'svc-' || cast(user_id % 5 AS varchar(20)) AS service, CASE user_id % 3 WHEN 0 THEN 'QA' WHEN 1 THEN 'Staging' ELSE 'Production' END AS environment,
        CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http_status, cast(floor(value * 25 + 0.5) AS bigint) AS response_ms,
        cast(regexp_extract(props, '[0-9]+', 0) AS bigint) AS k, user_id % 5 < 2 AS critical FROM {events}) e1) e2)"""

#: Stretches of DOWN checks of a service in an environment, from the first failure to the next check that is not DOWN.
INCIDENTS = (
    CHECKS
    + """, flagged AS (SELECT *, CASE WHEN health = 'DOWN' THEN 1 ELSE 0 END AS down, row_number() OVER (PARTITION BY environment, service ORDER BY ts, event_id) AS rn,
    lead(ts) OVER (PARTITION BY environment, service ORDER BY ts, event_id) AS next_ts FROM checks),
islands AS (SELECT *, rn - row_number() OVER (PARTITION BY environment, service, down ORDER BY ts, event_id) AS island FROM flagged),
incidents AS (SELECT 'INC-' || cast(min(event_id) AS varchar(20)) AS incident_id, environment, service, min(ts) AS started, CASE WHEN count(next_ts) = count(*) THEN max(next_ts) END AS recovered, count(*) AS failures, max(retry_count) AS retries,
    CASE WHEN count(next_ts) < count(*) THEN 'OPEN' ELSE 'RESOLVED' END AS status FROM islands WHERE down = 1 GROUP BY environment, service, island)"""
)

JOBS = """jobs AS (SELECT o_orderkey AS id, c_name AS company, o_orderpriority AS role, cast(o_orderdate AS date) AS date_applied, o_totalprice AS salary,
    CASE o_orderkey % 6 WHEN 0 THEN 'wishlist' WHEN 1 THEN 'applied' WHEN 2 THEN 'followup' WHEN 3 THEN 'interview' WHEN 4 THEN 'offer' ELSE 'rejected' END AS status
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey)"""

_NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tables_in(sql: str) -> list[str]:
    """The input tables that SQL text refers to."""
    return [n for n in _NAMES if re.search(r"\{" + n + r"\}", sql)]


def on_spark(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL text over the parquet tables it names; Catalyst prunes columns and pushes filters into the scans."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in tables_in(sql)})


def on_duckdb(sql: str) -> str:
    """The same text with plain table names."""
    for name in _NAMES:
        sql = sql.replace("{" + name + "}", name)
    return sql
