"""Service-health queries: normalised checks, latest state, availability, latency, incidents, retries, settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators.ranking import sorted_ranks
from quillspark.plans.shared import both
from quillspark.sources.adapters import CHECKS, INCIDENTS, on_duckdb, on_spark
from quillspark.sources.scratch import written

W = f"WITH {CHECKS}"
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY environment, service ORDER BY ts DESC, event_id) AS rn FROM checks) x WHERE rn = 1)"


def _pct(good: str, n: str = "count(*)") -> str:
    return f"floor(cast({good} AS double) / {n} * 10000 + 0.5) / 100"


HEALTHY = "count(CASE WHEN health = 'HEALTHY' THEN 1 END)"
NOT_FAILED = "count(CASE WHEN health NOT IN ('DOWN', 'FUNCTIONAL_FAILURE') THEN 1 END)"
FAILED = "count(CASE WHEN health IN ('DOWN', 'FUNCTIONAL_FAILURE') THEN 1 END)"

SQLS = {
    "s4_normalise": f"{W} SELECT event_id, service, environment, http_status, response_ms, health, retry_count, critical FROM checks",  # H-01..H-11
    "s4_latest": f"{W}, {LATEST} SELECT environment, service, event_id, health, response_ms FROM latest",  # F-01
    "s4_uptime_healthy": f"{W} SELECT environment, {_pct(HEALTHY)} AS uptime, count(*) AS n FROM checks GROUP BY environment",  # D-07
    "s4_uptime_not_failed": f"{W} SELECT environment, {_pct(NOT_FAILED)} AS uptime, count(*) AS n FROM checks GROUP BY environment",  # D-08
    # D-09..D-11b: the four overall-status rules side by side
    "s4_overall": f"""{W}, {LATEST}, u AS (SELECT environment, {_pct(HEALTHY)} AS up FROM checks GROUP BY environment),
        s AS (SELECT environment, count(*) AS n, {HEALTHY} AS healthy, {FAILED} AS failed, count(CASE WHEN health = 'SLOW' THEN 1 END) AS slow, count(CASE WHEN critical AND health IN ('DOWN', 'FUNCTIONAL_FAILURE') THEN 1 END) AS critical_failed FROM latest GROUP BY environment)
        SELECT s.environment, CASE WHEN n = 0 THEN 'UNKNOWN' WHEN healthy = 0 THEN 'DOWN' WHEN up >= 99.9 THEN 'HEALTHY' ELSE 'SLOW' END AS by_uptime,
        CASE WHEN n = 0 THEN 'UNKNOWN' WHEN critical_failed > 0 THEN 'DOWN' WHEN failed + slow > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS by_critical,
        CASE WHEN n = 0 THEN 'UNKNOWN' WHEN critical_failed > 0 THEN 'DOWN' WHEN failed + slow > 0 THEN 'SLOW' ELSE 'HEALTHY' END AS by_dashboard,
        CASE WHEN up >= 99.5 THEN 'HEALTHY' WHEN up >= 95 THEN 'SLOW' ELSE 'DOWN' END AS by_target FROM s JOIN u ON s.environment = u.environment""",
    # D-12, D-13
    "s4_kpis": f"{W}, {LATEST} SELECT count(*) AS monitored, {HEALTHY} AS healthy, {FAILED} AS failed, cast(floor(coalesce(avg(response_ms), 0) + 0.5) AS bigint) AS avg_ms, CASE WHEN count(*) = 0 THEN 'UNKNOWN' ELSE 'KNOWN' END AS state FROM latest",
    # D-14, D-15, G-10
    "s4_latency_p95": f"{W} SELECT service, floor(avg(response_ms) * 1e6 + 0.5) / 1e6 AS mean_ms, cast(percentile_disc(0.95) WITHIN GROUP (ORDER BY response_ms) AS double) AS p95, max(response_ms) AS max_ms, count(CASE WHEN response_ms > 3000 THEN 1 END) AS breaches, count(*) AS samples FROM checks GROUP BY service",
    "s4_worst_latency": f"{W}, p AS (SELECT service, avg(response_ms) AS m, cast(percentile_disc(0.95) WITHIN GROUP (ORDER BY response_ms) AS double) AS p95, count(CASE WHEN response_ms > 3000 THEN 1 END) AS breaches FROM checks GROUP BY service), r AS (SELECT *, row_number() OVER (ORDER BY p95 DESC, service) AS rn FROM p) SELECT floor(avg(m) * 1e3 + 0.5) / 1e3 AS mean_of_means, sum(breaches) AS breaches, max(CASE WHEN rn = 1 THEN service END) AS worst FROM r",
    # D-16, D-19, D-20, D-21
    "s4_check_kpis": f"{W} SELECT {HEALTHY} AS passed, {FAILED} AS failed, count(CASE WHEN retry_count > 0 THEN 1 END) AS retried, floor(cast({HEALTHY} AS double) / greatest(count(*), 1) * 1000 + 0.5) / 10 AS success_pct FROM checks",
    "s4_daily_availability": f"{W} SELECT cast(ts AS date) AS day, environment, count(*) AS checks, {FAILED} AS failed, {_pct(NOT_FAILED)} AS availability, max(response_ms) AS max_ms FROM checks GROUP BY cast(ts AS date), environment",
    "s4_uptime_series": f"{W}, d AS (SELECT cast(ts AS date) AS day, {_pct(NOT_FAILED)} AS availability FROM checks GROUP BY cast(ts AS date)), r AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS rn FROM d) SELECT day, availability FROM r WHERE rn <= 14",
    # B-12..B-14: log filter relative to the newest row, pages of 25
    "s4_logs_page": f"{W}, m AS (SELECT max(ts) AS now FROM checks), l AS (SELECT ts, event_id, service, health FROM checks CROSS JOIN m WHERE ts >= now - INTERVAL '24' HOUR AND lower(environment) = 'qa' AND lower(service || ' ' || health) LIKE '%svc%'), t AS (SELECT cast(ceil(count(*) / 25.0) AS bigint) AS pages FROM l), p AS (SELECT * FROM l ORDER BY ts DESC, event_id LIMIT 25) SELECT event_id, service, health, row_number() OVER (ORDER BY ts DESC, event_id) AS rn, pages FROM p CROSS JOIN t",
    "s4_recent": f"{W}, r AS (SELECT ts, event_id, service FROM checks ORDER BY ts DESC, event_id LIMIT 40) SELECT event_id, service, row_number() OVER (ORDER BY ts DESC, event_id) AS rn FROM r",  # F-09, F-11
    # G-14: time by service, the later row wins
    "s4_pivot_latency": f"{W}, h AS (SELECT date_trunc('day', ts) AS bucket, service, response_ms, row_number() OVER (PARTITION BY date_trunc('day', ts), service ORDER BY ts DESC, event_id DESC) AS rn FROM checks) SELECT cast(bucket AS date) AS bucket, max(CASE WHEN service = 'svc-0' THEN response_ms END) AS svc_0, max(CASE WHEN service = 'svc-1' THEN response_ms END) AS svc_1, max(CASE WHEN service = 'svc-2' THEN response_ms END) AS svc_2 FROM h WHERE rn = 1 GROUP BY bucket",
    # G-04: services seen in an environment
    "s4_semi_services": f"{W} SELECT event_id, service FROM checks WHERE environment = 'QA' AND service IN (SELECT service FROM checks WHERE environment = 'Production' AND health = 'DOWN')",
}
QUERIES, ORACLES = both(SQLS)

#: Over the incidents: severity (H-08), KPIs (D-17).
ON_INCIDENTS = {
    "s4_incidents": f"WITH incidents AS (SELECT * FROM {{incidents}}) SELECT incident_id, environment, service, failures, retries, status, cast(CASE WHEN failures >= 4 THEN 'SEV-1' WHEN failures = 3 THEN 'SEV-2' WHEN failures = 2 THEN 'SEV-3' ELSE 'SEV-4' END AS varchar(20)) AS severity FROM incidents",
    "s4_incident_kpis": f"WITH incidents AS (SELECT * FROM {{incidents}}) SELECT count(CASE WHEN status = 'OPEN' THEN 1 END) AS open_n, count(CASE WHEN status = 'RESOLVED' THEN 1 END) AS resolved_n, cast(sum(retries) AS bigint) AS retries FROM incidents",
}


def severity(failures):
    """The severity of an incident by its failed checks (H-08)."""
    return F.when(failures >= 4, "SEV-1").when(failures == 3, "SEV-2").when(failures == 2, "SEV-3").otherwise("SEV-4")


def incident_rows(spark, sf_dir):
    """Stretches of DOWN checks of a service: a run keeps the difference of its places among all and among DOWN checks.

    Places are dealt by ranges, so a service with a third of all checks is spread over many tasks.
    """
    checks = on_spark(spark, sf_dir, f"{W} SELECT environment || '|' || service AS key, environment, service, ts, event_id, retry_count, health = 'DOWN' AS down FROM checks")
    order = [F.asc("ts"), F.asc("event_id")]
    placed = written(sorted_ranks(checks, order, group="key", name="place"))
    down = sorted_ranks(placed.where("down"), order, group="key", name="nth")
    runs = down.groupBy("key", "environment", "service", (F.col("place") - F.col("nth")).alias("island")).agg(
        F.min("event_id").alias("first_id"), F.min("ts").alias("started"), F.max("place").alias("last"), F.count("*").alias("failures"), F.max("retry_count").alias("retries")
    )
    after = placed.select("key", (F.col("place") - 1).alias("last"), F.col("ts").alias("recovered"))
    found = runs.join(after, ["key", "last"], "left")
    status = F.when(F.col("recovered").isNull(), "OPEN").otherwise("RESOLVED")
    return found.select(F.concat(F.lit("INC-"), F.col("first_id").cast("string")).alias("incident_id"), "environment", "service", "started", "recovered", "failures", "retries", status.alias("status"))


def _over_incidents(sql: str):
    return lambda spark, sf_dir: spark.sql(sql, incidents=written(incident_rows(spark, sf_dir)))


QUERIES |= {name: _over_incidents(sql) for name, sql in ON_INCIDENTS.items()}
ORACLES |= {name: on_duckdb(sql.replace("WITH incidents AS (SELECT * FROM {incidents})", f"WITH {INCIDENTS}")) for name, sql in ON_INCIDENTS.items()}
