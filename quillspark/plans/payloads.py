"""The sheet's rows as JSON payloads, read back as typed entities; the SQL works on the sheet's columns instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import entities
from quillspark.plans.normalise import HEALTH, SHEET, aliased, clamped, flag, pick, slug
from quillspark.sources.adapters import on_duckdb, on_spark

_COLUMNS = {
    "serviceName": "service_name", "Service Name": "service", "Health Status": "status", "Response Time Ms": "response", "HTTP Status": "http", "Critical": "critical",
    "Environment": "env", "Check Type": "check_type", "method": "http_method", "outcome": "kind", "failureReason": "error",
}
_EXTRA = "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN cast(event_id % 4 AS varchar(20)) || ' x' END"


def _rows(spark, sf_dir):
    sheet = on_spark(spark, sf_dir, f"WITH {SHEET} SELECT *, {_EXTRA} AS retries FROM sheet".replace("{g}", ""))
    fields = [x for key, c in _COLUMNS.items() for x in (F.lit(key), F.col(c))]
    policy = F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct((F.col("event_id") % 7).cast("string").alias("maxAttempts"), F.array(F.lit("5"), F.lit("x"), (F.col("event_id") % 3).cast("string")).alias("delaysSeconds"))))
    row = F.create_map(*fields, F.lit("Retry Count"), F.col("retries"), F.lit("retryPolicy"), policy, F.lit("id"), F.lit(None).cast("string"))
    return entities.payload_rows(sheet.select("event_id", F.to_json(row).alias("payload")), "payload")


QUERIES = {
    "s4_entity_services": lambda spark, sf_dir: entities.services(_rows(spark, sf_dir), "event_id").withColumn("delays", F.array_join(F.transform("delays", lambda d: d.cast("int").cast("string")), ",")),
    "s4_entity_logs": lambda spark, sf_dir: entities.log_entries(_rows(spark, sf_dir), "event_id"),
    "s4_entity_retries": lambda spark, sf_dir: entities.retry_attempts(_rows(spark, sf_dir), "event_id"),
    "s4_entity_metrics": lambda spark, sf_dir: entities.metrics(_rows(spark, sf_dir), "event_id"),
    "s4_entity_summary": lambda spark, sf_dir: entities.summary(entities.payload_rows(spark.range(1).select(F.lit('{"failedServices":"3 of all","status":"odd"}').alias("p")), "p"), entities.services(_rows(spark, sf_dir))),
}

_G = ", 'g'"
_NUMBER = "try_cast(nullif(regexp_replace({0}, '[^0-9.+-]', '', 'g'), '') AS DOUBLE)"
_MS, _HTTP, _RETRIES = _NUMBER.format("response"), _NUMBER.format("http"), _NUMBER.format("retries")
_NAME = f"coalesce({pick('service_name', 'service')}, 'Unknown Service')"
_T = f"""WITH {SHEET}, s AS (SELECT *, {_EXTRA} AS retries, coalesce(nullif(service_name, ''), service) AS chosen FROM sheet),
t AS (SELECT *, coalesce(nullif(trim(chosen), ''), 'Unknown Service') AS name, {clamped('env', entities.ENVIRONMENTS, 'QA')} AS environment, {aliased('status', HEALTH, 'UNKNOWN')} AS stated, {_MS} AS ms, {_HTTP}::INT AS code, (coalesce({_RETRIES}, 0) + 1)::INT AS tries FROM s),
u AS (SELECT *, CASE WHEN stated <> 'UNKNOWN' OR code IS NULL THEN stated WHEN code >= 400 THEN 'DOWN' WHEN ms > 3000 THEN 'SLOW' ELSE 'HEALTHY' END AS health FROM t)"""


def _slug(c: str) -> str:
    return slug(c).replace("{g}", _G)


_SERVICES = f"""SELECT event_id, {_slug("environment || '-' || name")} AS id, name, environment, {clamped('check_type', entities.CHECK_TYPES, 'HTTP')} AS check_type, {clamped('http_method', entities.METHODS, 'GET')} AS method, 200 AS expected_status, 3000.0::DOUBLE AS threshold_ms, {flag('critical')} AS critical,
    CASE WHEN event_id % 4 = 0 THEN event_id % 7 ELSE 3 END::INT AS max_attempts, CASE WHEN event_id % 4 <> 0 THEN '20,30' WHEN event_id % 3 > 0 THEN '5,' || event_id % 3 ELSE '5' END AS delays, health AS status, code AS http_status, coalesce(ms, 0) AS response_ms, tries AS attempts FROM u"""
ORACLES = {
    "s4_entity_services": on_duckdb(f"{_T} {_SERVICES}"),
    "s4_entity_logs": on_duckdb(f"{_T} SELECT event_id, {_slug('name')} AS service_id, environment, tries AS attempt, 3 AS max_attempts, health AS status, code AS http_code, coalesce(ms, 0) AS response_ms, CASE WHEN code IS NULL THEN 'No response recorded' ELSE 'HTTP ' || code || ' in ' || coalesce(ms, 0)::BIGINT || ' ms' END AS message FROM u"),
    "s4_entity_retries": on_duckdb(f"{_T} SELECT event_id, NULL::VARCHAR AS incident_id, 1 AS attempt, CASE WHEN lower(trim(kind)) IN ('failed', 'succeeded', 'scheduled', 'info') THEN lower(trim(kind)) ELSE 'info' END AS outcome, NULL::DOUBLE AS delay_s, 'Retry attempt 1 recorded' AS message FROM u"),
    "s4_entity_metrics": on_duckdb(f"{_T} SELECT event_id, {_slug('name')} AS service_id, name, coalesce(ms, 0) AS response_ms, 3000.0::DOUBLE AS threshold_ms FROM u"),
    "s4_entity_summary": on_duckdb(
        f"{_T}, v AS ({_SERVICES}) SELECT CASE WHEN count(*) FILTER (status IN ('DOWN', 'FUNCTIONAL_FAILURE')) > 0 THEN 'DOWN' ELSE 'HEALTHY' END AS overall_status, count(*) AS monitored, count(*) FILTER (status NOT IN ('DOWN', 'FUNCTIONAL_FAILURE')) AS healthy, 3::BIGINT AS failed, floor(avg(response_ms) + 0.5) AS mean_ms FROM v"
    ),
}
