"""Queries that call the catalogue's tools with parameters, and the dashboard's snapshot of several sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.plans import monitoring
from quillspark.sources.adapters import CASES, on_duckdb, on_spark
from quillspark.sources.tables import table
from quillspark.tools import CatalogueTools


def tools(spark: SparkSession, sf_dir: str) -> CatalogueTools:
    return CatalogueTools(spark, on_spark(spark, sf_dir, f"WITH {CASES} SELECT * FROM cases"))


def _search(spark, sf_dir):
    """B-01, B-03, B-05, B-09: three conditions, an empty list that is none, and a page of too many rows."""
    page = tools(spark, sf_dir).search(module="BUILDING", min_priority="Medium", browsers=[], exclude_statuses=["Deprecated"], keyword=" FLOW 1", sort_by="priority", descending=True, limit=5000, offset=10)
    return page.rows.select("*", F.lit(page.total).alias("total"), F.lit(page.limit).alias("limit"), F.lit(page.has_more).alias("has_more"))


def _joined(found: DataFrame, *columns: str) -> DataFrame:
    return found.withColumns({c: F.array_join(c, ",") for c in columns})


def _integrity(spark, sf_dir):
    return spark.createDataFrame([(k, v) for k, v in tools(spark, sf_dir).integrity().items()], "metric string, n long")


def snapshot(spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """source, ok, rows, warning of each source (G-19): one that fails is a warning, and only if all fail it is an error.

    Each source is read once; what it holds is counted in that pass.
    """
    found = []
    for name, load in loaders.items():
        try:
            seen = Observation()
            load().observe(seen, F.count("*").alias("rows")).write.format("noop").mode("overwrite").save()
            found.append((name, True, seen.get["rows"], None))
        except Exception as problem:  # noqa: BLE001  whatever a source raises is its warning
            found.append((name, False, 0, type(problem).__name__))
    if not any(ok for _, ok, _, _ in found):
        raise RuntimeError(f"no source could be read: {', '.join(loaders)}")
    return spark.createDataFrame(found, "source string, ok boolean, rows long, warning string")


def _dashboard(spark, sf_dir):
    """G-19 over five sources, of which one is not there."""
    return snapshot(
        spark,
        {
            "services": lambda: monitoring.QUERIES["s4_latest"](spark, sf_dir),
            "incidents": lambda: monitoring.incident_rows(spark, sf_dir),
            "logs": lambda: monitoring.QUERIES["s4_normalise"](spark, sf_dir),
            "uptime": lambda: monitoring.QUERIES["s4_daily_availability"](spark, sf_dir),
            "notes": lambda: table(spark, sf_dir, "notes_of_the_day"),
        },
    )


QUERIES = {
    "s2_tool_search": _search,
    "s2_tool_designs": lambda spark, sf_dir: _joined(tools(spark, sf_dir).designs(min_priority="High"), "browsers", "devices", "statuses"),
    "s2_tool_duplicates": lambda spark, sf_dir: tools(spark, sf_dir).duplicates(module="MACHINERY", min_row_count=3).withColumn("issue_keys", F.md5(F.array_join("issue_keys", ",").cast("binary"))),
    "s2_tool_devices": lambda spark, sf_dir: tools(spark, sf_dir).device_map().select("design_key", F.explode("devices").alias("browser", "d")).select("design_key", "browser", F.array_join("d", ",").alias("devices")),
    "s2_tool_gaps": lambda spark, sf_dir: tools(spark, sf_dir).coverage_gaps(min_cases=340, test_types=["API", "Security"]),
    "s2_tool_integrity": _integrity,
    "s4_dashboard": _dashboard,
}

_W = f"WITH {CASES}"
_TEXT = ("issue_key", "module", "priority", "status", "test_type", "browser", "device", "summary", "design_key")
ORACLES = {
    "s2_tool_search": on_duckdb(
        f"""{_W}, hits AS (SELECT * FROM cases WHERE module = 'BUILDING' AND priority_rank >= 2 AND status <> 'Deprecated' AND contains(lower(summary || ' ' || module || ' ' || test_type || ' ' || priority), 'flow 1'))
    SELECT issue_key, module, test_type, priority, status, browser, device, summary, (SELECT count(*) FROM hits)::INTEGER AS total, 200 AS limit, (SELECT count(*) FROM hits) > 210 AS has_more FROM hits ORDER BY priority_rank DESC, key_num DESC LIMIT 200 OFFSET 10"""
    ),
    "s2_tool_designs": on_duckdb(
        f"""{_W} SELECT design_key, arg_min(summary, key_num) AS summary, arg_min(module, key_num) AS module, arg_min(test_type, key_num) AS test_type, arg_min(priority, key_num) AS priority, count(*) AS row_count,
    array_to_string(list_sort(list(DISTINCT browser)), ',') AS browsers, array_to_string(list_sort(list(DISTINCT device)), ',') AS devices, array_to_string(list_transform(list_sort(list(DISTINCT {{'r': -status_rank, 's': status}})), lambda x: x.s), ',') AS statuses, arg_min(issue_key, key_num) AS sample_issue_key
    FROM cases WHERE priority_rank >= 3 GROUP BY design_key"""
    ),
    "s2_tool_duplicates": on_duckdb(
        f"{_W} SELECT design_key, count(*) AS row_count, arg_min(summary, key_num) AS summary, arg_min(module, key_num) AS module, arg_min(test_type, key_num) AS test_type, md5(string_agg(issue_key, ',' ORDER BY key_num)) AS issue_keys FROM cases WHERE module = 'MACHINERY' GROUP BY design_key HAVING count(*) >= 3"
    ),
    "s2_tool_devices": on_duckdb(f"{_W} SELECT design_key, browser, array_to_string(list_sort(list(DISTINCT device)), ',') AS devices FROM cases GROUP BY design_key, browser"),
    "s2_tool_gaps": on_duckdb(
        f"""{_W}, m AS (SELECT DISTINCT module FROM cases), n AS (SELECT module, test_type, count(*) AS n FROM cases GROUP BY module, test_type)
    SELECT m.module, t.test_type, coalesce(n, 0) AS cases, CASE WHEN n IS NULL THEN 'missing' ELSE 'thin' END AS kind FROM m, (VALUES ('API'), ('Security')) AS t(test_type) LEFT JOIN n ON n.module = m.module AND n.test_type = t.test_type WHERE coalesce(n, 0) < 340"""
    ),
    "s2_tool_integrity": on_duckdb(
        f"{_W} SELECT 'n_rows' AS metric, count(*) AS n FROM cases "
        + "".join(f"UNION ALL SELECT 'blank_{c}', count(*) FROM cases WHERE trim(coalesce({c}, '')) = '' " for c in _TEXT)
        + "UNION ALL SELECT 'unknown_priority', count(*) FROM cases WHERE priority NOT IN ('Highest', 'High', 'Medium', 'Low') UNION ALL SELECT 'unknown_status', count(*) FROM cases WHERE status NOT IN ('Ready', 'Automated', 'Draft', 'Deprecated') "
        "UNION ALL SELECT 'repeated_keys', count(*) FROM (SELECT issue_key FROM cases GROUP BY 1 HAVING count(*) > 1)"
    ),
    "s4_dashboard": f"""SELECT 'services' AS source, true AS ok, count(*) AS rows, NULL::VARCHAR AS warning FROM ({monitoring.ORACLES["s4_latest"]}) UNION ALL SELECT 'incidents', true, count(*), NULL FROM ({monitoring.ORACLES["s4_incidents"]})
    UNION ALL SELECT 'logs', true, count(*), NULL FROM ({monitoring.ORACLES["s4_normalise"]}) UNION ALL SELECT 'uptime', true, count(*), NULL FROM ({monitoring.ORACLES["s4_daily_availability"]}) UNION ALL SELECT 'notes', false, 0, 'AnalysisException'""",
}
