"""Settings, timelines and retries of the incidents, with policies that come from a table of key and value rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators.retries import pivot_settings, retry_history, retry_kpis, timeline
from quillspark.plans.monitoring import incident_rows
from quillspark.sources.adapters import INCIDENTS, on_duckdb, on_spark
from quillspark.sources.scratch import written

#: The nations as key and value rows of five services' settings: lists with blanks, zeros and junk, repeated keys, gaps.
ROWS = """kv AS (SELECT 'svc-' || cast(n_nationkey % 5 AS varchar(20)) AS scope, 10 * n_nationkey AS pos, 'retryAttempts' AS k, cast(2 + n_nationkey % 4 AS varchar(40)) AS v FROM {nation} WHERE n_nationkey % 5 <> 4
    UNION ALL SELECT 'svc-' || cast(n_nationkey % 5 AS varchar(20)), 10 * n_nationkey + 1, 'retryDelaysSeconds', cast(5 + n_nationkey AS varchar(20)) || ', ' || cast(n_regionkey * 0 AS varchar(20)) || ',x, ' || cast(30 + n_nationkey AS varchar(20)) FROM {nation} WHERE n_nationkey % 5 < 3
    UNION ALL SELECT 'svc-' || cast(n_nationkey % 5 AS varchar(20)), 10 * n_nationkey + 2, 'retryDelayMs', cast(1700 * n_nationkey AS varchar(40)) FROM {nation} WHERE n_nationkey % 5 = 3
    UNION ALL SELECT 'svc-' || cast(n_nationkey % 5 AS varchar(20)), 10 * n_nationkey + 3, 'note', n_name FROM {nation})"""


def _settings(spark, sf_dir):
    return pivot_settings(on_spark(spark, sf_dir, f"WITH {ROWS} SELECT * FROM kv"))


def _with_policy(spark, sf_dir):
    """Incidents with the delays of their service; the settings have a row for each service."""
    policy = _settings(spark, sf_dir).select(F.col("scope").alias("service"), "delays")
    return written(incident_rows(spark, sf_dir)).join(policy, "service")


QUERIES = {
    "s4_settings_pivot": lambda spark, sf_dir: _settings(spark, sf_dir).select("scope", "threshold_ms", "attempts", "interval_min"),
    "s4_delay_ladder": lambda spark, sf_dir: _settings(spark, sf_dir).select("scope", F.posexplode("delays").alias("pos", "delay_s")),
    "s4_timeline": lambda spark, sf_dir: timeline(_with_policy(spark, sf_dir)),
    "s4_retry_history": lambda spark, sf_dir: retry_history(_with_policy(spark, sf_dir)),
    "s4_retry_kpis": lambda spark, sf_dir: retry_kpis(retry_history(_with_policy(spark, sf_dir))),
}

_SETTINGS = f"""{ROWS}, last AS (SELECT scope, k, arg_max(v, pos) AS v FROM kv GROUP BY ALL),
wide AS (SELECT scope, coalesce(max(try_cast(v AS INT)) FILTER (k = 'retryAttempts'), 3) AS attempts, list_filter(list_transform(string_split(max(v) FILTER (k = 'retryDelaysSeconds'), ','), lambda x: coalesce(try_cast(trim(x) AS INT), 0)), lambda x: x > 0) AS listed,
    floor(coalesce(max(try_cast(v AS INT)) FILTER (k = 'retryDelayMs'), 0) / 1000 + 0.5)::INT AS single FROM last GROUP BY scope),
chosen AS (SELECT scope, attempts, CASE WHEN len(listed) > 0 THEN listed WHEN single > 0 THEN [single] ELSE [20, 30] END AS d FROM wide),
settings AS (SELECT scope, attempts, list_transform(range(1, attempts), lambda i: coalesce(d[i], d[-1], 30)) AS delays FROM chosen)"""
_STEPS = f"""{INCIDENTS}, {_SETTINGS}, start AS (SELECT incident_id, delays, (epoch_us(recovered) - epoch_us(started)) // 1000 AS back FROM incidents JOIN settings ON scope = service),
steps AS (SELECT incident_id, delays, back, 0 AS i, 0 AS cursor, 0 AS before, false AS fine FROM start
    UNION ALL SELECT incident_id, delays, back, i + 1, cursor + 1 + delays[i + 1], cursor, coalesce(back <= (cursor + 1 + delays[i + 1]) * 1000, false) FROM steps WHERE i < len(delays)),
stops AS (SELECT incident_id, min(i) AS stop FROM steps WHERE fine GROUP BY 1),
kept AS (SELECT steps.* FROM steps LEFT JOIN stops USING (incident_id) WHERE i <= coalesce(stop, 1000)),
ends AS (SELECT incident_id, max(back) AS back, max(i) AS n, max(cursor) AS cursor FROM kept GROUP BY 1),
history AS (SELECT incident_id, 1 AS pos, 1 AS attempt, 'failed' AS outcome, NULL::INT AS delay_s, 0::BIGINT AS off_ms FROM start
    UNION ALL SELECT incident_id, 2 * i, i + 1, 'scheduled', delays[i], (before + 1) * 1000 FROM kept WHERE i > 0
    UNION ALL SELECT incident_id, 2 * i + 1, i + 1, CASE WHEN fine THEN 'succeeded' ELSE 'failed' END, NULL, (cursor - 1) * 1000 FROM kept WHERE i > 0
    UNION ALL SELECT incident_id, 2 * n + 2, 1, 'info', NULL, coalesce(back, cursor * 1000) FROM ends)"""
ORACLES = {
    "s4_settings_pivot": on_duckdb(f"WITH {_SETTINGS} SELECT scope, 3000 AS threshold_ms, attempts, 5 AS interval_min FROM settings"),
    "s4_delay_ladder": on_duckdb(f"WITH {_SETTINGS} SELECT scope, (unnest(range(len(delays))))::INT AS pos, unnest(delays) AS delay_s FROM settings"),
    "s4_timeline": on_duckdb(
        f"""WITH RECURSIVE {_STEPS}, every AS (SELECT incident_id, max(back) AS back, max(i) AS n, max(cursor) AS cursor FROM steps GROUP BY 1)
    SELECT incident_id, 1 AS pos, 'failure' AS kind, 0::BIGINT AS off_ms FROM start UNION ALL SELECT incident_id, 2 * i, 'schedule', (before + 1) * 1000 FROM steps WHERE i > 0
    UNION ALL SELECT incident_id, 2 * i + 1, 'retry', (cursor - 1) * 1000 FROM steps WHERE i > 0 UNION ALL SELECT incident_id, 2 * n + 2, 'incident', cursor * 1000 FROM every
    UNION ALL SELECT incident_id, 2 * n + 3, 'recovery', back FROM every WHERE back IS NOT NULL"""
    ),
    "s4_retry_history": on_duckdb(f"WITH RECURSIVE {_STEPS} SELECT * FROM history"),
    "s4_retry_kpis": on_duckdb(f"WITH RECURSIVE {_STEPS} SELECT outcome, count(*) AS n, CASE WHEN outcome = 'scheduled' THEN floor(avg(coalesce(delay_s, 0)) * 1e6 + 0.5) / 1e6 END AS mean_delay_s FROM history GROUP BY outcome"),
}
