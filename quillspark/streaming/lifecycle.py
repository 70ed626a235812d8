"""Incident lifecycle over a stream in event time: checks wait in state until the watermark has passed them.

Checks of a service may come in any order, from many files, as long as they are no later than the watermark's delay.
They are kept by day; a timer at each day's end says that the day is complete, and only then are its checks put into
order and taken through the lifecycle: the first DOWN check opens an incident, the next check that is not DOWN closes
it. What is open, and how many checks in a row were SLOW, is one value of state. So a hot service holds the checks of
the days that are not complete yet, not its whole history, and a task orders one day of one service at a time. Timers
come in the order of their times, so days do as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspark.plans.monitoring import severity
from quillspark.sources.adapters import CHECKS, on_duckdb
from quillspark.sources.tables import table
from quillspark.streaming.health import run_to_end

#: Checks of a service that are put into order together: those of a day.
SPAN_MS = 86_400_000
SPAN_US = 1000 * SPAN_MS
DELAY = "10 minutes"
OUT = "environment string, service string, incident_id string, started timestamp, recovered timestamp, failures long, retries long, slow_before long"

#: Provider that state with timers and several variables needs, and what turns it on for a session.
STATE_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Lifecycle(StatefulProcessor):
    """Incidents of one (environment, service)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # checks of the days that are not complete, as parallel arrays; times in microseconds, as checks of one millisecond have an order
        self.days = handle.getMapState("days", "day long", "ts array<long>, event_id array<long>, state array<int>, retry_count array<long>")
        # the incident that is open (failures 0: none), and SLOW checks in a row up to now
        self.open = handle.getValueState("open", "first_id long, started long, failures long, retries long, slow_before long, slow long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            ts = frame.ts.astype("datetime64[us]").astype("int64")
            for day, own in frame.assign(us=ts).groupby(ts // SPAN_US):
                new = [own[c].tolist() for c in ("us", "event_id", "state", "retry_count")]
                before = self.days.getValue((int(day),))
                if before is None:
                    self.handle.registerTimer((int(day) + 1) * SPAN_MS)
                else:
                    new = [[*a, *b] for a, b in zip(before, new, strict=True)]
                self.days.updateValue((int(day),), tuple(new))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() // SPAN_MS - 1
        checks = self.days.getValue((day,))
        if checks is not None:
            self.days.removeKey((day,))
            yield self._follow(key, sorted(zip(*checks, strict=True)))

    def _follow(self, key, checks: list[tuple]) -> pd.DataFrame:
        first, started, failures, retries, before, slow = self.open.get() if self.open.exists() else (0, 0, 0, 0, 0, 0)
        closed = []
        for ts, event_id, state, retry_count in checks:
            if state == 2:
                if failures == 0:
                    first, started, retries, before = event_id, ts, 0, slow
                failures, first, retries = failures + 1, min(first, event_id), max(retries, retry_count)
            elif failures:
                closed.append((*key, f"INC-{first}", pd.Timestamp(started, unit="us"), pd.Timestamp(ts, unit="us"), failures, retries, before))
                failures = 0
            slow = slow + 1 if state == 1 else 0
        self.open.update((first, started, failures, retries, before, slow))
        return pd.DataFrame(closed, columns=["environment", "service", "incident_id", "started", "recovered", "failures", "retries", "slow_before"])

    def close(self) -> None:
        pass


def duration_s(started: Column, recovered: Column) -> Column:
    """Whole seconds between two times to the nearest millisecond, half up, never below zero (H-12)."""
    nearest = lambda t: F.call_function("div", F.unix_micros(t) + 500, F.lit(1000).cast("long"))
    millis = nearest(recovered) - nearest(started)
    return F.greatest(F.lit(0).cast("long"), F.floor(millis / 1000 + F.lit(0.5)))


def incident_stream(checks: DataFrame, delay: str = DELAY) -> DataFrame:
    """Incidents as they close, out of a stream of checks: environment, service, ts, event_id, state (2 DOWN, 1 SLOW, else 0), retry_count."""
    keyed = checks.withWatermark("ts", delay).groupBy("environment", "service")
    closed = keyed.transformWithStateInPandas(Lifecycle(), OUT, "append", "EventTime")
    return closed.withColumn("duration_s", duration_s(F.col("started"), F.col("recovered"))).withColumn("severity", severity(F.col("failures")))


def check_stream(spark: SparkSession, path: str, schema, files_at_once: int | None = None) -> DataFrame:
    """Checks out of the event files below path."""
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    events = reader.parquet(path)
    return spark.sql(
        f"WITH {CHECKS} SELECT environment, service, cast(ts AS timestamp) AS ts, event_id, CASE health WHEN 'DOWN' THEN 2 WHEN 'SLOW' THEN 1 ELSE 0 END AS state, retry_count FROM checks", events=events
    )


def run_incidents(spark: SparkSession, path: str, schema, files_at_once: int | None = None, delay: str = DELAY) -> DataFrame:
    """Incidents that have closed, out of all files below path; those that closed within the delay before the newest check, or on its day, are still open."""
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        return run_to_end(incident_stream(check_stream(spark, path, schema, files_at_once), delay))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def incident_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """environment, service, incident_id, failures, retries, slow_before, duration_s, severity of every incident that has closed for good."""
    found = run_incidents(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events").schema)
    return found.drop("started", "recovered")


QUERIES = {"st_incident_lifecycle": incident_lifecycle}

# a day counts once the watermark, ten minutes behind the newest check, has reached its end
ORACLES = {
    "st_incident_lifecycle": on_duckdb(
        f"""WITH {CHECKS}, final AS (SELECT *, ts - lag(ts) OVER w AS gap, lead(ts) OVER w AS next_ts, row_number() OVER w AS rn, health = 'DOWN' AS down, sum(CASE WHEN health = 'SLOW' THEN 0 ELSE 1 END) OVER w AS stretch
    FROM checks WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM checks) - INTERVAL 10 MINUTE WINDOW w AS (PARTITION BY environment, service ORDER BY ts, event_id)),
slow AS (SELECT *, count(*) FILTER (health = 'SLOW') OVER (PARTITION BY environment, service, stretch ORDER BY ts, event_id) AS slow_run FROM final),
prior AS (SELECT *, coalesce(lag(slow_run) OVER (PARTITION BY environment, service ORDER BY ts, event_id), 0) AS before FROM slow),
islands AS (SELECT *, rn - row_number() OVER (PARTITION BY environment, service ORDER BY ts, event_id) AS island FROM prior WHERE down),
inc AS (SELECT environment, service, 'INC-' || min(event_id) AS incident_id, count(*) AS failures, max(retry_count) AS retries, arg_min(before, (ts, event_id)) AS slow_before, min(ts) AS started, max(next_ts) AS recovered, count(next_ts) = count(*) AS closed FROM islands GROUP BY environment, service, island)
SELECT environment, service, incident_id, failures, retries::BIGINT AS retries, slow_before::BIGINT AS slow_before, greatest(0, floor((epoch_ms(recovered) - epoch_ms(started)) / 1000 + 0.5))::BIGINT AS duration_s,
    CASE WHEN failures >= 4 THEN 'SEV-1' WHEN failures = 3 THEN 'SEV-2' WHEN failures = 2 THEN 'SEV-3' ELSE 'SEV-4' END AS severity FROM inc WHERE closed"""
    )
}
