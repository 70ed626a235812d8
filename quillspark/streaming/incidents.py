"""The incident of a service as state: opened by its first DOWN check, closed by the next check that is not DOWN."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.sources.adapters import CHECKS, INCIDENTS, on_duckdb
from quillspark.sources.tables import table
from quillspark.streaming.health import run_to_end

_CLOSED = "environment string, service string, incident_id string, failures long, retries long"


def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Incidents of a service that its new checks close; the one that stays open is the state.

    Checks within a trigger are put into order; one that comes in a later trigger counts as later.
    """
    checks = pd.concat(frames).sort_values(["ts", "event_id"])
    first, failures, retries = state.get if state.exists else (-1, 0, 0)
    closed = []
    for event_id, down, retry_count in zip(checks.event_id, checks.down, checks.retry_count, strict=True):
        if down:
            first = int(event_id) if failures == 0 else min(first, int(event_id))
            failures, retries = failures + 1, max(retries, int(retry_count))
        elif failures:
            closed.append((*key, f"INC-{first}", failures, retries))
            first, failures, retries = -1, 0, 0
    state.update((first, failures, retries))
    yield pd.DataFrame(closed, columns=["environment", "service", "incident_id", "failures", "retries"])


def closed_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """environment, service, incident_id, failures, retries of every incident that has ended."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    checks = spark.sql(f"WITH {CHECKS} SELECT environment, service, event_id, ts, health = 'DOWN' AS down, retry_count FROM checks", events=events)
    keyed = checks.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("environment", "service")
    return run_to_end(keyed.applyInPandasWithState(follow, _CLOSED, "first long, failures long, retries long", "append", GroupStateTimeout.NoTimeout))


QUERIES = {"st_incidents": closed_incidents}
ORACLES = {"st_incidents": on_duckdb(f"WITH {INCIDENTS} SELECT environment, service, incident_id, failures, retries FROM incidents WHERE status = 'RESOLVED'")}
