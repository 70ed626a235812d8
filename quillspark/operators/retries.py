"""Retry policies out of key/value settings, and what a policy makes of an incident: its timeline and its attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What holds where a setting is missing.
ATTEMPTS, DELAYS, LAST_DELAY, THRESHOLD_MS, INTERVAL_MIN = 3, (20, 30), 30, 3000, 5


def _number(text: Column) -> Column:
    """The whole number that a text is; 0 for anything else."""
    return F.coalesce(F.trim(text).try_cast("int"), F.lit(0))


def pivot_settings(rows: DataFrame, scope: str = "scope", order: str = "pos", key: str = "k", value: str = "v") -> DataFrame:
    """scope, threshold_ms, attempts, delays, interval_min: one typed row for each scope out of key and value rows (G-15).

    The last row of a key counts. Delays are the positive numbers of a comma-separated list, else one delay in
    milliseconds, else the usual ones; they are cut or padded with the last to one less than the attempts (D-34).
    """
    last = rows.groupBy(scope, key).agg(F.max_by(value, order).alias("_v"))
    of = lambda name: F.max(F.when(F.col(key) == name, F.col("_v")))
    wide = last.groupBy(scope).agg(*[of(n).alias(f"_{n}") for n in ("responseTimeThresholdMs", "retryAttempts", "retryCount", "retryDelaysSeconds", "retryDelayMs", "checkIntervalMinutes")])
    listed = F.filter(F.transform(F.split("_retryDelaysSeconds", ","), _number), lambda n: n > 0)
    single = _number(F.col("_retryDelayMs"))
    usual = F.when(single > 0, F.array(F.floor(single / 1000 + 0.5).cast("int"))).otherwise(F.array(*[F.lit(d) for d in DELAYS]))
    typed = wide.select(
        scope,
        F.coalesce(F.nullif(_number(F.col("_responseTimeThresholdMs")), F.lit(0)), F.lit(THRESHOLD_MS)).alias("threshold_ms"),
        F.coalesce(F.col("_retryAttempts").try_cast("int"), F.col("_retryCount").try_cast("int"), F.lit(ATTEMPTS)).alias("attempts"),
        F.when(F.size(listed) > 0, listed).otherwise(usual).alias("delays"),
        F.coalesce(F.nullif(_number(F.col("_checkIntervalMinutes")), F.lit(0)), F.lit(INTERVAL_MIN)).alias("interval_min"),
    )
    return typed.withColumn("delays", padded(F.col("delays"), F.col("attempts") - 1))


def padded(delays: Column, n: Column) -> Column:
    """The first n delays; where there are fewer, the last one again, or LAST_DELAY if there is none."""
    each = lambda i: F.coalesce(F.get(delays, i - 1), F.try_element_at(delays, F.lit(-1)), F.lit(LAST_DELAY))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), each)).otherwise(F.array().cast("array<int>"))


def ladder(delays: Column) -> Column:
    """array of (i, delay, scheduled, retried, cursor), seconds after the start: a retry is scheduled a second after the cursor, which then moves on by that second and the delay (H-13)."""
    kind = "array<struct<i:int,delay:int,scheduled:int,retried:int,cursor:int>>"

    def step(done: Column, delay: Column) -> Column:
        at = F.coalesce(F.try_element_at(done, F.lit(-1))["cursor"], F.lit(0))
        one = F.struct((F.size(done) + 1).alias("i"), delay.alias("delay"), (at + 1).alias("scheduled"), (at + delay).alias("retried"), (at + 1 + delay).alias("cursor"))
        return F.concat(done, F.array(one)).cast(kind)

    return F.aggregate(delays, F.array().cast(kind), step)


def _recovery_ms() -> Column:
    return ((F.unix_micros(F.col("recovered").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000).cast("long")


def _row(pos: Column, kind: str | Column, off_ms: Column, attempt: Column, delay: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(pos.cast("int").alias("pos"), kind.alias("kind"), off_ms.cast("long").alias("off_ms"), attempt.cast("int").alias("attempt"), delay.cast("int").alias("delay_s"))


def timeline(incidents: DataFrame) -> DataFrame:
    """incident_id, pos, kind, off_ms: the derived events of an incident (G-16). incidents: incident_id, started, recovered, delays."""
    none = F.lit(None)
    steps = incidents.withColumn("_l", ladder(F.col("delays"))).withColumn("_r", _recovery_ms())
    end = F.coalesce(F.try_element_at("_l", F.lit(-1))["cursor"], F.lit(0))
    n = 2 * F.size("_l")
    retries = F.flatten(F.transform("_l", lambda s: F.array(_row(2 * s["i"], "schedule", s["scheduled"] * 1000, s["i"], s["delay"]), _row(2 * s["i"] + 1, "retry", s["retried"] * 1000, s["i"], none))))
    tail = F.array(_row(n + 2, "incident", end * 1000, none, none), _row(n + 3, "recovery", F.col("_r"), none, none))
    rows = F.concat(F.array(_row(F.lit(1), "failure", F.lit(0), none, none)), retries, tail)
    return steps.select("incident_id", F.explode(F.filter(rows, lambda x: x["off_ms"].isNotNull())).alias("e")).select("incident_id", "e.pos", "e.kind", "e.off_ms")


def retry_history(incidents: DataFrame) -> DataFrame:
    """incident_id, pos, attempt, outcome, delay_s, off_ms: the attempts of an incident, up to the first one by whose end it had recovered (G-17)."""
    none = F.lit(None)
    steps = incidents.withColumn("_r", _recovery_ms()).withColumn("_l", ladder(F.col("delays")))
    fine = lambda s: F.coalesce(F.col("_r") <= s["cursor"] * 1000, F.lit(False))
    first = F.get(F.filter("_l", fine), 0)["i"]
    kept = steps.withColumn("_l", F.filter("_l", lambda s: s["i"] <= F.coalesce(first, F.size("_l"))))
    end = F.coalesce(F.try_element_at("_l", F.lit(-1))["cursor"], F.lit(0))
    tries = F.flatten(F.transform("_l", lambda s: F.array(_row(2 * s["i"], "scheduled", s["scheduled"] * 1000, s["i"] + 1, s["delay"]), _row(2 * s["i"] + 1, F.when(fine(s), "succeeded").otherwise("failed"), s["retried"] * 1000, s["i"] + 1, none))))
    last = _row(2 * F.size("_l") + 2, "info", F.coalesce(F.col("_r"), end * 1000), F.lit(1), none)
    rows = F.concat(F.array(_row(F.lit(1), "failed", F.lit(0), F.lit(1), none)), tries, F.array(last))
    return kept.select("incident_id", F.explode(rows).alias("e")).select("incident_id", "e.pos", "e.attempt", F.col("e.kind").alias("outcome"), "e.delay_s", "e.off_ms")


def retry_kpis(history: DataFrame) -> DataFrame:
    """outcome, n, mean_delay_s: attempts by outcome, and the mean delay of the scheduled ones, a missing delay counting as 0 (D-18)."""
    mean = F.when(F.col("outcome") == "scheduled", F.floor(F.col("m") * 1e6 + 0.5) / 1e6)
    counts = history.groupBy("outcome").agg(F.count("*").alias("n"), F.avg(F.coalesce("delay_s", F.lit(0))).alias("m"))
    return counts.select("outcome", "n", mean.alias("mean_delay_s"))
