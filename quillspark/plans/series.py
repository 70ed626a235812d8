"""Series in source order: which rows an uptime series is made of, and the last of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.ranking import sorted_ranks
from quillspark.sources.adapters import CHECKS, on_duckdb, on_spark
from quillspark.sources.ordered import PLACE, read_in_order, tail
from quillspark.sources.scratch import scratch_path, written

#: Rows that the series' source gives, and days that a chart shows; rows of a log that are given out.
GIVEN, SHOWN, LOGGED = 31, 14, 1000
FILES = 5

#: Daily availability as a sheet has it: some percentages missing, some dates blank, a row for all services on some days.
DAYS = f"""{CHECKS}, d AS (SELECT cast(ts AS date) AS day, environment, count(*) AS checks, count(CASE WHEN health IN ('DOWN', 'FUNCTIONAL_FAILURE') THEN 1 END) AS failed FROM checks GROUP BY cast(ts AS date), environment),
o AS (SELECT day, 'OVERALL' AS environment, sum(checks) AS checks, sum(failed) AS failed FROM d WHERE day >= date '2024-01-10' GROUP BY day),
u AS (SELECT day, environment, checks, failed FROM d UNION ALL SELECT day, environment, cast(checks AS bigint), cast(failed AS bigint) FROM o),
sheet AS (SELECT CASE WHEN day(day) % 9 = 4 THEN '' ELSE cast(day AS varchar(10)) END AS date_text, day, environment, checks, failed,
    CASE WHEN day(day) % 3 = 0 THEN NULL ELSE floor(cast(checks - failed AS double) / checks * 10000 + 0.5) / 100 END AS reported FROM u)"""


def uptime_points(sheet: DataFrame) -> DataFrame:
    """date_text, uptime, checks, failed of the points of a chart (D-20, D-21, B-16, F-09).

    sheet: date_text, environment, checks, failed, reported, with the place of each row. If any row is for all services,
    only those count. Of these the last GIVEN in source order are given out; those without a date are dropped, and the
    last SHOWN by date are shown. A missing percentage is worked out of the counts, and 0 where there are none.
    """
    overall = F.upper("environment") == "OVERALL"
    some = sheet.where(overall).limit(1).count() > 0
    given = tail(sheet.where(overall) if some else sheet, GIVEN)
    worked = F.when(F.col("checks") > 0, F.floor((F.col("checks") - F.col("failed")) / F.col("checks") * 10000 + 0.5) / 100).otherwise(0.0)
    points = given.where("date_text <> ''").select("date_text", F.coalesce("reported", worked).alias("uptime"), "checks", "failed", *PLACE)
    return points.orderBy(F.desc("date_text"), *[F.desc(c) for c in PLACE]).limit(SHOWN).drop(*PLACE)


def _sheet(spark, sf_dir, where="true"):
    """The sheet written to several files in the order of day and environment, read back with places."""
    rows = on_spark(spark, sf_dir, f"WITH {DAYS} SELECT * FROM sheet WHERE {where}")
    path = scratch_path(spark)
    ordered = rows.repartitionByRange(FILES, "day", "environment").sortWithinPartitions("day", "environment").drop("day")
    ordered.write.parquet(path)
    return read_in_order(spark, path, ordered.schema)


def _uptime_choice(spark, sf_dir):
    with_all, without = uptime_points(_sheet(spark, sf_dir)), uptime_points(_sheet(spark, sf_dir, "environment <> 'OVERALL'"))
    return with_all.select(F.lit("overall").alias("series"), "*").unionByName(without.select(F.lit("each").alias("series"), "*"))


def _log_tail(spark, sf_dir):
    """F-09: the last 1000 checks in source order, given in that order again."""
    checks = on_spark(spark, sf_dir, f"WITH {CHECKS} SELECT event_id, service, health, ts FROM checks")
    path = scratch_path(spark)
    checks.repartitionByRange(FILES, "ts", "event_id").sortWithinPartitions("ts", "event_id").write.parquet(path)
    last = written(tail(read_in_order(spark, path, checks.schema), LOGGED))
    return sorted_ranks(last, [F.asc(c) for c in PLACE], name="pos").select("pos", "event_id", "service", "health")


QUERIES = {"s4_uptime_choice": _uptime_choice, "s4_log_tail": _log_tail}


def _points(series: str, where: str) -> str:
    return f"""SELECT '{series}' AS series, date_text, coalesce(reported, CASE WHEN checks > 0 THEN floor((checks - failed) / checks * 10000 + 0.5) / 100 ELSE 0 END) AS uptime, checks, failed
    FROM (SELECT * FROM (SELECT * FROM sheet WHERE {where} ORDER BY day DESC, environment DESC LIMIT {GIVEN}) WHERE date_text <> '' ORDER BY date_text DESC, environment DESC LIMIT {SHOWN})"""


ORACLES = {
    "s4_uptime_choice": on_duckdb("WITH " + DAYS + " " + _points("overall", "environment = 'OVERALL'") + " UNION ALL " + _points("each", "environment <> 'OVERALL'")),
    "s4_log_tail": on_duckdb(f"WITH {CHECKS} SELECT row_number() OVER (ORDER BY ts, event_id) AS pos, event_id, service, health FROM (SELECT * FROM checks ORDER BY ts DESC, event_id DESC LIMIT {LOGGED})"),
}
