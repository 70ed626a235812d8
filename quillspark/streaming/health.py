"""Streaming twins of the health queries: bounded runs over an input folder with triggers that end by themselves.

Results go to Parquet in the shared folder, exactly once by checkpoint, and are read back; nothing passes the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.scratch import scratch_path
from quillspark.sources.tables import table


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream with a proper event time (the files hold times without a zone)."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # as a pattern the path may be a file or a folder
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("service", F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")))


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming DataFrame over what is there now and returns the rows it wrote."""
    spark, base = stream.sparkSession, scratch_path(stream.sparkSession)
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def upsert(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")  # complete results: the last epoch holds everything

    query = stream.writeStream.outputMode(mode).foreachBatch(upsert).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling days by event type."""
    counts = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("total"))
    return run_to_end(counts.select(F.col("window.start").cast("date").alias("day"), "event_type", "n", (F.floor(F.col("total") * 100 + 0.5) / 100).alias("total")), "complete")


def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 24 hours every 12 hours."""
    counts = event_stream(spark, sf_dir).groupBy(F.window("ts", "24 hours", "12 hours")).agg(F.count("*").alias("n"))
    return run_to_end(counts.select(F.unix_timestamp("window.start").alias("start_s"), "n"), "complete")


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events once each, though the stream repeats them: duplicates are dropped within the watermark."""
    events = event_stream(spark, sf_dir)
    twice = events.unionByName(events)
    return run_to_end(twice.withWatermark("ts", "365 days").dropDuplicates(["event_id", "ts"]).select("event_id", "event_type"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events with gaps under six hours."""
    counted = event_stream(spark, sf_dir).withWatermark("ts", "1 minute").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return run_to_end(counted.select("user_id", F.unix_timestamp("session_window.start").alias("start_s"), "n"), "complete")


QUERIES = {"st_daily_counts": daily_counts, "st_sliding_counts": sliding_counts, "st_dedupe": first_seen, "st_sessions": sessions}

ORACLES = {
    "st_daily_counts": "SELECT cast(ts AS date) AS day, event_type, count(*) AS n, floor(sum(cast(value AS decimal(20,6)))::double * 100 + 0.5) / 100 AS total FROM events GROUP BY 1, 2",
    "st_sliding_counts": "SELECT start_s, count(*) AS n FROM (SELECT unnest([k * 43200, k * 43200 - 43200]) AS start_s FROM (SELECT cast(floor(epoch(ts) / 43200) AS bigint) AS k FROM events)) GROUP BY 1",
    "st_dedupe": "SELECT event_id, event_type FROM events",
    "st_sessions": "SELECT user_id, cast(floor(epoch(min(ts))) AS bigint) AS start_s, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sess FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, sess",
}
