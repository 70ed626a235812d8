"""A stream fed into a keyed store in several triggers, each of them replayed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.scratch import scratch_path
from quillspark.sources.store import Collections, KeyedStore
from quillspark.sources.tables import table

#: Files into which the events are dealt, and so triggers of the stream.
FILES = 4


def latest_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, event_type of each user's newest event (A-10, I-6): every trigger upserts its file, then is replayed."""
    base = scratch_path(spark)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(FILES, "event_id").write.parquet(f"{base}/in")
    store = KeyedStore(spark, f"{base}/store", T.StructType.fromDDL("user_id long, event_id long, event_type string, ts timestamp"), "user_id", ["ts", "event_id"], buckets=8)

    def twice(batch: DataFrame, epoch: int) -> None:
        store.upsert(batch, epoch)
        if store.upsert(batch, epoch):
            raise RuntimeError(f"epoch {epoch} was taken twice")

    stream = spark.readStream.schema(store.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    query = stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return store.read().select("user_id", "event_id", "event_type")


def vector_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, width, rows of three collections made of the embeddings (A-05): one filled twice, one thinned, one rebuilt."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", "vec_id")
    kept = Collections(spark, scratch_path(spark), prefix="rag_", buckets=4)
    kept.put("all", vectors.where("vec_id % 2 = 0"))
    kept.put("all", vectors)
    kept.put("thinned", vectors)
    kept.delete("thinned", vectors.where("vec_id % 3 = 0"))
    kept.put("rebuilt", vectors)
    kept.rebuild("rebuilt", vectors.where("vec_id % 5 = 0"))
    return kept.listing().select("name", "width", "rows")


QUERIES = {"st_upsert_latest": latest_by_user, "s1_vector_collections": vector_collections}
ORACLES = {
    "st_upsert_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "s1_vector_collections": """SELECT name, width, rows FROM (SELECT 'rag_all' AS name, max(len(embedding))::INTEGER AS width, count(*) AS rows FROM embeddings
    UNION ALL SELECT 'rag_thinned', max(len(embedding))::INTEGER, count(*) FROM embeddings WHERE vec_id % 3 <> 0
    UNION ALL SELECT 'rag_rebuilt', max(len(embedding))::INTEGER, count(*) FROM embeddings WHERE vec_id % 5 = 0)""",
}
