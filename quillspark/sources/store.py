"""A keyed table on plain files: upserts that touch only the buckets of their keys, committed one epoch at a time.

Rows lie in hash buckets of their key. An epoch writes the buckets that its keys fall into under its own number, next
to the older ones, and then a manifest that says which epoch each bucket is at. A reader takes the newest finished
manifest, so it sees an epoch wholly or not at all, and writers never overwrite what is being read. An epoch that is
replayed finds its manifest and does nothing, which makes a stream's foreachBatch exactly-once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Files:
    """The few file operations that Spark's readers and writers do not offer, on any Hadoop file system."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """Names directly below a folder, sorted; none if there is no folder."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def drop(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the last by order. It is an aggregate, so a hot key's rows are reduced before they move."""
    fields = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(fields, F.struct(*[F.col(c) for c in order])).alias("_row")).select("_row.*")


class KeyedStore:
    """Rows of one schema, one for each key: upsert, read, look up, delete."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: list[str], buckets: int = 32):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path.rstrip("/"), schema, key, order, buckets
        self.files = Files(spark)

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def epochs(self) -> list[int]:
        """Finished epochs, ascending."""
        names = self.files.names(f"{self.path}/manifest")
        return sorted(int(n[6:]) for n in names if n.startswith("epoch=") and self.files.exists(f"{self.path}/manifest/{n}/_SUCCESS"))

    def layout(self) -> dict[int, int]:
        """The epoch that each bucket is at; a manifest has a row for each bucket at most."""
        done = self.epochs()
        if not done:
            return {}
        rows = self.spark.read.schema("bucket int, at long").parquet(f"{self.path}/manifest/epoch={done[-1]}").collect()
        return {r.bucket: r.at for r in rows}

    def _load(self, layout: dict[int, int]) -> DataFrame:
        if not layout:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/epoch={at}/bucket={b}" for b, at in sorted(layout.items())]).select(self.schema.names)

    def read(self) -> DataFrame:
        """All rows."""
        return self._load(self.layout())

    def get(self, *keys) -> DataFrame:
        """Rows of these keys; only their buckets are read."""
        typed = self.spark.createDataFrame([(k,) for k in keys], T.StructType([self.schema[self.key]]))
        wanted = {r[0] for r in typed.select(self._bucket()).collect()}  # as many as keys asked for
        return self._load({b: at for b, at in self.layout().items() if b in wanted}).where(F.col(self.key).isin(list(keys)))

    def upsert(self, rows: DataFrame, epoch: int) -> bool:
        """Takes rows in; the last by order wins for each key, over what is there as well. False if the epoch was there."""
        return self._commit(epoch, newest(rows.select(self.schema.names), self.key, self.order), lambda old, new: newest(old.unionByName(new), self.key, self.order))

    def delete(self, keys: DataFrame, epoch: int) -> bool:
        """Removes the rows whose key is in keys (a column of that name)."""
        return self._commit(epoch, keys.select(self.key).distinct(), lambda old, gone: old.join(gone, self.key, "left_anti").select(self.schema.names))

    def _commit(self, epoch: int, change: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        if epoch in self.epochs():
            return False
        base = f"{self.path}/staging/epoch={epoch}"
        change.withColumn("_bucket", self._bucket()).write.mode("overwrite").partitionBy("_bucket").parquet(base)
        touched = [int(n[8:]) for n in self.files.names(base) if n.startswith("_bucket=")]
        before = self.layout()
        if touched:
            staged = self.spark.read.schema(change.schema).parquet(base).select(change.columns)
            merged = merge(self._load({b: at for b, at in before.items() if b in touched}), staged)
            data = merged.withColumn("bucket", self._bucket())
            data.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/epoch={epoch}")
        kept = {int(n[7:]) for n in self.files.names(f"{self.path}/data/epoch={epoch}") if n.startswith("bucket=")} if touched else set()
        after = {b: at for b, at in before.items() if b not in touched} | dict.fromkeys(kept, epoch)
        manifest = self.spark.createDataFrame(sorted(after.items()), "bucket int, at long")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/epoch={epoch}")
        self.files.drop(base)
        return True

    def vacuum(self) -> list[int]:
        """Drops the files of epochs that no bucket is at any more, and older manifests; no reader may still be using them."""
        done, live = self.epochs(), set(self.layout().values())
        gone = [e for e in done if e not in live and e != done[-1]]
        for e in done[:-1]:
            self.files.drop(f"{self.path}/manifest/epoch={e}")
        for e in gone:
            self.files.drop(f"{self.path}/data/epoch={e}")
        return gone


def upsert_stream(stream: DataFrame, store: KeyedStore, checkpoint: str) -> None:
    """Feeds what a stream has now into a store; rerunning it after a failure at any point repeats nothing."""
    query = stream.writeStream.foreachBatch(lambda batch, epoch: store.upsert(batch, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class Collections:
    """Named vector collections below a folder: made, listed, filled, looked up, rebuilt, dropped.

    Names that begin with the prefix are this library's own; the settings table next to them is not a collection.
    """

    META = "_meta"

    def __init__(self, spark: SparkSession, root: str, prefix: str = "", buckets: int = 32):
        self.spark, self.root, self.prefix, self.buckets, self.files = spark, root.rstrip("/"), prefix, buckets, Files(spark)

    def owned(self) -> list[str]:
        """Names of the collections, sorted."""
        return [n for n in self.files.names(self.root) if n.startswith(self.prefix) and n != self.META]

    def _meta(self) -> KeyedStore:
        schema = T.StructType.fromDDL("name string, width int, at long, document string")
        return KeyedStore(self.spark, f"{self.root}/{self.META}", schema, "name", ["at"], 1)

    def width(self, name: str, hint: int | None = None, probe: Callable[[], int] | None = None) -> int:
        """The width of a collection's vectors: its own, if it is there; else the hint; else what probe finds. A hint that contradicts it is an error."""
        row = self._meta().get(name).first() if name in self.owned() else None
        if row is not None:
            if hint is not None and hint != row.width:
                raise ValueError(f"collection {name} has width {row.width}, not {hint}")
            return row.width
        if hint is None and probe is None:
            raise ValueError(f"no width known for collection {name}")
        return hint if hint is not None else probe()

    def _store(self, name: str, width: int) -> KeyedStore:
        schema = T.StructType.fromDDL("id string, embedding array<float>, text string, version long")
        return KeyedStore(self.spark, f"{self.root}/{self.prefix}{name.removeprefix(self.prefix)}", schema, "id", ["version"], self.buckets)

    def put(self, name: str, rows: DataFrame, hint: int | None = None, document: str | None = None) -> int:
        """Takes rows (id, embedding, and text if there is one) in; the width is checked in the same pass. Returns it."""
        name = f"{self.prefix}{name.removeprefix(self.prefix)}"
        some = rows.where("embedding is not null").select(F.size("embedding"))
        width = self.width(name, hint, lambda: (some.first() or [0])[0])
        store, meta = self._store(name, width), self._meta()
        epoch = max([-1, *store.epochs()]) + 1
        checked = F.when(F.size("embedding") == width, F.col("embedding").cast("array<float>")).otherwise(F.raise_error(F.lit(f"vector width is not {width}")))
        text = F.col("text") if "text" in rows.columns else F.lit(None).cast("string")
        store.upsert(rows.select(F.col("id").cast("string").alias("id"), checked.alias("embedding"), text.alias("text"), F.lit(epoch).cast("long").alias("version")), epoch)
        at = max([-1, *meta.epochs()]) + 1
        meta.upsert(self.spark.createDataFrame([(name, width, at, document)], meta.schema), at)
        return width

    def rebuild(self, name: str, rows: DataFrame, hint: int | None = None, document: str | None = None) -> int:
        """Replaces a collection; returns how many rows it had before."""
        before = self.count(name)
        self.drop(name)
        self.put(name, rows, hint, document)
        return before

    def read(self, name: str) -> DataFrame:
        return self._store(name, 0).read().select("id", "embedding", "text")

    def get(self, name: str, *ids: str) -> DataFrame:
        """Rows of these ids; only their buckets are read."""
        return self._store(name, 0).get(*ids).select("id", "embedding", "text")

    def count(self, name: str) -> int:
        return self.read(name).count()

    def delete(self, name: str, ids: DataFrame) -> None:
        store = self._store(name, 0)
        store.delete(ids.select(F.col("id").cast("string").alias("id")), max([-1, *store.epochs()]) + 1)

    def drop(self, name: str) -> bool:
        name = f"{self.prefix}{name.removeprefix(self.prefix)}"
        meta = self._meta()
        if name in self.owned():
            meta.delete(self.spark.createDataFrame([(name,)], "name string"), max([-1, *meta.epochs()]) + 1)
        return self.files.drop(f"{self.root}/{name}")

    def listing(self) -> DataFrame:
        """name, width, rows, document of each collection, by name."""
        meta = self._meta().read()
        counts = None
        for name in self.owned():
            one = self.read(name).agg(F.lit(name).alias("name"), F.count("*").alias("rows"))
            counts = one if counts is None else counts.unionByName(one)
        counts = counts if counts is not None else self.spark.createDataFrame([], "name string, rows long")
        return counts.join(meta, "name", "left").select("name", "width", "rows", "document", "at")

    def active(self, explicit: str | None = None, document: str | None = None) -> str | None:
        """The collection to ask: the one named, else the last filled, else one of the document's, else the one with most rows."""
        if explicit:
            return explicit
        rows = self.listing().collect()  # a row for each collection
        filled = [r for r in rows if r.at is not None and r.rows]
        if filled:
            return max(filled, key=lambda r: (r.at, r.name)).name
        same = [r for r in rows if document is not None and r.document == document]
        return max(same or rows, key=lambda r: (r.rows, r.name)).name if rows else None
