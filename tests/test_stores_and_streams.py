"""Vector index, keyed store, collections and the incident lifecycle, beyond what their queries' SQL shows."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import registry
from quillspark.operators import vectorindex
from quillspark.plans import monitoring
from quillspark.sources.store import Collections, KeyedStore, upsert_stream
from quillspark.streaming.lifecycle import check_stream, run_incidents
from tests.oracle import same_rows

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# vector index


@pytest.mark.parametrize("sf_dir", [SMALL, MEDIUM])
def test_index_recall(spark, sf_dir):
    exact = {(r.item_id, r.doc_id) for r in registry.queries()["s1_cosine_topk"](spark, sf_dir).collect()}
    found = registry.queries()["s1_ann_topk"](spark, sf_dir)
    got = {(r.item_id, r.doc_id) for r in found.collect()}
    assert len(got & exact) / len(exact) >= 0.9
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def clustered(n, width=16, seed=2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(8)]
    return [(i, [float(x + rng.gauss(0, 0.3)) for x in centres[i % 8]]) for i in range(n)]


def test_index_measures_its_probes(spark, tmp_path):
    """With clusters a few cells do, with vectors that point anywhere most are needed."""
    rng = random.Random(5)
    loose = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(600)]
    probes = []
    for name, rows in (("tight", clustered(600)), ("loose", loose)):
        path = vectorindex.build_index(spark.createDataFrame(rows, "id long, embedding array<float>"), str(tmp_path / name), cells=16)
        probes.append(spark.read.parquet(f"{path}/probes").first().probes)
    assert probes[0] < probes[1] <= 16


def test_index_files_every_row_and_reads_only_probed_cells(spark, tmp_path, monkeypatch):
    rows = clustered(400) + [(500, None), (501, []), (502, [0.0] * 16)] + [(600 + i, [1.0] * 16) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>")
    path = vectorindex.build_index(frame, str(tmp_path / "index"), cells=8)
    assert spark.read.parquet(f"{path}/rows").count() == len(rows)
    one = frame.where("id = 3")
    found = vectorindex.search(one, path, k=5, probes=1)
    cells = {r.cell for r in spark.read.parquet(f"{path}/rows").where("id = 3").select("cell").collect()}
    scans = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in scans and len(cells) == 1
    monkeypatch.setattr(vectorindex, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(vectorindex, "QUERIES_AT_ONCE", 2)
    asked = frame.where("id < 20")
    all_cells = {(r.query_id, r.id, r.score) for r in vectorindex.search(asked, path, k=5, probes=8).collect()}
    known = {i: v for i, v in rows if v}
    norm = lambda v: sum(x * x for x in v) ** 0.5 or 1.0
    for q in range(20):
        exact = sorted(((-sum(a * b for a, b in zip(known[q], v, strict=True)) / norm(known[q]) / norm(v), i) for i, v in known.items() if i != q))[:5]
        got = sorted((-s, i) for a, i, s in all_cells if a == q)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in exact], abs=1e-5)
    vectorindex.file_rows(spark.createDataFrame([(900, [0.5] * 16)], "id long, embedding array<float>"), path)
    assert vectorindex.search(spark.createDataFrame([(901, [0.5] * 16)], "id long, embedding array<float>"), path, k=1).first().score == 1.0


def test_index_of_other_widths_and_of_nothing(spark, tmp_path):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id long, embedding array<float>")
    with pytest.raises(ValueError, match="widths"):
        vectorindex.build_index(frame, str(tmp_path / "a"))
    path = vectorindex.build_index(frame.where("id = 1"), str(tmp_path / "b"))
    with pytest.raises(Exception, match="width 1"):
        vectorindex.search(frame.where("id = 2"), path).collect()
    empty = vectorindex.build_index(frame.limit(0), str(tmp_path / "c"))
    assert vectorindex.search(frame.where("id = 1"), empty).count() == 0


# keyed store

SCHEMA = T.StructType().add("k", T.LongType()).add("v", T.StringType()).add("at", T.LongType())


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_store_upserts_replays_and_deletes(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, "k", ["at"], buckets=4)
    assert rows_of(store.read()) == [] and store.epochs() == []
    first = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "n", 1)], SCHEMA)
    assert store.upsert(first, 0) and not store.upsert(first, 0)
    assert rows_of(store.read()) == sorted([(1, "b", 2), (2, "c", 1), (None, "n", 1)], key=str)
    later = spark.createDataFrame([(1, "old", 1), (2, "new", 5), (3, "d", 1)], SCHEMA)  # 1 comes late: what is there stays
    before = store.layout()
    assert store.upsert(later, 1)
    assert rows_of(store.read()) == sorted([(1, "b", 2), (2, "new", 5), (3, "d", 1), (None, "n", 1)], key=str)
    assert set(before.values()) == {0} and set(store.layout().values()) <= {0, 1}
    assert rows_of(store.get(2, 9)) == [(2, "new", 5)]
    assert store.delete(spark.createDataFrame([(2,), (77,)], "k long"), 2) and not store.delete(spark.createDataFrame([(3,)], "k long"), 2)
    assert rows_of(store.read()) == sorted([(1, "b", 2), (3, "d", 1), (None, "n", 1)], key=str)
    assert store.upsert(later.limit(0), 3) and store.epochs() == [0, 1, 2, 3]
    store.vacuum()
    assert rows_of(store.read()) == sorted([(1, "b", 2), (3, "d", 1), (None, "n", 1)], key=str) and store.epochs() == [3]


def test_an_epoch_that_failed_halfway_is_not_seen(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, "k", ["at"], buckets=2)
    store.upsert(spark.createDataFrame([(i, "a", 1) for i in range(10)], SCHEMA), 0)
    later = spark.createDataFrame([(i, "b", 2) for i in range(10)], SCHEMA)
    later.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{store.path}/data/epoch=1")  # died before its manifest
    assert {r.v for r in store.read().collect()} == {"a"}
    assert store.upsert(later, 1) and {r.v for r in store.read().collect()} == {"b"} and store.read().count() == 10


def test_only_buckets_of_the_keys_are_written(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, "k", ["at"], buckets=16)
    store.upsert(spark.createDataFrame([(i, "a", 1) for i in range(200)], SCHEMA), 0)
    store.upsert(spark.createDataFrame([(5, "b", 2)], SCHEMA), 1)
    assert sorted(store.layout().values()) == [0] * 15 + [1]


def test_a_stream_into_a_store_goes_on_where_it_was(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), SCHEMA, "k", ["at"], buckets=4)
    source = str(tmp_path / "in")

    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        upsert_stream(spark.readStream.schema(SCHEMA).parquet(source), store, str(tmp_path / "state"))

    feed([(1, "a", 1), (2, "a", 1)])
    feed([(2, "b", 2), (3, "a", 1)])
    upsert_stream(spark.readStream.schema(SCHEMA).parquet(source), store, str(tmp_path / "state"))
    assert rows_of(store.read()) == [(1, "a", 1), (2, "b", 2), (3, "a", 1)] and store.epochs() == [0, 1]


def test_collections(spark, tmp_path):
    kept = Collections(spark, str(tmp_path / "root"), prefix="rag_", buckets=2)
    frame = spark.createDataFrame([("a", [1.0, 2.0], "x"), ("b", [3.0, 4.0], "y")], "id string, embedding array<float>, text string")
    assert kept.owned() == [] and kept.active() is None and kept.listing().count() == 0
    assert kept.put("one", frame, document="d1") == 2 and kept.put("two", frame.where("id = 'a'"), hint=2, document="d2") == 2
    assert kept.owned() == ["rag_one", "rag_two"] and kept.count("one") == 2
    with pytest.raises(ValueError, match="width 2, not 3"):
        kept.put("one", frame, hint=3)
    with pytest.raises(Exception, match="width is not 2"):
        kept.put("one", frame.withColumn("embedding", F.expr("array(cast(1 as float))")))
    assert kept.width("new", hint=7) == 7 and kept.width("new", probe=lambda: 9) == 9
    assert [r.text for r in kept.get("one", "b").collect()] == ["y"]
    assert kept.active() == "rag_two" and kept.active(explicit="rag_one") == "rag_one"  # the last filled
    assert kept.rebuild("one", frame.where("id = 'b'"), document="d1") == 2 and kept.count("one") == 1 and kept.active() == "rag_one"
    kept.delete("one", frame.select("id"))
    assert kept.count("one") == 0 and kept.active(document="d1") == "rag_two"
    assert kept.drop("two") and kept.owned() == ["rag_one"] and not kept.drop("two")


# incidents in event time


def test_incidents_from_many_files_in_any_order(spark, tmp_path):
    """Files in any order within the watermark's delay, and rows that come too late."""
    rng = random.Random(8)
    start = dt.datetime(2024, 3, 1)
    events = [(i, start + dt.timedelta(minutes=7 * i, seconds=rng.randrange(300)), rng.randrange(15), rng.choice(["error", "error", "click"]), float(rng.randrange(1, 200)), f'{{"k": {rng.randrange(100)}}}') for i in range(1500)]
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    chunks = [events[i : i + 150] for i in range(0, len(events), 150)]
    folder = tmp_path / "events.parquet"
    for chunk in chunks:
        rng.shuffle(chunk)
    order = [1, 0, 3, 2, 4, 6, 5, 8, 7, 9]  # a file may come before the one that precedes it
    for n, i in enumerate(order):
        spark.createDataFrame(chunks[i], schema).repartition(1).write.mode("append").parquet(str(folder / f"part{n}"))
    late = [(9000 + i, start + dt.timedelta(minutes=i), i, "error", 5.0, '{"k": 1}') for i in range(15)]
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(str(folder / "part99"))
    got = run_incidents(spark, str(folder / "part*"), schema, files_at_once=1, delay="2 days").drop("slow_before", "severity")
    spark.createDataFrame(events, schema).write.parquet(str(tmp_path / "plain" / "events.parquet"))
    batch = monitoring.incident_rows(spark, str(tmp_path / "plain")).where("status = 'RESOLVED'")
    last = max(e[1] for e in events) - dt.timedelta(days=2)
    final = dt.datetime(last.year, last.month, last.day)
    wanted = {(r.environment, r.service, r.incident_id, r.failures, int((r.recovered - r.started).total_seconds() + 0.5)) for r in batch.collect() if r.recovered < final}
    assert {(r.environment, r.service, r.incident_id, r.failures, r.duration_s) for r in got.collect()} == wanted and len(wanted) > 50
    assert check_stream(spark, str(folder / "part*"), schema).isStreaming


def test_incidents_of_checks_within_a_millisecond(spark, tmp_path):
    """Checks of one millisecond come in the order of their microseconds, and times go to the nearest millisecond."""
    start = dt.datetime(2024, 3, 1)
    at = [(900, "click"), (1_000_400, "error"), (1_000_100, "error"), (1_000_300, "click"), (1_000_200, "error"), (2_000_300, "error"), (4_500_000, "click"), (3 * 86_400_000_000, "click")]
    events = [(i, start + dt.timedelta(microseconds=us), 0, kind, 5.0, '{"k": 1}') for i, (us, kind) in enumerate(at)]
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    spark.createDataFrame(events, schema).repartition(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("st_incident_lifecycle", "s4_incident_durations"):
        same_rows(registry.queries()[name](spark, str(tmp_path)), con, registry.oracle_sql()[name])
    assert sorted((r.incident_id, r.failures, r.duration_s) for r in registry.queries()["st_incident_lifecycle"](spark, str(tmp_path)).collect()) == [("INC-1", 2, 4), ("INC-2", 2, 0)]
