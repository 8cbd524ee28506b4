import os

import pytest
from pyspark.sql import types as T

from caselane.operators import audit
from caselane.sources.review_store import BUCKET, ReviewStore
from caselane.streaming import live

SCHEMA = T.StructType([T.StructField("thread_id", T.LongType()), T.StructField("verdict", T.StringType()), T.StructField("version", T.LongType())])


@pytest.fixture()
def store(spark, tmp_path):
    return ReviewStore(spark, str(tmp_path / "store"), SCHEMA, buckets=16)


def rows(spark, items):
    return spark.createDataFrame(items, SCHEMA)


def files(store):
    out = {}
    for folder, _, names in os.walk(store.table):
        for name in names:
            if name.endswith(".parquet"):
                out.setdefault(os.path.basename(folder), set()).add((name, os.stat(f"{folder}/{name}").st_mtime_ns))
    return out


def held(store):
    return {r.thread_id: (r.verdict, r.version) for r in store.read().collect()}


def test_a_batch_rewrites_its_buckets_alone(spark, store):
    store.upsert(rows(spark, [(k, "a", 1) for k in range(300)]))
    before = files(store)
    assert len(before) == 16 and all(len(f) == 1 for f in before.values())
    touched = store.upsert(rows(spark, [(5, "b", 2), (6, "late", 0), (1000, "new", 1), (5, "older", 1)]))
    after = files(store)
    changed = {b for b in after if after[b] != before.get(b)}
    assert changed == {f"{BUCKET}={b}" for b in touched} and 1 <= len(touched) <= 3
    want = {k: ("a", 1) for k in range(300)} | {5: ("b", 2), 1000: ("new", 1)}
    assert held(store) == want


def test_replay_changes_nothing(spark, store):
    first, second = rows(spark, [(1, "a", 1), (2, "a", 1)]), rows(spark, [(1, "b", 3)])
    for batch in (first, second, first, second):
        store.upsert(batch)
    assert held(store) == {1: ("b", 3), 2: ("a", 1)}


def test_empty_store_and_batch(spark, store):
    assert store.read().collect() == [] and store.upsert(rows(spark, [])) == [] and store.compact() == []
    assert store.lookup(rows(spark, [(1, "", 0)])).collect() == []


def test_log_is_seen_at_once_and_compacted(spark, store):
    store.upsert(rows(spark, [(k, "a", 1) for k in range(100)]))
    store.append(rows(spark, [(3, "b", 2), (4, "b", 2)]), 0)
    store.append(rows(spark, [(3, "c", 3)]), 1)
    store.append(rows(spark, [(3, "c", 3)]), 1)
    want = {k: ("a", 1) for k in range(100)} | {3: ("c", 3), 4: ("b", 2)}
    assert held(store) == want
    before = files(store)
    busy = store.compact(2)
    assert len(busy) == 1 and {b for b, f in files(store).items() if f != before[b]} == {f"{BUCKET}={busy[0]}"} and held(store) == want
    store.append(rows(spark, [(3, "b", 2)]), 0)  # an old batch again
    assert held(store) == want
    store.compact()
    assert held(store) == want and store.stored(store.log).count() == 0


def test_lookup_reads_the_buckets_of_its_keys(spark, store):
    store.upsert(rows(spark, [(k, "a", k) for k in range(500)]))
    store.append(rows(spark, [(7, "z", 999)]), 0)
    found = store.lookup(spark.createDataFrame([(7,), (8,), (9999,)], "thread_id long"))
    assert {(r.thread_id, r.verdict, r.version) for r in found.collect()} == {(7, "z", 999), (8, "a", 8)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert BUCKET in plan.split("PartitionFilters:")[1][:200]


def test_equals_submit(spark, store):
    items = [(k % 37, f"v{k}", k * 7919 % 1000) for k in range(400)]
    for at in range(0, 400, 90):
        store.upsert(rows(spark, items[at:at + 90]))
    want = audit.submit(rows(spark, items[:1]), rows(spark, items))
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, want.select(*SCHEMA.names).collect()))


def test_stream_keeps_the_store(spark, tmp_path):
    for k in range(4):
        rows(spark, [(j % 10, f"b{k}", k * 100 + j) for j in range(20)]).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = live.audit_upserts(stream, "u", str(tmp_path / "out"))
    want = {j: ("b3", 310 + j) for j in range(10)}
    assert {r.thread_id: (r.verdict, r.version) for r in out.collect()} == want
    again = live.audit_upserts(stream, "u", str(tmp_path / "out"))
    assert {r.thread_id: (r.verdict, r.version) for r in again.collect()} == want
