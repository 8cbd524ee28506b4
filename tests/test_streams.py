import random

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from caselane.operators import classify
from caselane.plans import registry
from caselane.streaming import live


def write_batches(folder, batches):
    """One file per micro-batch, in order of name and time."""
    import os
    import time

    for i, rows in enumerate(batches):
        frame = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type"])
        frame["ts"] = pd.to_datetime(frame["ts"], utc=True).astype("datetime64[us, UTC]")
        path = f"{folder}/{i:03d}.parquet"
        frame.to_parquet(path, index=False)
        os.utime(path, (time.time() - 1000 + i, time.time() - 1000 + i))


BATCHES = [
    [(1, "2024-01-01 00:05", 7, "error"), (2, "2024-01-01 00:50", 8, "view")],
    [(3, "2024-01-01 02:00", 7, "view"), (1, "2024-01-01 00:05", 7, "error")],
    [(5, "2024-01-01 03:30", 9, "purchase")],
    [(4, "2024-01-01 00:10", 7, "error"), (6, "2024-01-01 06:00", 8, "view")],   # event 4 is late
]
registry.load()
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"


@pytest.fixture()
def stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_batches(str(folder), BATCHES)

    def make():
        from pyspark.sql.types import _parse_datatype_string

        return live.message_stream(spark, str(folder), _parse_datatype_string(SCHEMA), files_per_batch=1)

    return make


def test_windows_drop_late_rows(stream):
    out = live.run_to_table(live.windowed_rate(
        stream(), "ts", "10 minutes", "1 hour", F.col("event_type").isin("error", "purchase")), "w")
    got = {r.start_s - 1704067200: (r.n, r.escalated) for r in out.collect()}
    assert got == {0: (2 + 1, 1 + 1), 7200: (1, 0), 10800: (1, 1)}


def test_redelivery_is_dropped_across_batches(stream):
    out = live.run_to_table(live.dedup_stream(stream(), ["event_id"], "ts", "3 hours"), "d")
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3, 4, 5, 6]


def test_upserts_keep_the_newest_and_replay_is_harmless(stream, tmp_path):
    rows = stream().select(F.col("user_id").alias("thread_id"), F.col("event_type").alias("verdict"),
                           F.col("event_id").alias("version"))
    out = live.audit_upserts(rows, "u", str(tmp_path / "out"))
    want = {7: ("error", 4), 8: ("view", 6), 9: ("purchase", 5)}
    assert {r.thread_id: (r.verdict, r.version) for r in out.collect()} == want
    again = live.audit_upserts(rows, "u", str(tmp_path / "out"))
    assert {r.thread_id: (r.verdict, r.version) for r in again.collect()} == want


def test_first_message_once_per_thread(stream):
    out = live.first_messages(stream(), "user_id", "event_id", "ts", "10 minutes", 12 * 3_600_000, "f")
    assert sorted((r.user_id, r.event_id) for r in out.collect()) == [(7, 1), (8, 2), (9, 5)]


def test_a_silent_thread_is_forgotten(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_batches(str(tmp_path / "in"), [*BATCHES, [(9, "2024-01-01 12:00", 1, "view")]])
    stream = live.message_stream(spark, str(tmp_path / "in"), T._parse_datatype_string(SCHEMA), files_per_batch=1)
    out = live.first_messages(stream, "user_id", "event_id", "ts", "10 minutes", 3_600_000, "f")
    assert (8, 6) in {(r.user_id, r.event_id) for r in out.collect()}


def test_first_message_does_not_depend_on_batches(spark, folder, tmp_path):
    """Rows out of order within the delay, in one batch and in twenty: the same messages, the earliest ones."""
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    rows = sorted(((r.ts, r.event_id, r.user_id, r.event_type) for r in events.collect()))
    step = -(-len(rows) // 20)
    hours = 3 * max((rows[min(k + step, len(rows) - 1)][0] - rows[k][0]).total_seconds() for k in range(0, len(rows), step)) / 3600
    rng = random.Random(3)
    for at in range(0, len(rows), 2 * step):
        part = rows[at:at + 2 * step]
        rng.shuffle(part)
        rows[at:at + 2 * step] = part
    results = []
    for n in (1, 20):
        path = tmp_path / str(n)
        path.mkdir()
        size = -(-len(rows) // n)
        write_batches(str(path), [[(e, t, u, k) for t, e, u, k in rows[at:at + size]] for at in range(0, len(rows), size)])
        stream = live.message_stream(spark, str(path), T._parse_datatype_string(SCHEMA), files_per_batch=1)
        out = live.first_messages(stream, "user_id", "event_id", "ts", f"{int(hours) + 1} hours", 366 * 86_400_000, "f")
        results.append(sorted(map(tuple, out.collect())))
    first = {}
    for t, e, u, _ in sorted(rows):
        first.setdefault(u, e)
    assert results[0] == results[1] and len(results[0]) > 10
    assert all(first[u] == e for u, e, _ in results[0])


def test_a_fitted_model_scores_a_stream(spark, tmp_path):
    rows = [(i, "refund my money now" if i % 2 else "track my order please", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, escalated int")
    model = classify.fit(df, "id", "text", "escalated", stop=[], size=50)
    df.select("id", "text").write.parquet(str(tmp_path / "in"))
    stream = live.message_stream(spark, str(tmp_path / "in"), df.select("id", "text").schema)
    out = live.run_to_table(live.score_stream(stream, lambda s: classify.score(model, s)), "s")
    batch = classify.score(model, df.select("id", "text"))
    assert sorted(out.collect()) == sorted(batch.collect())
    assert out.filter("y_pred <> id % 2").count() == 0


STREAMS = ("stream_score", "stream_dedup", "stream_tumbling", "stream_sliding", "stream_sessions", "stream_audit_upsert",
           "stream_static_join", "stream_first_message", "stream_score_fitted")


@pytest.fixture(scope="module")
def part_files(spark, folder, tmp_path_factory):
    """The same tables with the events as a folder of four part files."""
    base = tmp_path_factory.mktemp("tables")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{base}/labels.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.read.parquet(f"{folder}/events.parquet").repartitionByRange(4, "event_id").write.parquet(f"{base}/events.parquet")
    return str(base)


@pytest.mark.parametrize("name", STREAMS)
def test_streams_over_part_files(spark, folder, part_files, name):
    run = registry.runner(registry.BUILDS[name])
    want = sorted(map(tuple, run(spark, folder).collect()))
    assert want and sorted(map(tuple, run(spark, part_files).collect())) == want


def test_later_reviews_count(spark, tmp_path):
    reviews = str(tmp_path / "reviews")
    (tmp_path / "in").mkdir()
    write_batches(str(tmp_path / "in"), BATCHES[:2])
    spark.createDataFrame([(7,)], "user_id long").write.parquet(reviews)
    seen = []

    def mark(batch):
        out = live.mark_audited(batch.select("event_id", "user_id"), spark.read.parquet(reviews).distinct(), "user_id")
        if not seen:
            seen.append(out.schema)
            spark.createDataFrame([(8,)], "user_id long").write.mode("append").parquet(reviews)
        return out

    stream = live.message_stream(spark, str(tmp_path / "in"), T._parse_datatype_string(SCHEMA))
    out = live.run_batches(stream, mark, "marked")
    assert {r.user_id: r.audited for r in out.collect()} == {7: 1, 8: 1}


def test_no_other_stream_gets_the_state_store(spark, stream):
    before = spark.conf.get(live.PROVIDER)
    live.first_messages(stream(), "user_id", "event_id", "ts", "10 minutes", 3_600_000, "f")
    assert spark.conf.get(live.PROVIDER) == before
