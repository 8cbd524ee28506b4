"""Live triage: score, deduplicate, window, sessionise and audit messages as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caselane.session import scratch_path
from caselane.sources.review_store import ReviewStore

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def message_stream(spark: SparkSession, path: str, schema: T.StructType,
                   files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, one file or a folder of part files, as a stream.

    A file source takes a single file only by a glob, so the path is written as one that matches itself alone.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_table(stream: DataFrame, name: str, folder: str | None = None,
                 settings: dict[str, str] | None = None) -> DataFrame:
    """Process everything available into a Parquet table in the shared folder, and read it back.

    The file sink commits each batch once, so a restarted run neither loses nor repeats rows. ``settings`` hold for this
    query alone.
    """
    spark = stream.sparkSession
    base = folder or scratch_path(spark, name)
    writer = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{base}/data").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True)
    )
    before = {k: spark.conf.get(k) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        query = writer.start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def run_batches(stream: DataFrame, step: Callable[[DataFrame], DataFrame], name: str,
                folder: str | None = None) -> DataFrame:
    """Apply ``step`` to every batch and return all results.

    What ``step`` reads besides the batch is read anew for each one, so a running stream sees tables as they are by then.
    A batch overwrites its own sub-folder, so one replayed after a failure leaves no second copy.
    """
    spark = stream.sparkSession
    base = folder or scratch_path(spark, name)
    shape = step(spark.createDataFrame([], stream.schema)).schema

    def put(batch: DataFrame, batch_id: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{base}/results/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(shape).parquet(f"{base}/results").select(*shape.names)


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any row-wise scorer (a fitted model's ``score``, a rule) works on a stream as it is."""
    return scorer(stream)


def dedup_stream(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Drop messages delivered again within ``delay``; the state forgets older ones."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_rate(stream: DataFrame, at: str, delay: str, size: str, target: Column,
                  slide: str | None = None) -> DataFrame:
    """Messages and escalations per window; a window is final once the watermark passes its end."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return (
        stream.withWatermark(at, delay).groupBy(window.alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(target.cast("long")).alias("escalated"))
        .select(F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"), "n", "escalated")
    )


def sessions(stream: DataFrame, user: str, at: str, delay: str, gap: str) -> DataFrame:
    """Conversations per user, closed by a silence of ``gap``."""
    return (
        stream.withWatermark(at, delay).groupBy(user, F.session_window(at, gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(user, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")
    )


def audit_upserts(stream: DataFrame, name: str, folder: str | None = None, version: str = "version",
                  key: str = "thread_id", buckets: int = 64, log_batches: int = 16) -> DataFrame:
    """Add review events batch by batch to a keyed store and return the newest review per thread.

    A batch is added to the store's log under its number, so one replayed after a failure leaves no second copy; every
    ``log_batches`` batches the log is folded into the buckets that it touches.
    """
    store = ReviewStore(stream.sparkSession, f"{folder or scratch_path(stream.sparkSession, name)}", stream.schema, key, version, buckets)

    def add(batch: DataFrame, batch_id: int) -> None:
        store.append(batch, batch_id)
        if batch_id % log_batches == log_batches - 1:
            store.compact()

    query = (
        stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{store.path}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return store.read()


def mark_audited(messages: DataFrame, audited: DataFrame, key: str) -> DataFrame:
    """Flag each message whose thread has been reviewed (``audited`` is unique on ``key``).

    For a stream, run it in :func:`run_batches` with a table that is opened there, so that later reviews count.
    """
    side = audited.select(key, F.lit(1).alias("_seen"))
    return messages.join(side, key, "left").withColumn("audited", F.coalesce("_seen", F.lit(0))).drop("_seen")


class FirstMessage(StatefulProcessor):
    """Emit a thread's earliest message once the watermark tells that no earlier one can come.

    State per thread is the earliest message so far and the time of the latest. Which message is emitted does not depend on how
    the rows are cut into batches. A thread that has been silent for ``idle_ms`` behind the watermark is forgotten; what comes
    later opens it anew.
    """

    def __init__(self, key: str, message: str, kind: T.DataType, idle_ms: int):
        self.key, self.message, self.kind, self.idle_ms = key, message, kind, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("thread", T.StructType([
            T.StructField("first_us", T.LongType()), T.StructField("message", self.kind), T.StructField("last_us", T.LongType()),
            T.StructField("told", T.BooleanType()), T.StructField("due", T.LongType())]))

    def keep(self, first: int, message: object, last: int, told: bool) -> None:
        """Wake up when no message before the first can come any more, and later when the thread may be forgotten."""
        due = last // 1000 + self.idle_ms if told else first // 1000 + 1
        self.state.update((first, message, last, told, due))
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last = None, 0
        for chunk in rows:
            low = chunk.sort_values(["at_us", self.message]).iloc[0]
            place = (int(low["at_us"]), low[self.message])
            first = place if first is None or place < first else first
            last = max(last, int(chunk["at_us"].max()))
        if first is not None:
            told = False
            if self.state.exists():
                was_first, message, was_last, told, due = self.state.get()
                self.handle.deleteTimer(due)
                again = told and first[0] // 1000 > was_last // 1000 + self.idle_ms  # forgotten by now, if no timer said so yet
                if told and not again:
                    first, last = (was_first, message), max(last, was_last)
                elif not told:
                    first, last = min(first, (was_first, message)), max(last, was_last)
                told = told and not again
            self.keep(*first, last, told)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, message, last, told, _ = self.state.get()
        if told:
            self.state.clear()
            return
        self.keep(first, message, last, True)
        yield pd.DataFrame({self.key: [key[0]], self.message: [message], "first_us": [first]})

    def close(self) -> None:
        pass


def first_messages(stream: DataFrame, key: str, message: str, at: str, delay: str, idle_ms: int, name: str,
                   folder: str | None = None) -> DataFrame:
    """Opening message per thread, once the watermark has passed it; ``key`` and ``message`` are ids of whole numbers or strings.

    The operator needs another state store than the default. A query copies the session's settings as it starts, so the
    setting is changed for that moment only and no other stream gets it.
    """
    spark = stream.sparkSession
    types = {c: stream.schema[c].dataType.simpleString() for c in (key, message)}
    rows = stream.withWatermark(at, delay).select(key, message, at, F.unix_micros(at).alias("at_us"))
    out = rows.groupBy(key).transformWithStateInPandas(
        FirstMessage(key, message, stream.schema[message].dataType, idle_ms), f"{key} {types[key]}, {message} {types[message]}, first_us long",
        "append", "eventTime")
    return run_to_table(out, name, folder, {PROVIDER: ROCKSDB})
