"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "caselane", master: str | None = None, shuffle_partitions: int | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution and skew handling on, and streamed sessions merged before the shuffle.

    Leave ``shuffle_partitions`` unset on a cluster: adaptive execution coalesces from the cluster's own
    default, and a fixed small number would turn into oversized partitions there.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; elsewhere an unset folder is an error,
    because files on one machine are gone with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="caselane-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files, so a lost executor costs no recompute."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for a table or a stream's own checkpoint.

    It is removed when the application ends.
    """
    token = spark._jvm.java.util.UUID.randomUUID().toString()
    made = os.path.join(shared_dir(spark), f"{name}-{token}")
    path = spark._jvm.org.apache.hadoop.fs.Path(made)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return made


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files.

    Unlike a checkpoint the files are columnar and compressed, and their size is known to the planner, which may then
    broadcast a table that has proved small.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
