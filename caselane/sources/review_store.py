"""A table of reviews by thread that takes batches without being rewritten.

Threads are dealt to a fixed number of buckets by hash, each a partition folder of one Parquet table. A batch of reviews reads the
buckets it touches and overwrites these alone; all other files stay as they are. A review replaces an earlier one of its thread
if its version is larger, so a batch that is applied again, after a failure or out of order, changes nothing.

Many small batches would rewrite a bucket for every few reviews. They may be added as a log instead (``append``), one folder a
batch and bucketed alike; readers see them at once, and ``compact`` folds the log into its buckets when it has grown.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from caselane.operators.audit import latest
from caselane.session import written

BUCKET = "_bucket"
BATCH = "_batch"


@dataclass(frozen=True)
class ReviewStore:
    """``path`` lies in storage that all executors share; ``schema`` has the key, the version and whatever a review holds.

    The number of buckets is that of the first write and cannot change later.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str = "thread_id"
    version: str = "version"
    buckets: int = 64

    @property
    def table(self) -> str:
        return f"{self.path}/table"

    @property
    def log(self) -> str:
        return f"{self.path}/log"

    def bucket(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.buckets)).cast("int")

    def newest(self, rows: DataFrame) -> DataFrame:
        """One row per thread, with its bucket."""
        found = latest(rows.select(*self.schema.names).withColumnRenamed(self.key, "thread_id"), self.version)
        return found.withColumnRenamed("thread_id", self.key).select(*self.schema.names).withColumn(BUCKET, self.bucket())

    def exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def stored(self, path: str) -> DataFrame:
        """The rows in the files of the table or the log, whatever their order."""
        extra = [T.StructField(BATCH, T.LongType())] if path == self.log else []
        shape = T.StructType([*self.schema.fields, *extra, T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(shape).parquet(path) if self.exists(path) else self.spark.createDataFrame([], shape)

    def put(self, rows: DataFrame) -> None:
        """Overwrite the buckets of ``rows``, which hold all that these buckets shall hold; one file each."""
        (rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BUCKET).parquet(self.table))

    def touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # at most the number of buckets

    def upsert(self, batch: DataFrame) -> list[int]:
        """Apply a batch and name the buckets that were rewritten."""
        new = written(self.newest(batch), "reviews")
        found = self.touched(new)
        if found:
            here = self.stored(self.table).filter(F.col(BUCKET).isin(found))
            merged = self.newest(here.select(*self.schema.names).unionByName(new.select(*self.schema.names)))
            self.put(written(merged, "merged"))  # no file is overwritten while it is read
        return found

    def append(self, batch: DataFrame, number: int) -> None:
        """Add a batch to the log. A batch that comes again under its number replaces itself."""
        (self.newest(batch).withColumn(BATCH, F.lit(number).cast("long")).repartition(BUCKET).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(BATCH, BUCKET).parquet(self.log))

    def compact(self, least: int = 1) -> list[int]:
        """Fold the log into the buckets that have at least so many batches in it, and name these.

        The log's folders go only when their reviews are in the table; going through them twice does no harm.
        """
        entries = self.stored(self.log)
        busy = entries.groupBy(BUCKET).agg(F.count_distinct(BATCH).alias("n")).filter(F.col("n") >= least)
        found = self.touched(busy)
        if not found:
            return []
        taken = written(entries.filter(F.col(BUCKET).isin(found)), "log")
        self.upsert(taken)
        for row in taken.select(BATCH, BUCKET).distinct().toLocalIterator():
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.log}/{BATCH}={row[0]}/{BUCKET}={row[1]}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return found

    def read(self) -> DataFrame:
        """The newest review of every thread."""
        return self.merged(lambda rows: rows)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The reviews of some threads (a column named as the key): only their buckets are read."""
        wanted = keys.select(self.key).distinct()
        found = self.touched(wanted.withColumn(BUCKET, self.bucket()))
        return self.merged(lambda rows: rows.filter(F.col(BUCKET).isin(found))).join(wanted, self.key, "left_semi")

    def merged(self, part) -> DataFrame:
        base, log = part(self.stored(self.table)), part(self.stored(self.log))
        if not self.exists(self.log):
            return base.select(*self.schema.names)  # a bucket holds one row per thread
        return self.newest(base.select(*self.schema.names).unionByName(log.select(*self.schema.names))).select(*self.schema.names)
