"""Contiguous shards of near-equal bytes from global prefix sums.

Rows (id and size only) are range-partitioned by id; the totals of the partitions give each partition its offset, so the
global prefix sum is exact and no task sees more than its own partition. A row goes to the shard whose equal share of the
bytes holds the row's first byte.

Defined cases: a null text has no bytes, so the row has size 1; null ids come first; an empty table gives an empty
result. Repeated rows are separate rows with slots of their own. Equal texts are not kept together: shards are
contiguous in id order, so that a group of copies larger than a shard does no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caselane.operators.ordered import running_sums
from caselane.session import durable

SHARDS = 8


def shard(docs: DataFrame, shards: int = SHARDS, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (the place within the shard, gapless from 0) of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(row_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                         F.crc32(body.cast("binary")).alias("text_crc32"))
    summed = durable(running_sums(narrow, [], ["doc_id", "text_crc32", "size"],
                                  {"upto": F.col("size"), "place": F.lit(1)}, {"upto": "total"}))
    begins = F.col("upto") - F.col("size")
    share = F.expr(f"CAST(floor((upto - size) / (total / {float(shards)!r})) AS INT)")
    placed = summed.withColumn("shard", F.when(begins >= F.col("total"), shards - 1)
                               .otherwise(F.least(share, F.lit(shards - 1))))
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))


def report(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                              F.lit(None).cast("int").alias("grown_shard"))
