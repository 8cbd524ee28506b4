"""Order-dependent work that never sorts one group in one task.

A plain window over a key puts each key's rows into one task, which fails once a single key holds a large
part of the table. Here the rows are range-partitioned on *(key, order)*, so a large key spans many
partitions; the partition number is written down with the rows (both passes must agree on it), each
partition works on its own rows, and what crosses a partition border is carried in a table with one row
per (key, partition).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from caselane.session import durable, written

PART = "_part"

# A key is hot when it holds more rows than an average shuffle partition, or than 1/HOT_SHARE of all rows where
# there are fewer partitions than that; so there are fewer hot keys than the larger of the two numbers.
HOT_SHARE = 1000


def hot_share(spark) -> int:
    return max(HOT_SHARE, int(spark.conf.get("spark.sql.shuffle.partitions")))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Write ``df`` down, so that its bytes are known: Spark broadcasts it below its own limit and joins by shuffle above."""
    return written(df, "lookup")


# A scan of fewer splits than this is small enough to be dealt out again before heavy work on its texts.
FEW_SPLITS = 32


def fill_cores(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of a scan of few splits out over all cores; leave a larger scan where it is.

    Taking texts apart is bound by processor time, and a file with one row group is read by one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else df


def lay_out(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows range-partitioned on (by, order) with their partition number, written to the shared folder."""
    keys = [F.col(c) for c in (*by, *order)]
    return durable(df.repartitionByRange(*keys).withColumn(PART, F.spark_partition_id()))


def attach(laid: DataFrame, side: DataFrame, by: list[str]) -> DataFrame:
    """Join a table with one row per (key, partition) back to its rows; a NULL key is a key like any other."""
    keys = [*by, PART]
    renamed = side.withColumnsRenamed({c: f"_k_{c}" for c in keys})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
    return laid.join(renamed, same).drop(*[f"_k_{c}" for c in keys])


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column],
                 totals: dict[str, str] | None = None) -> DataFrame:
    """Add inclusive running totals, per ``by`` in ``order`` (unique within ``by``).

    ``totals`` maps a name of ``sums`` to the column that gets its total over the whole group.
    """
    whole = totals or {}
    laid = lay_out(df, by, order)
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        laid.groupBy(*by, PART)
        .agg(*[F.sum(expr).alias(f"_t_{name}") for name, expr in sums.items()])
        .select(
            *by, PART,
            *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums],
            *[F.sum(f"_t_{name}").over(Window.partitionBy(*by)).alias(column) for name, column in whole.items()],
        )
    )
    local = Window.partitionBy(*by, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = attach(laid, offsets, by)
    return joined.select(
        *df.columns,
        *[(F.sum(expr).over(local) + F.col(f"_o_{name}")).alias(name) for name, expr in sums.items()],
        *whole.values(),
    )


def neighbors(df: DataFrame, by: list[str], order: list[str], values: list[str],
              position: str | None = None) -> DataFrame:
    """Add ``prev_<v>`` and ``next_<v>`` per ``by`` in ``order``, and a 1-based ``position`` if named."""
    laid = lay_out(df, by, order)
    packed = F.struct(*values)
    place = F.struct(*order)
    across = Window.partitionBy(*by).orderBy(PART)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        laid.groupBy(*by, PART)
        .agg(
            F.min_by(packed, place).alias("_first"),
            F.max_by(packed, place).alias("_last"),
            F.count(F.lit(1)).alias("_n"),
        )
        .select(
            *by, PART,
            F.lag("_last").over(across).alias("_before"),
            F.lead("_first").over(across).alias("_after"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        )
    )
    local = Window.partitionBy(*by, PART).orderBy(*order)
    out = (
        attach(laid, edges, by)
        .withColumn("_prev", F.coalesce(F.lag(packed).over(local), F.col("_before")))
        .withColumn("_next", F.coalesce(F.lead(packed).over(local), F.col("_after")))
    )
    extra = [F.col(f"_prev.{v}").alias(f"prev_{v}") for v in values]
    extra += [F.col(f"_next.{v}").alias(f"next_{v}") for v in values]
    if position:
        out = out.withColumn(position, F.row_number().over(local) + F.col("_offset"))
        extra.append(F.col(position))
    return out.select(*df.columns, *extra)


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, rows_count: int | None = None) -> DataFrame:
    """Left join to a table that is unique on ``key``, with the hot keys of ``rows`` taken aside.

    Fewer keys than :func:`hot_share` can be hot, so their lookup rows are a proven-small broadcast and hot rows
    are never shuffled; all other rows take the ordinary join. Rows whose key is NULL match nothing and are
    spread out, instead of all meeting in the task that NULL hashes to. A caller that gives ``rows_count`` has
    written its rows down already.
    """
    if rows_count is None:
        rows = durable(rows)
    total = rows.count() if rows_count is None else rows_count
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(HOT_SHARE))).otherwise(F.lit(0))
    salted = rows.withColumn("_salt", spread)
    target = lookup.withColumn("_salt", F.lit(0).cast("long"))
    hot = durable(
        rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") * hot_share(rows.sparkSession) > F.lit(total))
        .select(key, F.lit(True).alias("_hot"))
    )
    marked = salted.join(F.broadcast(hot), key, "left")
    hot_lookup = lookup.join(F.broadcast(hot.select(key)), key, "left_semi")
    aside = marked.filter("_hot").drop("_hot", "_salt").join(F.broadcast(hot_lookup), key, "left")
    rest = marked.filter("_hot IS NULL").drop("_hot").join(target, [key, "_salt"], "left").drop("_salt")
    return aside.unionByName(rest)


def hash_order(seed: int | str, row_id: str) -> Column:
    """A fixed pseudo-random order of ids, the same on any partitioning and in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")))


def take_by_hash(df: DataFrame, by: list[str], row_id: str, seed: int | str, quotas: DataFrame,
                 flag: str = "taken") -> DataFrame:
    """Mark, per ``by``, the first ``quota`` rows in hash order.

    ``quotas`` has one row per ``by``, with a quota no larger than that group. Counting rows per leading-hex bucket finds the one bucket in which
    each quota is used up; only that bucket is ranked, to find the last hash taken. Every other row is then
    decided by comparing its own hash, without moving.
    """
    hashed = df.withColumn("_hash", hash_order(seed, row_id))
    bucket = F.substring("_hash", 1, 4)
    upto = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    border = (
        hashed.groupBy(*by, bucket.alias("_bucket"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(upto))
        .join(quotas, by)
        .filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
        .select(*by, "_bucket", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    ranked = Window.partitionBy(*by).orderBy("_hash", row_id)
    last = (
        hashed.select(*by, row_id, "_hash", bucket.alias("_bucket"))
        .join(broadcast_if_small(border), [*by, "_bucket"])
        .withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") == F.col("_need"))
        .select(*by, F.struct("_hash", F.col(row_id)).alias("_last"))
    )
    place = F.struct("_hash", F.col(row_id))
    return (
        hashed.join(broadcast_if_small(last), by, "left")
        .withColumn(flag, F.coalesce(place <= F.col("_last"), F.lit(False)).cast("int"))
        .drop("_hash", "_last")
    )
