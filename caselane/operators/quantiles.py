"""Exact quantiles of groups of any size by distributed selection.

A quantile is one value, or lies between two, of known rank. The range of a group's values is cut into buckets, the rows of
each are counted in the map tasks, and the ranks tell which buckets hold the values sought. Only these are cut again, between
their own least and largest value, until a bucket holds one value. No task holds more than the counts of one
cut, whatever the number of distinct values; a group's range shrinks by the number of buckets each round.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from caselane.session import written

BUCKETS = 1 << 16  # that a range is cut into
EVERYTHING = "_all"  # the group of all rows


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """``right`` with its keys renamed, and the condition that they equal those of ``left``; NULL is a key like any other."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return renamed, reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed, condition = same(left, right, keys)
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def exact_quantiles(rows: DataFrame, by: Sequence[str], column: str, shares: Sequence[float], weight: str | None = None,
                    stored: bool = False) -> DataFrame:
    """``by`` and ``quantiles``, an array with the interpolated value at each share, per group that has a value.

    ``weight`` names a column that tells how often a row counts; ``stored`` rows are a written table already. NULL values do not count; infinite values and NaN do, in this
    order, as the largest.
    """
    keys = [*by, EVERYTHING]
    x = F.col(column).cast("double")
    counted = rows.select(*by, F.lit(0).alias(EVERYTHING), x.alias("_x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    known = counted.filter("_x IS NOT NULL")
    data = known if stored else written(known, "values")
    plain = ~F.isnan("_x") & (F.abs("_x") < float("inf"))
    ends = {"_below": F.col("_x") == float("-inf"), "_plain": plain, "_above": F.col("_x") == float("inf")}
    span = data.groupBy(*keys).agg(
        F.sum("_w").alias("_n"), F.min(F.when(plain, F.col("_x"))).alias("_lo"), F.max(F.when(plain, F.col("_x"))).alias("_hi"),
        *[F.sum(F.when(test, F.col("_w")).otherwise(0)).alias(name) for name, test in ends.items()])
    at = [F.col("_n").cast("double").__sub__(1) * float(p) for p in shares]
    ranks = F.array_distinct(F.array(*[f(a).cast("long") for a in at for f in (F.floor, F.ceil)]))
    span = written(span, "spans")
    sought = span.select(*keys, F.explode(ranks).alias("rank"), "_lo", "_hi", "_below", "_plain", "_above")
    inner = F.col("rank") - F.col("_below")
    beyond = F.when(inner < 0, F.lit(float("-inf"))).when(inner >= F.col("_plain") + F.col("_above"), F.lit(float("nan"))).when(
        inner >= F.col("_plain"), F.lit(float("inf")))
    targets = written(sought.select(
        *keys, "rank", F.coalesce(beyond, "_lo").alias("lo"), F.coalesce(beyond, "_hi").alias("hi"), F.col("_below").alias("before")), "targets")
    found = [targets.filter("lo <=> hi")]
    while not (open_ := targets.filter("NOT lo <=> hi")).isEmpty():
        targets = written(narrowed(data, open_, keys), "targets")
        found.append(targets.filter("lo <=> hi"))
    values = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("_v"))
    both = join_groups(span.select(*keys, "_n"), values, keys)

    def interpolated(a: Column) -> Column:
        low, high = F.floor(a).cast("long"), F.ceil(a).cast("long")
        value = lambda k: F.element_at("_v", k)
        return F.when(low == high, value(low)).otherwise((high - a) * value(low) + (a - low) * value(high))

    return both.select(*by, F.array(*[interpolated(a) for a in at]).alias("quantiles"))


def narrowed(data: DataFrame, open_: DataFrame, keys: list[str]) -> DataFrame:
    """Each open target with the range of the bucket that holds its rank, and what lies before that."""
    ranges = open_.select(*keys, "lo", "hi").distinct()
    renamed, condition = same(data, ranges, keys)
    inside = data.join(renamed, condition & (F.col("_x") >= F.col("lo")) & (F.col("_x") <= F.col("hi"))).drop(*[f"_r_{k}" for k in keys])
    share = (F.col("_x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves do not overflow
    bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    cells = inside.groupBy(*keys, "lo", "hi", bucket.alias("bucket")).agg(
        F.sum("_w").alias("n"), F.min("_x").alias("least"), F.max("_x").alias("largest"))
    upto = Window.partitionBy(*keys, "lo", "hi").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # BUCKETS rows
    placed = cells.withColumn("upto", F.sum("n").over(upto))
    met = join_groups(open_, placed, [*keys, "lo", "hi"]).filter(
        (F.col("rank") >= F.col("before") + F.col("upto") - F.col("n")) & (F.col("rank") < F.col("before") + F.col("upto")))
    return met.select(*keys, "rank", F.col("least").alias("lo"), F.col("largest").alias("hi"), (F.col("before") + F.col("upto") - F.col("n")).alias("before"))
