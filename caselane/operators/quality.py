"""Audit of a table before it is modelled: shape, nulls, duplicates, lengths, frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caselane.functions import text as tx
from caselane.functions.scores import share
from caselane.operators.quantiles import exact_quantiles
from caselane.session import written

QUARTILES = (0.25, 0.5, 0.75)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def null_summary(df: DataFrame) -> DataFrame:
    """Nulls per column, all counted in one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column_name", "nulls")


HASH = "_h"


def repeated_hashes(hashed: DataFrame) -> DataFrame:
    """Hashes that several rows share, written down; only hashes are shuffled to find them."""
    counts = hashed.groupBy(HASH).agg(F.count(F.lit(1)).alias("_n"))
    return written(counts.filter("_n > 1").select(HASH), "repeated")


def duplicate_summary(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key, and their percentage.

    Rows are counted by the key's hash first; only keys whose hash repeats are compared as they are.
    """
    hashed = df.select(F.xxhash64(key).alias(HASH), key)
    counts = hashed.groupBy(HASH).agg(F.count(F.lit(1)).alias("_n"))
    single = counts.agg(F.sum("_n").alias("_rows"), F.count_if(F.col("_n") == 1).alias("_keys"))
    several = hashed.join(repeated_hashes(hashed), HASH, "left_semi").distinct().agg(
        F.lit(0).cast("long").alias("_rows"), F.count(F.lit(1)).alias("_keys"))
    total = single.unionByName(several).agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"), F.sum("_keys").alias("_keys"))
    return total.select("n_rows", (F.col("n_rows") - F.col("_keys")).alias("duplicates")).withColumn(
        "pct", share(F.col("duplicates") * 100, F.col("n_rows")))


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the row with the smallest ``order`` per key.

    Rows whose key's hash does not repeat are kept where they are. Of the others an aggregate rather than a window keeps
    the first: every map task reduces a key to one row before the shuffle, so a text that makes up a third of the table
    costs no more than a rare one.
    """
    hashed = df.withColumn(HASH, F.xxhash64(key))
    again = repeated_hashes(hashed)
    rest = [c for c in df.columns if c != key]
    first = (hashed.join(again, HASH, "left_semi").groupBy(HASH, key)
             .agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row")).select(key, "_row.*"))
    return hashed.join(again, HASH, "left_anti").select(*df.columns).unionByName(first.select(*df.columns))


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, interpolated quartiles, maximum."""
    values = written(df.groupBy(F.col(column).alias("_x")).agg(F.count(F.lit(1)).alias("_n")), "values")
    q = exact_quantiles(values, [], "_x", QUARTILES, "_n", True).select(F.lit(1).alias("_one"), "quantiles")
    base = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
                  F.min(column).alias("min"), F.max(column).alias("max"), F.lit(1).alias("_one"))
    at = [F.get("quantiles", F.lit(k)).alias(name) for k, name in enumerate(("q25", "q50", "q75"))]
    return base.join(q, "_one", "left").select("n", "mean", "std", "min", *at, "max")


def describe_lengths(df: DataFrame, text: str) -> DataFrame:
    return describe(df.select(tx.char_len(F.col(text)).alias("_len")), "_len")


def longest(df: DataFrame, text: str, row_id: str, k: int) -> DataFrame:
    sized = df.withColumn("n_chars", tx.char_len(F.col(text)))
    return sized.orderBy(F.desc("n_chars"), row_id).limit(k)


def shortest(df: DataFrame, text: str, row_id: str, k: int) -> DataFrame:
    sized = df.withColumn("n_chars", tx.char_len(F.col(text)))
    return sized.orderBy("n_chars", row_id).limit(k)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def value_share(df: DataFrame, column: str) -> DataFrame:
    """Frequencies with their share of all rows; the total is a scalar subquery, not a join."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", share(F.col("n"), total)).orderBy(F.desc("n"), column)


def preview(df: DataFrame, columns: list[str], row_id: str, n: int) -> DataFrame:
    return df.select(*columns).orderBy(row_id).limit(n)


def cross_split_leakage(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Texts present in both splits, and the test rows they account for.

    Only texts whose hash is in both splits are compared. They are counted per text, so one text repeated across much of
    the data is one row for each map task.
    """
    sides = train.select(key, F.lit(0).alias("_test")).unionByName(test.select(key, F.lit(1).alias("_test")))
    hashed = sides.withColumn(HASH, F.xxhash64(key))
    counts = [F.sum("_test").alias("_in_test"), F.sum(1 - F.col("_test")).alias("_in_train")]
    both = (F.col("_in_test") > 0) & (F.col("_in_train") > 0)
    shared = written(hashed.groupBy(HASH).agg(*counts).filter(both).select(HASH), "shared")
    per_key = hashed.join(shared, HASH, "left_semi").groupBy(HASH, key).agg(*counts)
    leaked = per_key.agg(F.lit(0).cast("long").alias("_rows"), F.count_if(both).alias("leaked_texts"),
                         F.sum(F.when(both, F.col("_in_test"))).alias("leaked_rows"))
    rows = test.agg(F.count(F.lit(1)).alias("_rows"), F.lit(0).cast("long").alias("leaked_texts"), F.lit(0).cast("long").alias("leaked_rows"))
    return rows.unionByName(leaked).agg(
        F.sum("_rows").alias("test_rows"), F.sum("leaked_texts").alias("leaked_texts"),
        F.coalesce(F.sum("leaked_rows"), F.lit(0)).alias("leaked_rows"),
    ).withColumn("leaked_pct", share(F.col("leaked_rows") * 100, F.col("test_rows")))
