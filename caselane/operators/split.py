"""Reproducible splits: the same rows on any partitioning, in proportion to each class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from caselane.operators.ordered import hash_order, take_by_hash
from caselane.session import written


def class_quotas(df: DataFrame, label: str, fraction: float) -> DataFrame:
    """How many rows each class gives to a part of ``ceil(fraction * n)`` rows.

    Each class gives the whole part of its proportion; the rows still missing go to the largest remainders,
    ties to the smaller label. The table has one row per class.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    everyone = Window.partitionBy()
    sized = counts.withColumn("_all", F.sum("_n").over(everyone)).withColumn(
        "_part", F.ceil(F.round(F.lit(float(fraction)) * F.col("_all"), 9)).cast("long")
    )
    shared = sized.withColumns({
        "_whole": F.expr("_part * _n DIV _all"),
        "_left": F.expr("_part * _n % _all"),
    })
    missing = F.col("_part") - F.sum("_whole").over(everyone)
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("_left"), label))
    return shared.select(label, (F.col("_whole") + (place <= missing).cast("int")).alias("quota"))


def stratified_split(df: DataFrame, label: str, row_id: str, test: float = 0.2, seed: int | str = 42,
                     names: tuple[str, str] = ("train", "test"), column: str = "split") -> DataFrame:
    marked = take_by_hash(df, [label], row_id, seed, class_quotas(df, label, test), "_taken")
    return marked.withColumn(column, F.when(F.col("_taken") == 1, names[1]).otherwise(names[0])).drop("_taken")


def ids_and_labels(df: DataFrame, label: str, row_id: str) -> DataFrame:
    """What a split is decided on, written down, so that the input is evaluated once."""
    return written(df.select(row_id, label), "split-rows")


def with_decision(df: DataFrame, decided: DataFrame, label: str, row_id: str) -> DataFrame:
    """The decided rows with the other columns of ``df``, where it has any."""
    return decided if set(df.columns) == {row_id, label} else df.join(decided.drop(label), row_id)


def three_way_split(df: DataFrame, label: str, row_id: str, test: float = 0.2, val: float = 0.1,
                    seed: int | str = 42) -> DataFrame:
    """Train, validation and test; validation is carved out of the training part only."""
    first = stratified_split(ids_and_labels(df, label, row_id), label, row_id, test, seed)
    training = written(first.filter("split = 'train'").drop("split"), "training")
    held_out = first.filter("split = 'test'")
    inner = stratified_split(training, label, row_id, val, f"{seed}-val", ("train", "val"))
    return with_decision(df, inner.unionByName(held_out), label, row_id)


def split_rates(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("positive_rate"))


def split_parity(expected: DataFrame, actual: DataFrame, row_id: str) -> DataFrame:
    """Whether two splits hold the same rows: ids in only one of them, and a checksum free of order."""
    sides = expected.select(row_id, F.lit(1).alias("_e")).unionByName(actual.select(row_id, F.lit(0).alias("_e")))
    per_id = sides.groupBy(row_id).agg(F.sum("_e").alias("_e"), F.sum(1 - F.col("_e")).alias("_a"))
    mix = F.pmod(F.xxhash64(row_id), F.lit(1_000_000_007))
    return per_id.agg(
        F.coalesce(F.sum("_e"), F.lit(0)).alias("expected_rows"),
        F.coalesce(F.sum("_a"), F.lit(0)).alias("actual_rows"),
        F.count_if((F.col("_e") > 0) & (F.col("_a") == 0)).alias("only_expected"),
        F.count_if((F.col("_a") > 0) & (F.col("_e") == 0)).alias("only_actual"),
        F.coalesce(F.sum(mix * (F.col("_e") - F.col("_a"))) == 0, F.lit(True)).cast("int").alias("same_checksum"),
    ).withColumn(
        "parity", ((F.col("only_expected") + F.col("only_actual") == 0)
                   & (F.col("expected_rows") == F.col("actual_rows"))).cast("int"),
    )


def metric_parity(recorded: DataFrame, recomputed: DataFrame, keys: list[str], metric: str,
                  tolerance: float = 5e-4) -> DataFrame:
    """Whether a metric recomputed on a rebuilt split equals the recorded one."""
    pair = recorded.select(*keys, F.col(metric).alias("recorded")).join(
        recomputed.select(*keys, F.col(metric).alias("recomputed")), keys, "full")
    close = F.coalesce(F.abs(F.col("recorded") - F.col("recomputed")) < tolerance, F.lit(False))
    return pair.withColumn("parity", close.cast("int"))


def nested_train_sizes(df: DataFrame, label: str, row_id: str, fractions: dict[str, float],
                       seed: int | str = 42) -> DataFrame:
    """Nested stratified subsets for a learning curve; each size holds all smaller ones.

    All sizes read the same hash order, so a larger quota only extends a smaller one. A row is marked for each size that
    it belongs to and repeated for those only.
    """
    rows = ids_and_labels(df, label, row_id)
    marked = rows
    for k, fraction in enumerate(fractions.values()):
        marked = take_by_hash(marked, [label], row_id, seed, class_quotas(rows, label, fraction), f"_t{k}")
    sizes = F.array_compact(F.array(*[F.when(F.col(f"_t{k}") == 1, F.lit(n)) for k, n in enumerate(fractions)]))
    decided = marked.select(row_id, label, F.explode(sizes).alias("size_name"))
    return with_decision(df, decided, label, row_id)


def kfold(df: DataFrame, row_id: str, k: int, seed: int | str = 42) -> DataFrame:
    """Fold number from the id's hash: no shuffle, usable as ``foldCol``."""
    prefix = F.conv(F.substring(hash_order(seed, row_id), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", F.pmod(prefix, F.lit(k)).cast("int"))


def sample_manifest(df: DataFrame, row_id: str, n: int, seed: int | str = 42) -> DataFrame:
    """A uniform sample of exactly ``n`` ids: the first in hash order, kept as a top-k by every task."""
    return df.withColumn("_hash", hash_order(seed, row_id)).orderBy("_hash", row_id).limit(n).drop("_hash")
