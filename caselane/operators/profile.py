"""Aggregates and reshapes behind the exploratory tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caselane.functions.scores import share
from caselane.operators.ordered import broadcast_if_small
from caselane.operators.quality import value_share
from caselane.operators.quantiles import exact_quantiles, join_groups
from caselane.session import durable, written


def category_by_class(df: DataFrame, category: str = "category", target: str = "escalated") -> DataFrame:
    """Group sizes with one column per class, largest category first."""
    return df.groupBy(category).agg(
        F.count_if(F.col(target) == 0).alias("class_0"),
        F.count_if(F.col(target) == 1).alias("class_1"),
        F.count(F.lit(1)).alias("total"),
    ).orderBy(F.desc("total"), category)


def class_category_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("escalated", "category").agg(F.count(F.lit(1)).alias("threads"))


def class_balance(df: DataFrame, target: str = "escalated") -> DataFrame:
    return value_share(df, target).withColumn("share", F.col("share") * 100).withColumnRenamed("share", "pct")


def base_rate(df: DataFrame, target: str = "escalated") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("base_rate"))


def flag_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("flag_")]


def flag_density(df: DataFrame, by: str = "category") -> DataFrame:
    """Mean percentage of each flag per group."""
    return df.groupBy(by).agg(*[(F.avg(c) * 100).alias(c) for c in flag_columns(df)])


def flag_prevalence(df: DataFrame, target: str = "escalated") -> DataFrame:
    """The same per class, one row per flag and class."""
    return melt(flag_density(df, target), [target], "flag", "pct")


def melt(df: DataFrame, ids: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, [c for c in df.columns if c not in ids], name, value)


def conditional_rate(df: DataFrame, condition: Column, target: str = "escalated") -> DataFrame:
    """Rate of the target with and without a condition, and the difference."""
    on = F.coalesce(condition, F.lit(False))
    out = df.agg(
        F.count_if(on).alias("n_with"),
        F.avg(on.cast("double")).alias("share_with"),
        F.avg(F.when(on, F.col(target))).alias("rate_with"),
        F.avg(F.when(~on, F.col(target))).alias("rate_without"),
    )
    return out.withColumn("lift", F.col("rate_with") - F.col("rate_without"))


def effect_size(df: DataFrame, column: str, target: str = "escalated") -> DataFrame:
    """Difference of class means, and the same in pooled standard deviations."""
    per = {k: F.when(F.col(target) == k, F.col(column)) for k in (0, 1)}
    m = df.agg(
        *[F.count(per[k]).alias(f"n_{k}") for k in per],
        *[F.avg(per[k]).alias(f"mean_{k}") for k in per],
        *[F.var_samp(per[k]).alias(f"_v{k}") for k in per],
    )
    n0, n1 = F.col("n_0"), F.col("n_1")
    pooled = F.sqrt(share((n0 - 1) * F.col("_v0") + (n1 - 1) * F.col("_v1"), n0 + n1 - 2))
    diff = F.col("mean_1") - F.col("mean_0")
    return m.select("n_0", "n_1", "mean_0", "mean_1", diff.alias("mean_diff"), share(diff, pooled).alias("cohens_d"))


def histogram(df: DataFrame, column: str, by: str, bins: int | None = None, width: float | None = None,
              common_range: bool = True) -> DataFrame:
    """Equal-width bins with the density of each group normalised on its own.

    Give ``bins`` or ``width``. With ``common_range`` all groups share their edges; otherwise each group spans
    its own minimum to maximum.
    """
    data = df.select(F.col(by), F.col(column).cast("double").alias("_x")).filter("_x IS NOT NULL")
    if common_range:
        edges = data.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        ranged = data.withColumns({
            "_lo": edges.select("lo").scalar(), "_hi": edges.select("hi").scalar(),
        })
    else:
        span = data.groupBy(by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        ranged = data.join(broadcast_if_small(span), by)
    flat = F.col("_lo") == F.col("_hi")
    ranged = ranged.withColumns({
        "_lo": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")),
        "_hi": F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")),
    })
    if width is not None:
        n_bins = F.greatest(F.ceil((F.col("_hi") - F.col("_lo")) / F.lit(float(width))), F.lit(1))
        step = F.lit(float(width))
        at = F.floor((F.col("_x") - F.col("_lo")) / step)
    else:
        n_bins = F.lit(bins)
        step = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
        at = F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(bins)))
    binned = (
        ranged.groupBy(by, F.least(at, n_bins - 1).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.col("_lo")).alias("_lo"), F.min(step).alias("_w"))
    )
    total = F.sum("n").over(Window.partitionBy(by))
    return binned.select(
        by, "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left"),
        "n",
        (F.col("n") / (total * F.col("_w"))).alias("density"),
    )


def box_stats(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Quartiles, whisker ends within 1.5 IQR and the rows beyond them.

    Rows are first counted per (group, value); the second pass reads that small table, not the rows.
    """
    counted = durable(df.groupBy(*by, F.col(column).alias("_x")).agg(F.count(F.lit(1)).alias("_n")))
    quartiles = exact_quantiles(counted, by, "_x", (0.25, 0.5, 0.75), "_n", True).select(
        *by, *[F.get("quantiles", F.lit(k)).alias(name) for k, name in enumerate(("q1", "median", "q3"))])
    boxes = written(join_groups(counted.groupBy(*by).agg(F.sum("_n").alias("n")), quartiles, by, "left"), "boxes")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("_x") >= F.col("q1") - reach) & (F.col("_x") <= F.col("q3") + reach)
    return join_groups(counted, boxes, by).groupBy(*by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("outliers"),
    )


def slot_count_by_class(df: DataFrame, count: str = "slot_count", target: str = "escalated") -> DataFrame:
    return df.groupBy(count, target).agg(F.count(F.lit(1)).alias("n"))


def first_exemplar(df: DataFrame, target: str, row_id: str) -> DataFrame:
    """The first row of each class, in row order."""
    rest = [c for c in df.columns if c != target]
    return df.groupBy(target).agg(F.min_by(F.struct(*rest), F.col(row_id)).alias("_r")).select(target, "_r.*")


def rollup_report(df: DataFrame, first: str = "category", second: str = "escalated") -> DataFrame:
    """Cells, category totals and the grand total in one table; ``level`` tells which is which."""
    return df.rollup(first, second).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level")
    )
