"""Comparison of experiments, starting from prediction rows or from a table of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from caselane.functions.scores import rates
from caselane.operators.evaluate import CELLS, confusion

METRICS = ("f1_macro", "accuracy", "precision_macro", "recall_macro", "recall_escalated")


def run_table(predictions: DataFrame, by: tuple[str, ...] = ("model", "setting", "seed")) -> DataFrame:
    """One metric record per experiment cell, all from one aggregate over the prediction rows."""
    m = rates(*[F.col(c) for c in CELLS])
    return confusion(predictions, by).select(
        *by, *[m[c].alias(c) for c in METRICS if c in m], m["recall_1"].alias("recall_escalated"),
    )


def seed_summary(runs: DataFrame, by: str = "encoder", metric: str = "macro_f1") -> DataFrame:
    """Mean and sample deviation over seeds."""
    return runs.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_seeds"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"),
    )


def noise_floor(runs: DataFrame, base: str, by: str = "encoder", metric: str = "macro_f1") -> DataFrame:
    """Difference of each mean from the base, against two deviations of the base over its seeds."""
    summary = seed_summary(runs, by, metric)
    floor = summary.filter(F.col(by) == base)
    base_mean, base_std = floor.select("mean").scalar(), floor.select("std").scalar()
    out = summary.withColumns({"delta": F.col("mean") - base_mean, "two_sigma": 2 * base_std})
    verdict = F.when(F.abs("delta") > F.col("two_sigma"), "exceeds_noise").otherwise("within_noise")
    return out.withColumn("verdict", verdict)


def metric_comparison(runs: DataFrame, settings: list[str], drop_from: str, drop_to: str) -> DataFrame:
    """Metrics down, settings across, and the drop between two of them, per model."""
    metrics = [c for c in METRICS if c in runs.columns]
    long = runs.unpivot(["model", "setting"], metrics, "metric", "value")
    wide = long.groupBy("model", "metric").agg(
        *[F.avg(F.when(F.col("setting") == s, F.col("value"))).alias(s) for s in settings]
    )
    return wide.withColumn("drop", F.col(drop_from) - F.col(drop_to))


def design_matrix(runs: DataFrame, settings: list[str], inside: str, across: str,
                  metric: str = "f1_macro") -> DataFrame:
    """Models down, settings across, and what labels recover."""
    wide = runs.groupBy("model").agg(
        *[F.avg(F.when(F.col("setting") == s, F.col(metric))).alias(s) for s in settings]
    )
    return wide.withColumn("recovered", F.col(inside) - F.col(across))


def gap_decomposition(matrix: DataFrame, base: str, other: str, ceiling: str, across: str, inside: str) -> DataFrame:
    """What labels buy, what the model buys, and what is left, from a design matrix."""

    def cell(model, setting):
        return F.max(F.when(F.col("model") == model, F.col(setting)))

    best = F.greatest(cell(base, inside), cell(other, inside))
    return matrix.agg(
        (cell(other, inside) - cell(base, inside)).alias("model_gap_in"),
        (cell(other, across) - cell(base, across)).alias("model_gap_cross"),
        (cell(base, inside) - cell(base, across)).alias("label_gap_base"),
        (cell(other, inside) - cell(other, across)).alias("label_gap_other"),
        best.alias("best_in_domain"),
        (cell(base, ceiling) - best).alias("remainder"),
    )


def sweep_summary(runs: DataFrame, setting: str, metric: str) -> DataFrame:
    """Each setting's best record, the winner marked; of equals the first setting wins."""
    per = runs.groupBy(setting).agg(F.max(metric).alias("best"), F.count(F.lit(1)).alias("runs"))
    winner = per.agg(F.max_by(F.col(setting), F.struct(F.col("best"), -F.col(setting)))).scalar()
    return per.withColumn("selected", (F.col(setting) == winner).cast("int"))


def category_rank_agreement(recalls: DataFrame, base: str, other: str) -> DataFrame:
    """Whether two models find the same categories hard: the rank correlation of their recalls.

    ``recalls`` has one row per (model, category); ties share the mean of their ranks.
    """
    per_model = Window.partitionBy("model").orderBy("recall")
    tied = Window.partitionBy("model", "recall")
    ranked = recalls.select(
        "model", "category", (F.rank().over(per_model) + (F.count(F.lit(1)).over(tied) - 1) / 2).alias("_r")
    )
    sides = ranked.groupBy("category").agg(
        F.max(F.when(F.col("model") == base, F.col("_r"))).alias("base_rank"),
        F.max(F.when(F.col("model") == other, F.col("_r"))).alias("other_rank"),
    ).filter("base_rank IS NOT NULL AND other_rank IS NOT NULL")
    return sides.agg(F.count(F.lit(1)).alias("categories"), F.corr("base_rank", "other_rank").alias("spearman"))
