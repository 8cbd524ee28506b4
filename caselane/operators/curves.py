"""Exact ranking curves and cut-off sweeps over (y_true, y_prob), per group.

Rows are first counted per distinct score. Curves then take running totals over scores in range partitions;
sweeps bucket each score by a fixed grid once, so every cut-off comes out of one pass.
"""

from __future__ import annotations

from math import inf

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from caselane.functions.scores import ratio, rates, share
from caselane.functions.taxonomy import COARSE_GRID, FINE_GRID
from caselane.operators.ordered import running_sums


def by_score(df: DataFrame, by: list[str]) -> DataFrame:
    return (
        df.groupBy(*by, "y_prob")
        .agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"))
        .filter("y_prob IS NOT NULL")
    )


def auc_column() -> Column:
    """Aggregate over score rows carrying ``pos``, ``neg`` and the inclusive running ``_neg``.

    Each positive beats the negatives below its score and half of those that share it; a single class gives NULL.
    """
    below = F.col("_neg") - F.col("neg")
    won = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2))
    return share(won, F.sum("pos").cast("double") * F.sum("neg").cast("double"))


def roc_auc(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    keys = list(by)
    ranked = running_sums(by_score(df, keys), keys, ["y_prob"], {"_neg": F.col("neg")})
    return ranked.groupBy(*keys).agg(auc_column().alias("roc_auc"))


def cumulative(df: DataFrame, by: list[str]) -> DataFrame:
    """Per distinct score, highest first: true and false positives at ``p >= score``, and class totals."""
    scores = by_score(df, by).withColumn("_down", -F.col("y_prob"))
    return running_sums(
        scores, by, ["_down"], {"tp": F.col("pos"), "fp": F.col("neg")}, totals={"tp": "p", "fp": "n"})


def roc_curve(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, collinear points included."""
    return cumulative(df, list(by)).select(
        *by, F.col("y_prob").alias("threshold"),
        share(F.col("fp"), F.col("n")).alias("fpr"), share(F.col("tp"), F.col("p")).alias("tpr"),
    )


def pr_curve(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return cumulative(df, list(by)).select(
        *by, F.col("y_prob").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        share(F.col("tp"), F.col("p")).alias("recall"),
    )


def sweep_counts(df: DataFrame, grid: tuple[float, ...], by: list[str]) -> DataFrame:
    """The four counts at every cut-off of an ascending grid.

    A score's bucket is the number of cut-offs it reaches. After counting rows per bucket at most
    ``len(grid) + 1`` rows per group remain, and each stands for all cut-offs up to its own.
    """
    bucketed = Bucketizer(
        splits=[-inf, *grid, inf], inputCol="y_prob", outputCol="_b", handleInvalid="keep"
    ).transform(df.filter("y_prob IS NOT NULL"))
    counts = bucketed.groupBy(*by, F.col("_b").cast("int").alias("_b")).agg(
        F.count_if(F.col("y_true") == 1).alias("_pos"), F.count_if(F.col("y_true") == 0).alias("_neg"),
    )
    steps = F.sequence(F.lit(1), F.lit(len(grid)))
    reached = (
        counts.filter("_b > 0").select(*by, F.explode(F.sequence(F.lit(1), F.col("_b"))).alias("_k"), "_pos", "_neg")
        .groupBy(*by, "_k").agg(F.sum("_pos").alias("tp"), F.sum("_neg").alias("fp"))
    )
    totals = counts.groupBy(*by).agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    at = F.element_at(F.array(*[F.lit(t) for t in grid]), F.col("_k"))
    return (
        totals.select("*", F.explode(steps).alias("_k"))
        .join(reached, [*by, "_k"], "left")
        .withColumns({"tp": F.coalesce("tp", F.lit(0)), "fp": F.coalesce("fp", F.lit(0))})
        .withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp"), "threshold": at})
        .select(*by, "threshold", "tn", "fp", "fn", "tp")
    )


def threshold_sweep(df: DataFrame, grid: tuple[float, ...] = COARSE_GRID, by: tuple[str, ...] = ()) -> DataFrame:
    """What each cut-off costs in both directions."""
    m = rates(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    every = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return sweep_counts(df, grid, list(by)).select(
        *by, "threshold",
        m["f1_macro"].alias("macro_f1"),
        m["recall_1"].alias("recall_escalated"),
        m["precision_1"].alias("precision_escalated"),
        F.col("fn").alias("missed_escalations"),
        F.col("fp").alias("false_alarms"),
        share((F.col("tp") + F.col("fp")) * 100, every).alias("pct_routed_to_agent"),
    )


def best_threshold(df: DataFrame, grid: tuple[float, ...] = FINE_GRID, by: tuple[str, ...] = ()) -> DataFrame:
    """The cut-off with the highest macro F1; of equals, the smallest."""
    swept = threshold_sweep(df, grid, by)
    rank = F.struct(F.round("macro_f1", 12), -F.col("threshold"))
    best = F.max_by(F.struct("threshold", "macro_f1"), rank)
    return swept.groupBy(*by).agg(best.alias("_b")).select(
        *by, F.col("_b.threshold").alias("best_threshold"), F.col("_b.macro_f1").alias("best_macro_f1")
    )


def operating_point(sweep: DataFrame, cost_fn: float, cost_fp: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The cheapest cut-off of a sweep, to be chosen on validation rows; of equals, the smallest."""
    cost = F.col("missed_escalations") * F.lit(float(cost_fn)) + F.col("false_alarms") * F.lit(float(cost_fp))
    priced = sweep.withColumn("cost", cost)
    pick = F.min_by(F.struct("threshold", "cost", "missed_escalations", "false_alarms"), F.struct("cost", "threshold"))
    return priced.groupBy(*by).agg(pick.alias("_b")).select(*by, "_b.*")
