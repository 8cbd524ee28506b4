"""Evaluation of scored rows: (id, y_true, y_prob or y_pred[, category, model])."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from caselane.functions import text as tx
from caselane.functions.scores import decide, rates, ratio, share
from caselane.functions.taxonomy import FINE_GRID
from caselane.operators.curves import auc_column, best_threshold
from caselane.operators.ordered import lookup_join, running_sums
from caselane.operators.profile import histogram

CELLS = ("tn", "fp", "fn", "tp")


def long_scores(df: DataFrame, models: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per model from one probability column per model."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("y_prob")) for m, c in models.items()])
    return df.select(*keep, F.inline(pairs))


def with_pred(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("y_pred", decide(F.col("y_prob"), threshold))


def confusion(df: DataFrame, by: tuple[str, ...] = (), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """The four counts per group in one aggregate; a cell nobody falls in is 0."""
    t, p = F.col(y_true), F.col(y_pred)
    return df.groupBy(*by).agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
    )


def metrics_of(counts: DataFrame, keep: list[str]) -> DataFrame:
    """The published metric set from the four counts (and ``roc_auc`` where it is present)."""
    m = rates(*[F.col(c) for c in CELLS])
    extra = ["roc_auc"] if "roc_auc" in counts.columns else []
    return counts.select(
        *keep,
        m["accuracy"].alias("accuracy"),
        m["precision_macro"].alias("precision_macro"),
        m["recall_macro"].alias("recall_macro"),
        m["f1_macro"].alias("f1_macro"),
        m["precision_1"].alias("precision_escalated"),
        m["recall_1"].alias("recall_escalated"),
        m["f1_1"].alias("f1_escalated"),
        *extra, *CELLS,
    )


def binary_metrics(df: DataFrame, by: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """Accuracy, macro and escalated precision / recall / F1, exact AUC and the matrix.

    Everything comes from one table of counts per (group, score, decision), so the rows are read once.
    """
    keys = list(by)
    scored = df if "y_pred" in df.columns else with_pred(df, threshold)
    cells = confusion(scored.filter("y_prob IS NOT NULL"), (*keys, "y_prob"))
    cells = cells.withColumns({"pos": F.col("tp") + F.col("fn"), "neg": F.col("tn") + F.col("fp")})
    ranked = running_sums(cells, keys, ["y_prob"], {"_neg": F.col("neg")})
    counts = ranked.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CELLS], auc_column().alias("roc_auc")
    )
    return metrics_of(counts, keys)


def classification_report(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per-class rows plus the macro and the support-weighted average."""
    m = rates(*[F.col(c) for c in CELLS])
    s0, s1 = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")

    def line(label, values, support):
        named = zip(("precision", "recall", "f1"), values)
        return F.struct(F.lit(label).alias("label"), *[v.alias(n) for n, v in named], support.alias("support"))

    names = ("precision", "recall", "f1")
    weighted = [share(m[f"{n}_0"] * s0 + m[f"{n}_1"] * s1, s0 + s1) for n in names]
    lines = F.array(
        line("0", [m[f"{n}_0"] for n in names], s0),
        line("1", [m[f"{n}_1"] for n in names], s1),
        line("macro avg", [m[f"{n}_macro"] for n in names], s0 + s1),
        line("weighted avg", weighted, s0 + s1),
    )
    return confusion(df, by).select(*by, F.inline(lines))


def specificity(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of self-service rows left alone."""
    return confusion(df, by).select(*by, share(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"))


def error_counts(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Missed escalations and false alarms, and the share of escalations missed."""
    return confusion(df, by).select(
        *by, F.col("fn").alias("missed"), F.col("fp").alias("false_alarms"),
        (F.col("fn") + F.col("tp")).alias("escalations"),
        share(F.col("fn"), F.col("fn") + F.col("tp")).alias("missed_share"),
    )


def calibration_table(df: DataFrame, by: str = "model") -> DataFrame:
    """How much of each model's score is only the place of its cut-off."""
    base = binary_metrics(df, (by,)).select(by, F.col("f1_macro").alias("f1_at_default"), "roc_auc")
    best = best_threshold(df, FINE_GRID, (by,))
    return base.join(best, by).select(
        by, "f1_at_default", "best_threshold", F.col("best_macro_f1").alias("f1_at_best"), "roc_auc",
        (F.col("best_macro_f1") - F.col("f1_at_default")).alias("gain"),
    )


def recall_by_category(df: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Escalated rows per category, and the share the model finds."""
    return (
        df.filter(F.col("y_true") == 1).groupBy(*by, "category")
        .agg(F.count(F.lit(1)).alias("threads"), F.avg("y_pred").alias("recall"))
        .orderBy(*by, F.desc("recall"), "category")
    )


def recall_delta(df: DataFrame, base_pred: str, other_pred: str) -> DataFrame:
    """Two models side by side per category, from one aggregate."""
    out = df.filter(F.col("y_true") == 1).groupBy("category").agg(
        F.count(F.lit(1)).alias("threads"),
        F.avg(base_pred).alias("base_recall"),
        F.avg(other_pred).alias("other_recall"),
    )
    return out.withColumn("delta", F.col("other_recall") - F.col("base_recall")).orderBy(
        F.desc("other_recall"), "category")


def recall_gain(inside: DataFrame, across: DataFrame) -> DataFrame:
    """In-domain minus cross-domain recall; a category the other side lacks keeps a NULL there."""
    other = across.select("category", F.col("recall").alias("cross_domain_recall"))
    return inside.select("category", "threads", F.col("recall").alias("in_domain_recall")).join(
        other, "category", "left"
    ).withColumn("gain", F.col("in_domain_recall") - F.col("cross_domain_recall"))


def score_distribution(df: DataFrame, bins: int = 40) -> DataFrame:
    """Where a model puts its probability mass, per true class over that class's own range."""
    return histogram(df, "y_prob", "y_true", bins=bins, common_range=False)


def join_predictions(rows: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Put predictions back beside their rows, by id rather than by position."""
    return rows.join(predictions, key)


def route(probability, low: float, high: float):
    """Keep what the model is sure of; hand off the band it is torn on."""
    return F.when((probability >= low) & (probability < high), F.lit("hand_off")).otherwise(F.lit("local"))


def uncertainty_routing(df: DataFrame, low: float, high: float, threshold: float = 0.5) -> DataFrame:
    """Volume and error rate inside and outside the band."""
    scored = with_pred(df, threshold)
    wrong = (F.col("y_pred") != F.col("y_true")).cast("int")
    total = df.agg(F.count(F.lit(1))).scalar()
    return scored.groupBy(route(F.col("y_prob"), low, high).alias("route")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(wrong).alias("errors"), F.avg(wrong).alias("error_rate"),
    ).withColumn("share", share(F.col("n"), total))


def cascade_route(df: DataFrame, text: str, low: float, high: float, patterns=tx.HUMAN_REQUEST) -> DataFrame:
    """Final route per row: an explicit request first, then the torn band, then the model."""
    p = F.col("y_prob")
    return df.withColumn(
        "final_route",
        F.when(tx.matches_any(F.col(text), patterns), F.lit("human_by_rule"))
        .when((p >= low) & (p < high), F.lit("hand_off"))
        .when(p >= high, F.lit("human_by_model"))
        .otherwise(F.lit("self_service")),
    )


def label_collisions(df: DataFrame, by: tuple[str, ...] = ("category",)) -> DataFrame:
    """Escalations a model sends to self-service, and their share of each category."""
    missed = ((F.col("y_pred") == 0)).cast("int")
    return df.filter(F.col("y_true") == 1).groupBy(*by).agg(
        F.count(F.lit(1)).alias("threads"), F.sum(missed).alias("missed"),
    ).withColumn("missed_share", ratio(F.col("missed"), F.col("threads")))


def nearest_intent(missed: DataFrame, sources: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """For each missed row, the source intent whose average TF-IDF vector is closest by cosine.

    ``missed`` holds (doc_id, term, weight) with unit-length rows, ``sources`` the same plus ``intent``. All
    intents of a term sit in one row, so the table joined against is unique on the term and no longer than the
    vocabulary; a term most rows contain is looked up apart.
    """
    sums = sources.groupBy("intent", "term").agg(F.sum("weight").alias("_w"))
    norms = sums.groupBy("intent").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    unit = sums.join(norms, "intent").withColumn("_w", F.col("_w") / F.col("_norm"))
    centroids = unit.groupBy("term").agg(F.collect_list(F.struct("intent", "_w")).alias("_c"))
    scored = (
        lookup_join(missed, centroids, "term").filter("_c IS NOT NULL")
        .select(doc_id, "weight", F.inline("_c"))
        .groupBy(doc_id, "intent").agg(F.sum(F.col("weight") * F.col("_w")).alias("cosine"))
    )
    best = F.max_by(F.struct("intent", "cosine"), F.struct(F.round("cosine", 9), F.col("intent")))
    return scored.groupBy(doc_id).agg(best.alias("_b")).select(doc_id, "_b.intent", "_b.cosine")
