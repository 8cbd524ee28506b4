"""Human review of labels: who has been reviewed, what changed, and what that does to the scores.

Audit rows are appended as versions and resolved when read, so two writers never overwrite each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caselane.functions.scores import share
from caselane.operators.evaluate import binary_metrics, confusion
from caselane.operators.ordered import neighbors


def latest(audit: DataFrame, version: str = "version") -> DataFrame:
    """The newest version of each thread's review."""
    rest = [c for c in audit.columns if c != "thread_id"]
    return audit.groupBy("thread_id").agg(
        F.max_by(F.struct(*rest), F.col(version)).alias("_r")).select("thread_id", "_r.*")


def audited_ids(audit: DataFrame) -> DataFrame:
    return audit.select("thread_id").distinct()


def audit_progress(labels: DataFrame, audit: DataFrame) -> DataFrame:
    """Total, audited, pending and percent. Reviews of unknown threads do not count."""
    marked = labels.select("thread_id").join(
        audited_ids(audit).withColumn("_done", F.lit(True)), "thread_id", "left")
    out = marked.agg(F.count(F.lit(1)).alias("total"), F.count("_done").alias("audited"))
    return out.select(
        "total", "audited", (F.col("total") - F.col("audited")).alias("pending"),
        share(F.col("audited") * 100, F.col("total")).alias("pct"),
    )


def audit_queue(labels: DataFrame, audit: DataFrame, view: str = "pending") -> DataFrame:
    if view == "all":
        return labels
    how = {"pending": "left_anti", "audited": "left_semi"}[view]
    return labels.join(audited_ids(audit), "thread_id", how)


def audit_neighbors(queue: DataFrame) -> DataFrame:
    """Previous and next thread of a queue; at its ends a thread is its own neighbour."""
    out = neighbors(queue.select("thread_id"), [], ["thread_id"], ["thread_id"])
    return out.select(
        "thread_id",
        F.coalesce("prev_thread_id", "thread_id").alias("prev_id"),
        F.coalesce("next_thread_id", "thread_id").alias("next_id"),
    )


def submit(audit: DataFrame, new: DataFrame, version: str = "version") -> DataFrame:
    """Insert reviews, or replace a thread's earlier one."""
    return latest(audit.unionByName(new, allowMissingColumns=True), version)


def confirm(audit: DataFrame, labels: DataFrame) -> DataFrame:
    """Accept the model's verdict for threads that have no review yet; existing reviews stay as they are."""
    fresh = labels.join(audited_ids(audit), "thread_id", "left_anti").select(
        "thread_id",
        F.col("escalated").alias("human_escalated"),
        F.col("category").alias("human_category"),
        F.lit("confirmed").alias("human_notes"),
    )
    return audit.select("thread_id", "human_escalated", "human_category", "human_notes").unionByName(fresh)


def with_review(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Labels beside the review of each thread (one row per thread in ``reviews``)."""
    side = reviews.select("thread_id", "human_escalated", "human_category")
    return labels.join(side, "thread_id", "left")


def audit_defaults(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """What a review form starts from: the earlier review where there is one, else the model's verdict."""
    side = reviews.select("thread_id", "human_escalated", "human_category", "human_notes")
    return labels.join(side, "thread_id", "left").select(
        "thread_id",
        F.coalesce("human_escalated", "escalated").alias("default_escalated"),
        F.coalesce("human_category", "category").alias("default_category"),
        F.coalesce("human_notes", F.lit("")).alias("default_notes"),
    )


def is_changed() -> Column:
    same = F.col("human_escalated").eqNullSafe(F.col("escalated"))
    return ~(same & F.col("human_category").eqNullSafe(F.col("category")))


def changed(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviewed threads whose label or category was altered."""
    side = reviews.select("thread_id", "human_escalated", "human_category")
    return labels.join(side, "thread_id").filter(is_changed()).select(
        "thread_id", "escalated", "category", "human_escalated", "human_category")


def corrected_labels(labels: DataFrame, reviews: DataFrame) -> DataFrame:
    """Labels with the human value where there is one; the labels themselves are left untouched."""
    both = with_review(labels, reviews)
    return both.withColumns({
        "escalated": F.coalesce("human_escalated", "escalated"),
        "category": F.coalesce("human_category", "category"),
    }).drop("human_escalated", "human_category")


def agreement(pairs: DataFrame, first: str = "escalated", second: str = "human_escalated") -> DataFrame:
    """The 2×2 table of two raters, their agreement and Cohen's kappa (NULL when chance agreement is certain)."""
    cells = confusion(pairs, (), first, second)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    observed = share(tn + tp, n)
    chance = share(tn + fp, n) * share(tn + fn, n) + share(fn + tp, n) * share(fp + tp, n)
    return cells.select(
        tn.alias("both_0"), fp.alias("only_second"), fn.alias("only_first"), tp.alias("both_1"),
        (observed * 100).alias("pct_agreement"),
        F.when(chance < 1, (observed - chance) / (1 - chance)).alias("kappa"),
    )


def override_matrix(labels: DataFrame, reviews: DataFrame, categories: list[str]) -> DataFrame:
    """Model category down, human category across; a human category that is not listed counts as ``to_other``."""
    side = reviews.select("thread_id", "human_category")
    return labels.join(side, "thread_id").groupBy("category").agg(
        *[F.count_if(F.col("human_category") == c).alias(f"to_{c}") for c in categories],
        F.count_if(F.col("human_category").isNotNull() & ~F.col("human_category").isin(*categories)).alias("to_other"),
    )


def auditor_stats(events: DataFrame, auditor: str, at: str, altered: Column) -> DataFrame:
    """Reviews and the share of altered ones, per auditor and day."""
    return events.groupBy(auditor, F.date_format(F.date_trunc("day", at), "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("reviews"), F.avg(altered.cast("double")).alias("change_rate"))


def relabel_impact(scored: DataFrame, reviews: DataFrame, row_id: str = "thread_id") -> DataFrame:
    """The metric set before and after human corrections to the truth."""
    side = reviews.select(F.col("thread_id").alias(row_id), "human_escalated")
    both = scored.join(side, row_id, "left").select(
        "y_prob",
        F.inline(F.array(
            F.struct(F.lit("before").alias("labels"), F.col("y_true").alias("y_true")),
            F.struct(F.lit("after").alias("labels"),
                     F.coalesce("human_escalated", "y_true").alias("y_true")),
        )),
    )
    return binary_metrics(both, ("labels",))
