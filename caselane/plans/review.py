"""Queries on human review of labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselane.operators import audit, evaluate
from caselane.plans.registry import query
from caselane.plans.scores import F0, F1, METRICS, auc_sql, cells
from caselane.session import scratch_path
from caselane.sources.review_store import ReviewStore
from caselane.sources.views import with_views

JOINED = with_views("reviews", """, both_sides AS (SELECT l.thread_id, l.escalated, l.category, l.source, r.human_escalated,
    r.human_category, r.human_notes, length(l.first_customer_text) AS size
    FROM labeled l LEFT JOIN reviews r USING (thread_id)) """)


def labels(v):
    return v.labeled.select("thread_id", "escalated", "category")


def reviews(v):
    return audit.latest(v.audit_log)


@query("audit_progress", with_views("audit_log", """SELECT count(*) AS total,
    count(*) FILTER (thread_id IN (SELECT thread_id FROM audit_log)) AS audited,
    count(*) FILTER (thread_id NOT IN (SELECT thread_id FROM audit_log)) AS pending,
    round(count(*) FILTER (thread_id IN (SELECT thread_id FROM audit_log)) * 100.0 / count(*), 6) AS pct FROM labeled"""))
def audit_progress(v):
    return audit.audit_progress(labels(v), v.audit_log)


@query("audit_pending", with_views("audit_log", """SELECT thread_id, escalated, category FROM labeled
    WHERE thread_id NOT IN (SELECT thread_id FROM audit_log)"""))
def audit_pending(v):
    return audit.audit_queue(labels(v), v.audit_log, "pending")


@query("audit_done", with_views("audit_log", """SELECT thread_id, escalated, category FROM labeled
    WHERE thread_id IN (SELECT thread_id FROM audit_log)"""))
def audit_done(v):
    return audit.audit_queue(labels(v), v.audit_log, "audited")


@query("audit_neighbors", with_views("labeled", """SELECT thread_id, coalesce(lag(thread_id) OVER w, thread_id) AS prev_id,
    coalesce(lead(thread_id) OVER w, thread_id) AS next_id FROM labeled WINDOW w AS (ORDER BY thread_id)"""))
def audit_neighbors(v):
    return audit.audit_neighbors(audit.audit_queue(labels(v), v.audit_log, "all"))


@query("audit_upsert", with_views("reviews", """SELECT thread_id, human_escalated, human_category, human_notes, version
    FROM reviews"""))
def audit_upsert(v):
    log = v.audit_log
    return audit.submit(log.filter("version = 1"), log.filter("version = 2"))


@query("review_store", with_views("reviews", """SELECT thread_id, human_escalated, human_category, human_notes, version
    FROM reviews"""))
def review_store(v):
    """First looks are stored, second looks are applied to the buckets that they touch, and a part of them comes twice."""
    log = v.audit_log
    store = ReviewStore(v.spark, scratch_path(v.spark, "reviews"), log.schema)
    store.upsert(log.filter("version = 1"))
    store.upsert(log.filter("version = 2 AND thread_id % 2 = 0"))
    store.append(log.filter("version = 2 AND thread_id % 2 = 1"), 0)
    store.append(log.filter("version = 1"), 1)
    store.compact(2)
    return store.read()


@query("audit_confirm", with_views("reviews", """SELECT thread_id, human_escalated, human_category, human_notes FROM reviews
    UNION ALL SELECT thread_id, escalated, category, 'confirmed' FROM labeled
    WHERE thread_id NOT IN (SELECT thread_id FROM reviews)"""))
def audit_confirm(v):
    return audit.confirm(reviews(v), labels(v))


@query("audit_changed", JOINED + """SELECT thread_id, escalated, category, human_escalated, human_category FROM both_sides
    WHERE human_escalated IS NOT NULL AND (human_escalated <> escalated OR human_category <> category)""")
def audit_changed(v):
    return audit.changed(labels(v), reviews(v))


@query("audit_defaults", JOINED + """SELECT thread_id, coalesce(human_escalated, escalated) AS default_escalated,
    coalesce(human_category, category) AS default_category, coalesce(human_notes, '') AS default_notes FROM both_sides""")
def audit_defaults(v):
    return audit.audit_defaults(labels(v), reviews(v))


@query("corrected_labels", JOINED + """SELECT thread_id, coalesce(human_escalated, escalated) AS escalated,
    coalesce(human_category, category) AS category FROM both_sides""")
def corrected_labels(v):
    return audit.corrected_labels(labels(v), reviews(v))


@query("cohens_kappa", JOINED + """, c AS (SELECT count(*) FILTER (escalated = 0 AND human_escalated = 0) AS a,
    count(*) FILTER (escalated = 0 AND human_escalated = 1) AS b,
    count(*) FILTER (escalated = 1 AND human_escalated = 0) AS c,
    count(*) FILTER (escalated = 1 AND human_escalated = 1) AS d FROM both_sides),
    k AS (SELECT *, (a + d) / (a + b + c + d) AS po, ((a + b) * (a + c) + (c + d) * (b + d))
    / CAST((a + b + c + d) * (a + b + c + d) AS DOUBLE) AS pe FROM c)
    SELECT a AS both_0, b AS only_second, c AS only_first, d AS both_1, round(po * 100, 6) AS pct_agreement,
    round((po - pe) / (1 - pe), 6) AS kappa FROM k""")
def cohens_kappa(v):
    return audit.agreement(labels(v).join(reviews(v), "thread_id"))


MATRIX = ["self_service", *[f"src{k}" for k in range(15)]]  # the others are not listed


@query("override_matrix", JOINED + "SELECT category, " + ", ".join(
    f"count(*) FILTER (human_category = '{c}') AS to_{c}" for c in MATRIX)
    + ", count(*) FILTER (human_category NOT IN (" + ", ".join(f"'{c}'" for c in MATRIX) + ")) AS to_other FROM both_sides WHERE human_category IS NOT NULL GROUP BY category")
def override_matrix(v):
    return audit.override_matrix(labels(v), reviews(v), MATRIX)


@query("auditor_stats", """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS reviews,
    round(avg(CAST(event_type = 'error' AS DOUBLE)), 6) AS change_rate FROM events GROUP BY 1, 2""")
def auditor_stats(v):
    return audit.auditor_stats(v.table("events"), "user_id", "ts", F.col("event_type") == "error")


@query("relabel_impact", JOINED + f""", s AS (SELECT size / (size + 500.0) AS y_prob, escalated,
    coalesce(human_escalated, escalated) AS fixed FROM both_sides), pred AS (SELECT 'before' AS labels, y_prob,
    escalated AS y_true, CAST(y_prob >= 0.5 AS INTEGER) AS y_pred FROM s UNION ALL SELECT 'after', y_prob, fixed,
    CAST(y_prob >= 0.5 AS INTEGER) FROM s), c AS ({cells('labels')}), u AS ({auc_sql('labels', 'pred')})
    SELECT labels, {METRICS}, round(roc_auc, 6) AS roc_auc, tn, fp, fn, tp FROM c JOIN u USING (labels)""")
def relabel_impact(v):
    size = F.length("first_customer_text")
    scored = v.labeled.select("thread_id", F.col("escalated").alias("y_true"), (size / (size + 500.0)).alias("y_prob"))
    return audit.relabel_impact(scored, reviews(v))
