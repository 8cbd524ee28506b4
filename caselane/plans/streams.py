"""Queries that run as streams over the event table; the checking SQL is their batch form.

A windowed stream hands out a window only once the watermark has passed its end, so the SQL keeps the same ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from caselane.functions.scores import decide
from caselane.operators import classify
from caselane.plans.language import STOP, STOP_SQL, recursive, refit_sql, training
from caselane.plans.registry import query
from caselane.sources.views import with_views
from caselane.streaming import live

TARGET_SQL = "event_type IN ('error', 'purchase')"


def is_escalated():
    return F.col("event_type").isin("error", "purchase")


def rule_model(rows):
    p = F.col("value") / (1 + F.col("value"))
    return rows.select("event_id", p.alias("y_prob")).withColumn("y_pred", decide(F.col("y_prob"), 0.9))


@query("stream_score", """SELECT event_id, round(value / (1 + value), 6) AS y_prob,
    CAST(value / (1 + value) >= 0.9 AS INTEGER) AS y_pred FROM events""")
def stream_score(v):
    return live.run_to_table(live.score_stream(v.message_events, rule_model), "score")


@query("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(v):
    """Every event is delivered twice; one copy is kept."""
    twice = v.message_events.unionByName(v.message_events)
    out = live.dedup_stream(twice, ["event_id"], "ts", "2 hours").select("event_id", "user_id", "event_type")
    return live.run_to_table(out, "dedup")


def window_sql(starts: str) -> str:
    return f"""WITH w AS (SELECT {starts} AS s, {TARGET_SQL} AS t FROM events)
        SELECT s AS start_s, s + 3600 AS end_s, count(*) AS n, CAST(sum(CAST(t AS INTEGER)) AS BIGINT) AS escalated
        FROM w GROUP BY s HAVING (s + 3600) * 1000000 <= (SELECT epoch_us(max(ts)) FROM events) - 600000000"""


@query("stream_tumbling", window_sql("CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600"))
def stream_tumbling(v):
    return live.run_to_table(
        live.windowed_rate(v.message_events, "ts", "10 minutes", "1 hour", is_escalated()), "tumbling")


@query("stream_sliding", window_sql("(CAST(floor(epoch_us(ts) / 1800000000) AS BIGINT) - unnest([0, 1])) * 1800"))
def stream_sliding(v):
    return live.run_to_table(
        live.windowed_rate(v.message_events, "ts", "10 minutes", "1 hour", is_escalated(), "30 minutes"), "sliding")


@query("stream_sessions", """WITH e AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER
    (PARTITION BY user_id ORDER BY ts) AS gap FROM events), s AS (SELECT user_id, us, count(*) FILTER
    (gap IS NULL OR gap >= 7200000000) OVER (PARTITION BY user_id ORDER BY us) AS sid FROM e)
    SELECT user_id, min(us) AS start_us, max(us) + 7200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, sid
    HAVING max(us) + 7200000000 <= (SELECT epoch_us(max(ts)) FROM events) - 600000000""")
def stream_sessions(v):
    return live.run_to_table(live.sessions(v.message_events, "user_id", "ts", "10 minutes", "2 hours"), "sessions")


@query("stream_audit_upsert", """SELECT user_id AS thread_id, CAST(event_type IN ('error', 'purchase') AS INTEGER)
    AS human_escalated, event_id AS version FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def stream_audit_upsert(v):
    reviews = v.message_events.select(
        F.col("user_id").alias("thread_id"), is_escalated().cast("int").alias("human_escalated"),
        F.col("event_id").alias("version"))
    return live.audit_upserts(reviews, "upsert")


@query("stream_static_join", """SELECT event_id, user_id, CAST(user_id IN (SELECT doc_id FROM labels) AS INTEGER)
    AS audited FROM events""")
def stream_static_join(v):
    def mark(batch):
        audited = v.table("labels").select(F.col("doc_id").alias("user_id")).distinct()
        return live.mark_audited(batch, audited, "user_id").select("event_id", "user_id", "audited")

    return live.run_batches(v.message_events.select("event_id", "user_id"), mark, "static")


@query("stream_first_message", """WITH w AS (SELECT epoch_us(max(ts)) // 1000 - 600000 AS watermark FROM events)
    SELECT user_id, event_id, epoch_us(ts) AS first_us FROM events, w
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AND epoch_us(ts) // 1000 < watermark""")
def stream_first_message(v):
    """The opening message of every user that the watermark has passed; nobody is forgotten within the table's time."""
    return live.first_messages(v.message_events, "user_id", "event_id", "ts", "10 minutes", 366 * 86_400_000, "first")


@query("stream_score_fitted", recursive(with_views("labeled", ", "
    + refit_sql("SELECT 0 AS arm, 1.0 AS c, 1 AS pairs, thread_id, 1 AS member FROM labeled", STOP_SQL)
    + "SELECT thread_id, round(p, 4) AS y_prob, CAST(p >= 0.5 AS INTEGER) AS y_pred FROM scored")))
def stream_score_fitted(v):
    """A model fitted on the labelled threads scores the documents as they arrive; those with a label are given."""
    model = classify.fit(training(v), "thread_id", "text", "escalated", stop=STOP)
    documents = v.table("documents").select("doc_id", "text")
    arriving = live.message_stream(v.spark, f"{v.folder}/documents.parquet", documents.schema)
    rows = arriving.join(v.table("labels").select("doc_id"), "doc_id").withColumnRenamed("doc_id", "thread_id")
    scored = live.run_to_table(live.score_stream(rows, lambda r: classify.score(model, r)), "score-fitted")
    return scored.select("thread_id", (F.round(F.col("y_prob") * 1e4) / 1e4).alias("y_prob"), "y_pred")
