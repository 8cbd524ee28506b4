"""Queries on reply-linked messages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from caselane.functions.taxonomy import SELF_SERVICE
from caselane.operators import threads
from caselane.operators.split import sample_manifest
from caselane.plans.registry import query
from caselane.sources.views import with_views


@query("reply_edges", with_views("messages", """, l AS (SELECT message_id AS child, parent_id AS parent FROM messages
    WHERE parent_id IS NOT NULL UNION ALL SELECT next_id, message_id FROM messages)
    SELECT child, min(parent) AS parent, CAST(min(parent) <> max(parent) AS INTEGER) AS conflict FROM l GROUP BY child"""))
def reply_edges(v):
    return threads.reply_edges(v.messages)


@query("thread_roots", with_views("messages", "SELECT message_id, thread_id FROM messages"))
def thread_roots(v):
    return threads.with_threads(v.messages.drop("thread_id")).select("message_id", "thread_id")


@query("tree_roots", with_views("tree", """, walk AS (WITH RECURSIVE w AS (SELECT node_id, node_id AS root, 0 AS depth
    FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.node_id, w.root, w.depth + 1 FROM tree t
    JOIN w ON t.parent_id = w.node_id) SELECT * FROM w)
    SELECT node_id AS message_id, root AS thread_id, CAST(depth AS BIGINT) AS depth, CAST(0 AS INTEGER) AS in_cycle
    FROM walk"""))
def tree_roots(v):
    return threads.thread_roots(v.tree, "node_id", "parent_id")


@query("thread_depth", with_views("messages", "SELECT message_id, CAST(seq AS BIGINT) AS depth FROM messages"))
def thread_depth(v):
    return threads.with_threads(v.messages.drop("thread_id")).select("message_id", "depth")


@query("assemble_threads", with_views("messages", """SELECT thread_id, count(*) AS turn_count,
    min_by(message_id, seq) FILTER (inbound) AS first_customer_id, min_by(text, seq) FILTER (inbound)
    AS first_customer_text FROM messages GROUP BY thread_id"""))
def assemble_threads(v):
    return threads.assemble_threads(v.messages, ["seq", "message_id"])


@query("orphan_replies", with_views("messages", """, kept AS (SELECT * FROM messages WHERE inbound)
    SELECT message_id, parent_id FROM kept WHERE parent_id IS NOT NULL
    AND parent_id NOT IN (SELECT message_id FROM kept)"""))
def orphan_replies(v):
    """Among the customers' own messages every reply to an agent lost its parent."""
    return threads.orphans(v.messages.filter("inbound"))


@query("branch_points", with_views("tree", """SELECT parent_id, count(*) AS replies FROM tree
    WHERE parent_id IS NOT NULL GROUP BY parent_id HAVING count(*) > 1"""))
def branch_points(v):
    return threads.branch_points(v.tree, "parent_id")


@query("thread_stats", with_views("messages", """, o AS (SELECT thread_id, min(seq) FILTER (inbound) AS opened
    FROM messages GROUP BY thread_id) SELECT thread_id, count(*) AS turns,
    count(*) FILTER (inbound) AS customer_turns, count(*) FILTER (NOT inbound) AS agent_turns,
    min(seq) FILTER (NOT inbound AND seq > opened) - min(opened) AS first_response_gap
    FROM messages JOIN o USING (thread_id) GROUP BY thread_id"""))
def thread_stats(v):
    return threads.thread_stats(v.messages, "seq")


@query("turn_order", with_views("messages", """SELECT message_id, thread_id,
    row_number() OVER w AS turn_no, lag(message_id) OVER w AS prev_message_id,
    CAST(lag(inbound) OVER w AS INTEGER) AS prev_inbound
    FROM messages WINDOW w AS (PARTITION BY thread_id ORDER BY seq, message_id)"""))
def turn_order(v):
    rows = v.messages.select("thread_id", "message_id", "seq", "inbound")
    out = threads.turn_order(rows, ["seq", "message_id"])
    return out.select("message_id", "thread_id", "turn_no", "prev_message_id",
                      F.col("prev_inbound").cast("int").alias("prev_inbound"))


@query("sample_manifest", with_views("messages", """, t AS (SELECT DISTINCT thread_id FROM messages)
    SELECT thread_id FROM t ORDER BY md5('42|' || CAST(thread_id AS VARCHAR)), thread_id LIMIT 50"""))
def manifest(v):
    return sample_manifest(v.messages.select("thread_id").distinct(), "thread_id", 50)


@query("sample_rows", with_views("requests", """, s AS (SELECT row_id, length(instruction) AS x FROM requests
    ORDER BY md5('42|' || CAST(row_id AS VARCHAR)), row_id LIMIT 100)
    SELECT count(*) AS n, round(avg(x), 6) AS mean FROM s"""))
def sample_rows(v):
    sampled = sample_manifest(v.requests.select("row_id", F.length("instruction").alias("x")), "row_id", 100)
    return sampled.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))


def long_question_labeler(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a labeling service: texts over 1,000 characters need a person."""
    size = batch["first_customer_text"].fillna("").str.len()
    needs = size > 1000
    return pd.DataFrame({
        "thread_id": batch["thread_id"],
        "escalated": needs.astype("int32"),
        "category": needs.map({True: "complaint", False: SELF_SERVICE}),
        "reason": "length " + size.astype(str),
    })


@query("label_threads", with_views("messages", """, t AS (SELECT thread_id, min_by(text, seq) FILTER (inbound) AS body
    FROM messages GROUP BY thread_id) SELECT thread_id, CAST(length(body) > 1000 AS INTEGER) AS escalated,
    CASE WHEN length(body) > 1000 THEN 'complaint' ELSE 'self_service' END AS category,
    'length ' || CAST(length(body) AS VARCHAR) AS reason FROM t"""))
def label_threads(v):
    opened = threads.assemble_threads(v.messages, ["seq", "message_id"])
    return threads.label_threads(opened, long_question_labeler)


@query("validate_labels", with_views("labeled", """, r AS (SELECT thread_id, escalated,
    CASE WHEN lang = 'de' THEN 'self_service' ELSE category END AS category,
    CASE WHEN lang = 'es' THEN '' ELSE lang END AS reason FROM labeled), k AS (SELECT *, CASE
    WHEN escalated = 1 AND NOT (category LIKE 'src%') THEN 'escalated_without_category'
    WHEN escalated = 0 AND category <> 'self_service' THEN 'self_service_with_category'
    WHEN reason = '' THEN 'reason_missing' END AS violation FROM r)
    SELECT thread_id, violation FROM k WHERE violation IS NOT NULL"""))
def validate_labels(v):
    """Labels with two faults put in: German ones lose their category, Spanish ones their reason."""
    faulty = v.labeled.withColumns({
        "category": F.when(F.col("lang") == "de", SELF_SERVICE).otherwise(F.col("category")),
        "reason": F.when(F.col("lang") == "es", "").otherwise(F.col("lang")),
    })
    known = tuple(f"src{k}" for k in range(20))
    return threads.validate_labels(faulty, known).select("thread_id", "violation")
