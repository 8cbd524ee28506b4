"""Conversations rebuilt from reply links, and what is measured on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from caselane.functions.taxonomy import ESCALATION_INTENTS, SELF_SERVICE
from caselane.operators.ordered import lookup_join, neighbors
from caselane.operators.split import sample_manifest  # noqa: F401  (re-exported: sampling belongs to threads)
from caselane.session import written


def reply_edges(messages: DataFrame) -> DataFrame:
    """One (child, parent) per reply, from both link columns; of disagreeing parents the smallest wins.

    ``conflict`` is 1 where the two columns named different parents.
    """
    up = messages.filter("parent_id IS NOT NULL").select(F.col("message_id").alias("child"),
                                                       F.col("parent_id").alias("parent"))
    links = up
    if "response_ids" in messages.columns:
        down = messages.select(F.explode("response_ids").alias("child"), F.col("message_id").alias("parent"))
        links = up.unionByName(down)
    return links.groupBy("child").agg(
        F.min("parent").alias("parent"),
        (F.min("parent") != F.max("parent")).cast("int").alias("conflict"),
    )


def present_edges(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """Every message with its parent, where that parent is itself in the table; otherwise NULL."""
    ids = messages.select(F.col("message_id").alias("child"))
    linked = ids.join(edges.select("child", "parent"), "child", "left")
    known = messages.select(F.col("message_id").alias("parent"), F.lit(True).alias("_known"))
    return lookup_join(linked, known, "parent").select(
        "child", F.when(F.col("_known"), F.col("parent")).alias("parent"))


FEW_STEPS = 64


def thread_roots(links: DataFrame, node: str = "child", parent: str = "parent") -> DataFrame:
    """Root and depth of every node by pointer jumping.

    ``links`` has one row per node; a NULL parent makes it a root, and every parent must be a node (see
    :func:`present_edges`). Each round replaces a pointer by the pointer it leads to, so the distance covered
    doubles and ``log2(depth)`` rounds suffice. A round is one join, written down; finished nodes are written once and moved no
    more. Where many pointers lead to one node Spark splits their join, as of any skewed key.
    Nodes still unfinished when the rounds cover more steps than there are nodes sit on or behind a cycle: each
    cycle is a thread of its own, named by its smallest member, with ``in_cycle`` = 1 and no depth.
    """
    state = written(links.select(
        F.col(node).alias("node"),
        F.coalesce(F.col(parent), F.col(node)).alias("ptr"),
        F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.col(parent).isNull().alias("done"),
        F.col(node).alias("least"),  # of the nodes passed on the way
    ), "pointers")
    active, finished, covered, total = state.filter("NOT done"), [state.filter("done")], 1, None
    while pending := not active.isEmpty():
        if covered > FEW_STEPS:  # only then a cycle is likely enough to count
            total = state.count() if total is None else total
            if covered > 2 * total:
                break
        target = reduce(DataFrame.unionByName, [*finished, active]).select(
            F.col("node").alias("ptr"), F.col("ptr").alias("_next"), F.col("depth").alias("_depth"),
            F.col("done").alias("_done"), F.col("least").alias("_least"))
        moved = written(active.join(target, "ptr").select(
            "node", F.col("_next").alias("ptr"), (F.col("depth") + F.col("_depth")).alias("depth"),
            F.col("_done").alias("done"), F.least("least", "_least").alias("least")), "pointers")
        active, covered = moved.filter("NOT done"), 2 * covered
        finished.append(moved.filter("done"))
    trees = reduce(DataFrame.unionByName, finished).select(
        F.col("node").alias("message_id"), F.col("ptr").alias("thread_id"), "depth", F.lit(0).alias("in_cycle"))
    if not pending:
        return trees
    # every pointer now lies on its cycle, and what a node of a cycle has passed is the whole cycle
    names = active.select(F.col("node").alias("ptr"), F.col("least").alias("_name"))
    cycles = active.join(names, "ptr").select(
        F.col("node").alias("message_id"), F.col("_name").alias("thread_id"), F.lit(None).cast("long").alias("depth"),
        F.lit(1).alias("in_cycle"))
    return trees.unionByName(cycles)


def with_threads(messages: DataFrame) -> DataFrame:
    """Messages with the id of their thread and their depth in it. A reply to an unknown message starts one."""
    roots = thread_roots(present_edges(messages, reply_edges(messages)))
    return messages.join(roots, "message_id")


def assemble_threads(messages: DataFrame, order: list[str]) -> DataFrame:
    """One row per thread: number of turns and the customer's opening message.

    Only counts and minima are kept per thread, so a thread of any length is reduced before the shuffle; the
    turns themselves stay rows (see :func:`turn_order`).
    """
    place = F.struct(*order)
    customer = F.col("inbound")
    first = F.min_by(F.struct("message_id", "text"), F.when(customer, place))
    return messages.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("turn_count"), first.alias("_f")
    ).select(
        "thread_id", "turn_count",
        F.col("_f.message_id").alias("first_customer_id"), F.col("_f.text").alias("first_customer_text"),
    )


def turn_order(messages: DataFrame, order: list[str]) -> DataFrame:
    """Turn number within the thread and the message said before, however long the thread is."""
    return neighbors(messages, ["thread_id"], order, ["message_id", "inbound"], "turn_no").drop(
        "next_message_id", "next_inbound")


def orphans(messages: DataFrame) -> DataFrame:
    """Replies whose parent is not in the table."""
    replies = messages.filter("parent_id IS NOT NULL")
    known = messages.select(F.col("message_id").alias("parent_id"), F.lit(True).alias("_known"))
    return lookup_join(replies, known, "parent_id").filter("_known IS NULL").select("message_id", "parent_id")


def branch_points(edges: DataFrame, parent: str = "parent") -> DataFrame:
    """Messages with more than one reply."""
    return (
        edges.filter(F.col(parent).isNotNull()).groupBy(parent)
        .agg(F.count(F.lit(1)).alias("replies")).filter("replies > 1")
    )


def thread_stats(messages: DataFrame, at: str) -> DataFrame:
    """Turns by side, and how long the first agent answer took after the customer's first message.

    ``at`` is a number that grows with time. The first customer position per thread comes from one aggregate
    and is looked up by every message, hot threads apart.
    """
    opened = written(messages.filter("inbound").groupBy("thread_id").agg(F.min(at).alias("_opened")), "opened")
    rows = messages.select("thread_id", "inbound", at)
    seen = lookup_join(rows, opened, "thread_id")
    answer = F.min(F.when(~F.col("inbound") & (F.col(at) > F.col("_opened")), F.col(at)))
    return seen.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(F.col("inbound")).alias("customer_turns"),
        F.count_if(~F.col("inbound")).alias("agent_turns"),
        (answer - F.min("_opened")).alias("first_response_gap"),
    )


Labeler = Callable[[pd.DataFrame], pd.DataFrame]

LABELS = "escalated int, category string, reason string"


def label_threads(threads: DataFrame, labeler: Labeler, schema: str | None = None) -> DataFrame:
    """Label threads with a caller's function, batch by batch in every task.

    ``labeler`` sees (thread_id, first_customer_text) only, as a live system would, and returns the columns
    of ``schema``; unless one is given, ``thread_id`` keeps the type that it has in ``threads``.
    """
    schema = schema or f"thread_id {threads.schema['thread_id'].dataType.simpleString()}, {LABELS}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield labeler(batch)

    return threads.select("thread_id", "first_customer_text").mapInPandas(run, schema)


def validate_labels(df: DataFrame, categories: tuple[str, ...] = ESCALATION_INTENTS) -> DataFrame:
    """Rows breaking a rule of the label scheme, with the rule they break."""
    escalated, category = F.col("escalated"), F.col("category")
    known = F.coalesce(category.isin(*categories), F.lit(False))
    rule = (
        F.when(escalated.isNull() | ~escalated.isin(0, 1), "escalated_not_binary")
        .when((escalated == 1) & ~known, "escalated_without_category")
        .when((escalated == 0) & ~F.coalesce(category == SELF_SERVICE, F.lit(False)), "self_service_with_category")
        .when(F.trim(F.coalesce(F.col("reason"), F.lit(""))) == "", "reason_missing")
    )
    return df.withColumn("violation", rule).filter("violation IS NOT NULL")
