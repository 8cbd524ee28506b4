import random

import pytest

from caselane.operators import ordered, threads

SCHEMA = "message_id long, parent_id long, response_ids array<long>, inbound boolean, text string, seq long"


def messages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_edges_from_both_columns(spark):
    df = messages(spark, [(1, None, [2, 3], True, "a", 0), (2, 1, [], False, "b", 1), (3, None, [], True, "c", 2),
                          (4, 2, [], True, "d", 3), (5, 9, [4], False, "e", 4)])
    got = sorted(tuple(r) for r in threads.reply_edges(df).collect())
    assert got == [(2, 1, 0), (3, 1, 0), (4, 2, 1), (5, 9, 0)]
    roots = {r.message_id: (r.thread_id, r.depth) for r in threads.with_threads(df).collect()}
    assert roots == {1: (1, 0), 2: (1, 1), 3: (1, 1), 4: (1, 2), 5: (5, 0)}
    assert [tuple(r) for r in threads.orphans(df).collect()] == [(5, 9)]


def test_cycles_are_reported_not_looped(spark):
    links = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 5), (5, 3), (6, 3)], "child long, parent long")
    got = {r.message_id: (r.thread_id, r.depth, r.in_cycle) for r in threads.thread_roots(links).collect()}
    assert got[2] == (1, 1, 0) and got[1] == (1, 0, 0)
    assert all(got[k] == (3, None, 1) for k in (3, 4, 5, 6))


def test_two_cycles_are_two_threads(spark):
    rows = [(1, 2), (2, 1), (8, 9), (9, 8), (5, 8), (3, None)]
    df = messages(spark, [(i, p, [], True, f"t{i}", i) for i, p in rows])
    threaded = threads.with_threads(df)
    got = {r.thread_id: r.turn_count for r in threads.assemble_threads(threaded, ["seq", "message_id"]).collect()}
    assert got == {1: 2, 8: 3, 3: 1}


def test_a_deep_chain(spark):
    links = spark.range(10_000).selectExpr("id AS child", "CASE WHEN id > 0 THEN id - 1 END AS parent")
    out = threads.thread_roots(links)
    assert out.filter("thread_id <> 0 OR depth <> message_id OR in_cycle <> 0").count() == 0 and out.count() == 10_000


@pytest.mark.parametrize("share", [20, 1000])
def test_roots_of_chains_stars_and_forests(spark, monkeypatch, share):
    monkeypatch.setattr(ordered, "HOT_SHARE", share)
    rng = random.Random(11)
    parent = {0: None}
    for i in range(1, 40):
        parent[i] = i - 1                       # a chain
    for i in range(40, 160):
        parent[i] = 20                          # a third of all rows answer one message inside it
    for i in range(160, 350):
        parent[i] = None if rng.random() < 0.1 else rng.randrange(0, i)
    want = {}
    for i in parent:
        at, depth = i, 0
        while parent[at] is not None:
            at, depth = parent[at], depth + 1
        want[i] = (at, depth)
    links = spark.createDataFrame(list(parent.items()), "child long, parent long").repartition(6, "child")
    got = {r.message_id: (r.thread_id, r.depth) for r in threads.thread_roots(links).collect()}
    assert got == want


def test_thread_without_customer(spark):
    df = messages(spark, [(1, None, [], False, "hello", 0)]).selectExpr("*", "message_id AS thread_id")
    row = threads.assemble_threads(df, ["seq", "message_id"]).first()
    assert (row.turn_count, row.first_customer_text) == (1, None)
    stats = threads.thread_stats(df, "seq").first()
    assert (stats.turns, stats.customer_turns, stats.agent_turns, stats.first_response_gap) == (1, 0, 1, None)


def test_label_rules(spark):
    rows = [(1, 1, "complaint", "angry"), (2, 1, "self_service", "x"), (3, 0, "complaint", "x"),
            (4, 0, "self_service", " "), (5, 0, "self_service", "faq"), (6, None, "complaint", "x"), (7, 0, None, "x")]
    df = spark.createDataFrame(rows, "thread_id long, escalated int, category string, reason string")
    got = {r.thread_id: r.violation for r in threads.validate_labels(df).collect()}
    assert got == {2: "escalated_without_category", 3: "self_service_with_category", 4: "reason_missing",
                   6: "escalated_not_binary", 7: "self_service_with_category"}
