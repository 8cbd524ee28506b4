import hashlib
import random
from math import ceil

import pytest
from pyspark.sql import functions as F

from caselane.operators import ordered, split


def hot_rows(spark, n=600):
    """A third of the rows share one key."""
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}", rng.randrange(9)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, k string, v long").repartition(5, "id"), rows


def test_running_sums_equal_a_plain_loop(spark):
    df, rows = hot_rows(spark)
    rows = [(i, None if k == "k1" else k, v) for i, k, v in rows]
    df = df.withColumn("k", F.when(F.col("k") != "k1", F.col("k")))
    out = ordered.running_sums(df, ["k"], ["id"], {"run": F.col("v"), "pos": F.lit(1)}, {"run": "total"})
    got = {r.id: (r.run, r.pos, r.total) for r in out.collect()}
    seen, count = {}, {}
    totals = {}
    for _, k, v in rows:
        totals[k] = totals.get(k, 0) + v
    for i, k, v in rows:
        seen[k], count[k] = seen.get(k, 0) + v, count.get(k, 0) + 1
        assert got[i] == (seen[k], count[k], totals[k])


def test_a_hot_key_spans_partitions(spark):
    df, _ = hot_rows(spark, 20_000)
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        laid = ordered.lay_out(df, ["k"], ["id"])
        assert laid.filter("k = 'hot'").select(ordered.PART).distinct().count() > 1
        out = ordered.neighbors(df, ["k"], ["id"], ["id"], "no")
        hot = [r for r in out.filter("k = 'hot'").orderBy("id").collect()]
        ids = [r.id for r in hot]
        assert [r.prev_id for r in hot] == [None, *ids[:-1]]
        assert [r.next_id for r in hot] == [*ids[1:], None]
        assert [r.no for r in hot] == list(range(1, len(ids) + 1))
    finally:
        spark.conf.set(conf, "true")


@pytest.mark.parametrize("share", [10, 10**9])
def test_lookup_join_with_hot_and_null_keys(spark, monkeypatch, share):
    monkeypatch.setattr(ordered, "HOT_SHARE", share)
    df, rows = hot_rows(spark)
    df = df.withColumn("k", F.when(F.col("v") > 0, F.col("k")))
    lookup = spark.createDataFrame([("hot", 1), *[(f"k{j}", j) for j in range(0, 40, 2)]], "k string, w int")
    got = {r.id: r.w for r in ordered.lookup_join(df, lookup, "k").collect()}
    table = {"hot": 1, **{f"k{j}": j for j in range(0, 40, 2)}}
    assert got == {i: table.get(k) if v > 0 else None for i, k, v in rows}


def quota_by_rule(counts, fraction):
    n = sum(counts.values())
    part = ceil(round(fraction * n, 9))
    whole = {k: part * c // n for k, c in counts.items()}
    left = sorted(counts, key=lambda k: (-(part * counts[k] % n), k))
    for k in left[: part - sum(whole.values())]:
        whole[k] += 1
    return whole


def test_stratified_split_equals_the_rule(spark):
    rng = random.Random(5)
    rows = [(i, int(rng.random() < 0.28)) for i in range(2463)]
    df = spark.createDataFrame(rows, "row_id long, y int")
    got = {r.row_id for r in split.stratified_split(df, "y", "row_id").filter("split = 'test'").collect()}
    want = set()
    counts = {k: sum(y == k for _, y in rows) for k in (0, 1)}
    for k, q in quota_by_rule(counts, 0.2).items():
        mine = sorted((hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for i, y in rows if y == k)
        want |= {i for _, i in mine[:q]}
    assert got == want and len(got) == ceil(0.2 * len(rows))
    again = split.stratified_split(df.repartition(7, "y").orderBy(F.rand(1)), "y", "row_id").filter("split = 'test'")
    assert {r.row_id for r in again.collect()} == got


def test_published_split_sizes(spark):
    df = spark.range(24635).select(F.col("id").alias("row_id"), (F.col("id") < 6865).cast("int").alias("y"))
    sizes = {r.split: r.n for r in split.split_rates(split.three_way_split(df, "y", "row_id"), "y").collect()}
    assert sizes == {"train": 17737, "val": 1971, "test": 4927}


def test_three_parts_are_a_partition_and_sizes_nest(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    three = split.three_way_split(df, "y", "row_id")
    assert three.count() == three.select("row_id").distinct().count() == 500
    sizes = split.nested_train_sizes(df, "y", "row_id", {"s": 0.1, "m": 0.5, "l": 1.0})
    sets = {n: {r.row_id for r in sizes.filter(F.col("size_name") == n).collect()} for n in "sml"}
    assert sets["s"] < sets["m"] < sets["l"] and len(sets["l"]) == 500


def test_parity(spark):
    a, b = spark.range(100).toDF("row_id"), spark.range(1, 101).toDF("row_id")
    assert split.split_parity(a, a, "row_id").first()[:] == (100, 100, 0, 0, 1, 1)
    assert split.split_parity(a, b, "row_id").first()[:] == (100, 100, 1, 1, 0, 0)
    rec = spark.createDataFrame([("m", 0.7327)], "model string, f1 double")
    near = spark.createDataFrame([("m", 0.7330)], "model string, f1 double")
    far = spark.createDataFrame([("m", 0.7340)], "model string, f1 double")
    assert split.metric_parity(rec, near, ["model"], "f1").first().parity == 1
    assert split.metric_parity(rec, far, ["model"], "f1").first().parity == 0
