"""Exact quantiles against sorted arrays."""

import math

import numpy as np
import pytest

from caselane.operators import profile, quality, quantiles

SHARES = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)


def want(values):
    values = sorted(values, key=lambda v: (math.isnan(v), v))
    out = []
    for p in SHARES:
        a = p * (len(values) - 1)
        low, high = math.floor(a), math.ceil(a)
        out.append(values[low] if low == high else (high - a) * values[low] + (a - low) * values[high])
    return out


def check(spark, groups):
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = {r.g: r.quantiles for r in quantiles.exact_quantiles(df, ["g"], "x", SHARES).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert repr(got[g]) == repr(want([float(v) for v in values])), g


@pytest.mark.parametrize("buckets", [2, 7, 4096])
def test_groups(spark, monkeypatch, buckets):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    rng = np.random.default_rng(1)
    check(spark, {
        "hot": rng.integers(0, 900, 3000), "one": [5], "ties": [3] * 50 + [4], None: rng.normal(size=41).round(3),
        "two": [1, 2], "negative": -rng.integers(1, 9, 77)})


def test_wide_ranges(spark):
    """Exponents from end to end: the range shrinks by the number of buckets in each round."""
    check(spark, {"wide": [10.0 ** k for k in range(-12, 13)], "huge": [-1.7e308, -1.0, 0.0, 1e-300, 1.7e308], "close": [1.0, 1.0 + 2 ** -52, 1.0 + 2 ** -51]})


def test_values_beyond_numbers(spark):
    nan, inf = math.nan, math.inf
    check(spark, {"a": [1, 2, inf, inf, nan], "b": [nan], "c": [-inf, 3, 4, 5], "d": [-inf, inf], "e": [inf, nan, nan]})


def test_weights_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1.0, 3), (9.0, 1), (None, 50), (4.0, 0)], "x double, w int")
    assert quantiles.exact_quantiles(df, [], "x", [0.5, 1.0], "w").first().quantiles == [1.0, 9.0]
    assert quantiles.exact_quantiles(df.filter("x IS NULL"), [], "x", [0.5]).collect() == []
    empty = quality.describe(df.filter("x > 100"), "x").first()
    assert (empty.n, empty.q50, empty["max"]) == (0, None, None)


def test_users_agree_with_the_library(spark):
    df = spark.range(5000).selectExpr("id % 3 AS g", "CAST(pmod(hash(id), 1777) AS INT) AS x")
    got = {r.g: (r.q1, r.median, r.q3) for r in profile.box_stats(df, "x", ["g"]).collect()}
    for r in df.groupBy("g").agg({"x": "count"}).collect():
        q = df.filter(f"g = {r.g}").selectExpr("percentile(x, array(0.25, 0.5, 0.75)) AS q").first().q
        assert got[r.g] == tuple(q)
