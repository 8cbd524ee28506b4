"""The most frequent items from bounded summaries against counting everything."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from caselane.operators import heavy


def lists(seed, rows, words, slope):
    rng = random.Random(seed)
    return [[f"w{min(int(rng.paretovariate(slope)), words)}" for _ in range(rng.randint(0, 30))] for _ in range(rows)] + [[], None]


def want(rows, size):
    n, df = Counter(), Counter()
    for r in rows:
        n.update(r or [])
        df.update(set(r or []))
    return [(t, n[t], df[t]) for t in sorted(n, key=lambda t: (-n[t], t))[:size]]


def listed(df):
    return [(r.term, r.n, r.df) for r in df.collect()]


def table(spark, rows, parts):
    return spark.createDataFrame([(r,) for r in rows], "_terms array<string>").repartition(parts)


@pytest.mark.parametrize("kept", [40, 200, 100_000])
def test_equal_to_counting_all(spark, monkeypatch, kept):
    """Summaries that forget much, little and nothing."""
    monkeypatch.setattr(heavy, "ITEMS", 500)
    rows = lists(1, 1500, 3000, 0.7)
    assert listed(heavy.most_frequent(table(spark, rows, 5), 12, kept)) == want(rows, 12)


def test_candidates_are_counted_alone(spark, monkeypatch):
    monkeypatch.setattr(heavy, "ITEMS", 500)
    monkeypatch.setattr(heavy, "all_counts", lambda taken: pytest.fail("everything was counted"))
    rows = lists(2, 3000, 50_000, 0.6)
    df = table(spark, rows, 4)
    found = heavy.summaries(df, 400).collect()
    assert sum(r.off or 0 for r in found) > 0 and len(found) <= 4 * 401
    assert listed(heavy.most_frequent(df, 8, 400)) == want(rows, 8)


def test_a_flat_tail_falls_back(spark, monkeypatch):
    monkeypatch.setattr(heavy, "ITEMS", 100)
    rows = [[f"w{(k * 31 + j) % 900}" for j in range(9)] for k in range(600)]
    seen = []
    whole = heavy.all_counts
    monkeypatch.setattr(heavy, "all_counts", lambda taken: seen.append(1) or whole(taken))
    assert listed(heavy.most_frequent(table(spark, rows, 3), 20, 50)) == want(rows, 20) and seen


def test_fewer_items_than_sought_and_none(spark):
    rows = [["a", "b", "a"], ["b"], None, []]
    assert listed(heavy.most_frequent(table(spark, rows, 2), 10, 100)) == [("a", 2, 1), ("b", 2, 2)]
    assert listed(heavy.most_frequent(table(spark, [None, []], 1), 10, 1)) == []


def test_error_bound():
    """No count is too high, and none is too low by more than what was taken off."""
    rng = random.Random(3)
    n, held, off = Counter(), heavy.row_counts(pa.array([["x"]])), 0
    n["x"] += 1
    for _ in range(60):
        row = [f"w{int(rng.paretovariate(0.8)) % 400}" for _ in range(50)]
        n.update(row)
        held, less = heavy.pruned(heavy.added([held, heavy.row_counts(pa.array([row]))]), 30)
        off += less
        assert len(held) <= 30
    kept = dict(zip(held["term"].to_pylist(), held["n"].to_pylist()))
    assert off > 0 and all(n[t] - off <= kept.get(t, 0) <= n[t] for t in n)
