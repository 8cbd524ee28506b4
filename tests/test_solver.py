"""The shared-pass optimiser against Newton steps on dense matrices."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from caselane.operators import solver
from caselane.operators.solver import Arm


def texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        y = k % 3 == 0
        words = [f"w{int(rng.expovariate(0.15 if y else 0.1))}" for _ in range(rng.randint(0, 25))] + (["refund"] if y and rng.random() < 0.7 else [])
        out.append((k, words + [f"{a} {b}" for a, b in zip(words, words[1:])], int(y), int(k % 5 != 0), int(k % 7 < 3)))
    return out


SHAPE = "id long, _terms array<string>, y int, most int, some int"


def newton(rows, arm, size):
    """The optimum in the arm's own features: terms, coefficients, intercept."""
    member = {"most": 3, "some": 4}[arm.member]
    train = [r for r in rows if r[member]]
    n, df = Counter(), Counter()
    for r in train:
        terms = [t for t in r[1] if arm.pairs or " " not in t]
        n.update(terms)
        df.update(set(terms))
    names = sorted(n, key=lambda t: (-n[t], t))[:size]
    idf = np.array([math.log((len(train) + 1) / (df[t] + 1)) + 1 for t in names])

    def features(r):
        counts = Counter(r[1])
        x = np.array([(1 + math.log(counts[t])) if counts[t] else 0.0 for t in names]) * idf
        return x / np.linalg.norm(x) if x.any() else x

    x, y = np.array([features(r) for r in train]), np.array([r[2] for r in train])
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(len(names) + 1), np.array([1 / arm.c] * len(names) + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x1 @ w))
        step = np.linalg.solve((x1 * (s * p * (1 - p))[:, None]).T @ x1 + np.diag(penalty + 1e-12), x1.T @ (s * (p - y)) + penalty * w)
        w -= step
    every = np.array([features(r) for r in rows])
    return names, w[:-1], w[-1], 1 / (1 + np.exp(-(every @ w[:-1] + w[-1])))


ARMS = [Arm("a", "most", 0.1), Arm("b", "most", 1.0), Arm("c", "most", 10.0), Arm("d", "most", 1.0, False), Arm("e", "some", 1.0), Arm("f", "some", 10.0, False)]


@pytest.fixture(scope="module")
def rows():
    return texts(400)


@pytest.mark.parametrize("few", [True, False])
def test_every_arm_reaches_its_optimum(spark, rows, monkeypatch, few):
    """With the whole second derivatives and with those along the axes."""
    if not few:
        monkeypatch.setattr(solver, "FEW_ROWS", 10)
    problem = solver.prepare(spark.createDataFrame(rows, SHAPE).repartition(5), "id", "y", ARMS, 300)
    fits = solver.solve(problem)
    scores = {(r.arm, r.id): r.y_prob for r in solver.score(problem, fits).collect()}
    for arm, fit in zip(ARMS, fits):
        names, w, b, p = newton(rows, arm, 300)
        assert fit.terms == names and fit.arm == arm
        assert np.abs(fit.coefficients - w).max() < 1e-6 and abs(fit.intercept - b) < 1e-6
        assert max(abs(scores[arm.name, r[0]] - q) for r, q in zip(rows, p)) < 1e-6


def test_arms_share_their_passes(spark, rows, monkeypatch):
    """Six arms take the passes of the slowest, not of all; each takes the same steps as alone."""
    passes = []
    whole = solver.summed
    monkeypatch.setattr(solver, "summed", lambda *a: passes.append(1) or whole(*a))
    df = spark.createDataFrame(rows, SHAPE)
    fits = solver.solve(solver.prepare(df, "id", "y", ARMS, 300))
    shared = len(passes)
    assert shared == max(f.passes for f in fits) < 40
    alone = solver.solve(solver.prepare(df, "id", "y", ARMS[2:3], 300))[0]
    assert np.abs(alone.coefficients - fits[2].coefficients).max() < 1e-6 and len(passes) - shared == alone.passes


def test_sums_in_a_tree(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SHAPE).repartition(9)
    problem = solver.prepare(df, "id", "y", ARMS[1:2], 300)
    problem = solver.Problem(**{**problem.__dict__, "blocks": problem.blocks.repartition(9)})
    flat = solver.evaluate(problem, [0], np.full((1, len(problem.terms) + 1), 0.1))
    monkeypatch.setattr(solver, "TREE", 2)
    tree = solver.evaluate(problem, [0], np.full((1, len(problem.terms) + 1), 0.1))
    assert np.allclose(flat[0], tree[0]) and np.allclose(flat[1], tree[1])


def test_one_class_and_empty_texts(spark):
    rows = [(k, [], 0, 1, 1) for k in range(4)] + [(9, ["x"], 0, 1, 0)]
    problem = solver.prepare(spark.createDataFrame(rows, SHAPE), "id", "y", [Arm("a", "most"), Arm("b", "some")], 10)
    fits = solver.solve(problem, most=50)
    assert fits[1].terms == [] and all(r.y_prob < 0.01 for r in solver.score(problem, fits).collect())


def test_blocks_are_bounded(spark, rows, monkeypatch):
    monkeypatch.setattr(solver, "BLOCK_ROWS", 7)
    monkeypatch.setattr(solver, "BLOCK_COUNTS", 60)
    df = spark.createDataFrame(rows, SHAPE).coalesce(1)
    problem = solver.prepare(df, "id", "y", ARMS[1:2], 300)
    sizes = problem.blocks.selectExpr("size(ids) AS n", "length(value) / 8 AS counts").collect()
    assert sum(s.n for s in sizes) == len(rows) and max(s.n for s in sizes) <= 7 and all(s.counts <= 60 or s.n == 1 for s in sizes)
    names, w, b, _ = newton(rows, ARMS[1], 300)
    assert np.abs(solver.solve(problem)[0].coefficients - w).max() < 1e-6


@pytest.mark.parametrize("items", [1 << 20, 9])
def test_words_are_packed_as_their_terms(spark, rows, monkeypatch, items):
    """Words whose pairs are terms give the blocks that lists of terms give; a count that needs more than a byte is whole."""
    from caselane.operators import heavy

    monkeypatch.setattr(heavy, "ITEMS", items)
    words = [(r[0], [t for t in r[1] if " " not in t], *r[2:]) for r in rows] + [(5000, ["much"] * 300, 1, 1, 0)]
    terms = [*rows, (5000, ["much"] * 300 + ["much much"] * 299, 1, 1, 0)]

    def table(some, column):
        problem = solver.prepare(spark.createDataFrame(some, SHAPE.replace("_terms", column)).repartition(3), "id", "y", ARMS, 300)
        found = {}
        for batch in problem.blocks.toArrow().to_batches():
            for at in range(len(batch)):
                block = solver.Block(batch, at, len(problem.members), problem.scale.shape[1])
                for k, i in enumerate(batch.column("ids")[at].as_py()):
                    mine = block.row == k
                    found[i] = ([problem.terms[t] for t in block.index[mine]], block.value[mine].tolist(), block.labels[k], block.members[k].tolist(), block.shrink[k].tolist())
        return problem, found

    by_words, packed = table(words, "_words")
    by_terms, same = table(terms, "_terms")
    assert by_words.terms == by_terms.terms and by_words.vocabularies == by_terms.vocabularies and np.array_equal(by_words.scale, by_terms.scale)
    assert packed == same and len(packed) == 401
    assert dict(zip(*packed[5000][:2])) == {"much": 1 + np.log(300), "much much": 1 + np.log(299)}


def test_blocks_hold_few_bytes_a_count(spark, rows):
    """Passes are bound by what they read: a place takes two bytes here and a count one."""
    problem = solver.prepare(spark.createDataFrame(rows, SHAPE), "id", "y", ARMS, 300)
    taken = problem.blocks.selectExpr("sum(length(index) + length(value)) AS bytes").first().bytes
    counts = sum(len(set(r[1]) & set(problem.terms)) for r in rows)
    assert taken <= 3 * counts


def test_second_derivatives_along_the_axes_are_renewed(spark, monkeypatch):
    """They differ much at the optimum from those at 0, and steps that start from them are fewer."""
    some = texts(1500, seed=3)
    problem = solver.prepare(spark.createDataFrame(some, SHAPE), "id", "y", [Arm("a", "most", 100.0)], 300)
    monkeypatch.setattr(solver, "FEW_ROWS", 10)
    fit = solver.solve(problem)[0]
    names, w, b, _ = newton(some, problem.arms[0], 300)
    assert fit.terms == names and np.abs(fit.coefficients - w).max() < 1e-6
    point = np.zeros((1, len(problem.terms) + 1))
    for term, c in zip(fit.terms, fit.coefficients):
        point[0, problem.terms.index(term)] = c
    point[0, -1] = fit.intercept
    step, along = 1e-4, solver.curvatures(problem, [0], point)[0]
    for axis in (0, 7, len(problem.terms)):
        ahead, back = point.copy(), point.copy()
        ahead[0, axis] += step
        back[0, axis] -= step
        slope = (solver.evaluate(problem, [0], ahead)[1] - solver.evaluate(problem, [0], back)[1])[0, axis] / (2 * step)
        assert abs(slope + (axis < len(problem.terms)) / 100.0 - along[axis]) < 1e-4 * along[axis]
    monkeypatch.setattr(solver, "RENEW", 10_000)
    assert fit.passes < solver.solve(problem)[0].passes
