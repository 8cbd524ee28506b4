"""NN-descent against all pairs."""

import numpy as np
import pytest

from caselane.llm import nndescent

SCHEMA = "vec_id long, embedding array<float>, label int, node string, root string, copies string"


def expected(rows, threshold=0.93):
    out = {}
    able = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: [] for k in range(len(rows))}
    unit = {}
    for k in able:
        v = np.asarray(np.asarray(rows[k][1], np.float32), np.float64)
        v = v / np.abs(v).max()
        unit[k] = v / np.linalg.norm(v)
    for a in able:
        for b in able:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a].append(b)
                links[b].append(a)
    for k in range(len(rows)):
        seen, waiting = {k}, [k]
        while waiting:
            new = [j for j in links[waiting.pop()] if j not in seen]
            seen.update(new)
            waiting += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.setdefault((rows[k][0], len(links[k]), least, rows[k][0] is not None and rows[k][0] == least), []).append(k)
    return sorted((repr(key), len(v)) for key, v in out.items())


def listed(df):
    found = {}
    for r in df.collect():
        found.setdefault((r.vec_id, r.n_links, r.component_id, r.kept), []).append(1)
    return sorted((repr(key), len(v)) for key, v in found.items())


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "n", "r", "c") for i, v, l in rows], SCHEMA)


def around(rng, center, angle, n):
    """Vectors at about the given angle to a center."""
    noise = rng.standard_normal((n, len(center)))
    noise -= np.outer(noise @ center, center)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return np.cos(angle) * center + np.sin(angle) * noise


def planted(seed, size=32):
    """Noise, pairs, copies, a large group, groups of near-equal vectors that are linked to each other, and a chain."""
    rng = np.random.default_rng(seed)
    units = rng.standard_normal((900, size))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    rows = [(v, k % 2) for k, v in enumerate(units)]
    rows += [(v, k % 2) for k in range(30) for v in around(rng, units[k], 0.2, 1)]
    rows += [(v, 0) for v in around(rng, units[100], 0.3, 250)]
    rows += [(v, 1) for c in around(rng, units[101], 0.2, 6) for v in around(rng, c / np.linalg.norm(c), 0.003, 40)]
    a, b = units[102], around(rng, units[102], np.pi / 2, 1)[0]
    rows += [(np.cos(t) * a + np.sin(t) * b, 0) for t in np.arange(0, 3, 0.09)]
    rows += [rows[k] for k in range(40)] * 2
    order = rng.permutation(len(rows))
    return [(int(k), [float(np.float32(x)) for x in rows[at][0]], rows[at][1]) for k, at in enumerate(order)]


@pytest.mark.parametrize("seed", [1, 2])
def test_planted(spark, seed):
    rows = planted(seed)
    assert listed(nndescent.report(table(spark, rows))) == expected(rows)


def test_settling_in_blocks(spark):
    """Small blocks: pairs of blocks that the angles settle either way, and those that are compared."""
    rows = planted(3)
    df = table(spark, rows)
    vectors = nndescent.folded(df.selectExpr("label", "CAST(embedding AS array<double>) AS vector"))
    one = vectors.filter("label = 0").selectExpr("0L AS root", "node", "copies", "exact")
    got = {r.node: r.links for r in nndescent.settle(one, 0.93, block=16).collect()}
    units = [(r.node, r.copies, np.frombuffer(bytes(r.exact))) for r in one.collect()]
    m = np.array([u for _, _, u in units])
    linked = m @ m.T >= 0.93
    np.fill_diagonal(linked, False)
    want = dict(zip([n for n, _, _ in units], (linked @ np.array([c for _, c, _ in units])).tolist()))
    assert got == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.01], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [], 0),
            (7, [0.0, 0.0], 0), (8, [0.0, 0.0], 0), (9, [nan, 1.0], 0), (10, [nan, 1.0], 0), (11, [inf, 1.0], 0), (12, [None, 1.0], 0),
            (None, [3.0, 0.1], 0), (None, [0.0, 5.0], 0), (None, [0.0, 5.0], 0), (13, [1.0, 0.0, 0.0], 0), (14, [1.0, 0.1, 0.0], 0),
            (15, [3e38, 1.0], 0), (16, [1e-44, 0.0], 0), (17, [-1.0, -0.0], 0), (18, [0.0, 1.0], 1), (18, [1.0, 0.0], 1)]
    assert listed(nndescent.report(table(spark, rows))) == expected(rows)
    assert nndescent.report(table(spark, rows).limit(0)).collect() == []


def test_bound_and_hubs(spark):
    """Cosines close to the threshold are told apart in double precision; a vector listed by all others keeps its blocks small."""
    rng = np.random.default_rng(5)
    center = np.eye(48)[0]
    at = np.arccos(0.93)
    ring = [around(rng, center, at + d, 1)[0] for d in np.linspace(-2e-4, 2e-4, 41) for _ in range(8)]
    rows = [(k, [float(np.float32(x)) for x in v], 7) for k, v in enumerate([center, *ring])]
    assert listed(nndescent.report(table(spark, rows))) == expected(rows)


def test_recall_is_measured(spark):
    rows = planted(4)
    vectors = nndescent.folded(table(spark, rows).selectExpr("label", "CAST(embedding AS array<double>) AS vector"))
    apart = vectors.selectExpr("*", "node AS root")
    assert nndescent.recall(apart, 0.93, 5000) == 0.0
    assert nndescent.recall(vectors.selectExpr("*", "0L AS root"), 0.93, 5000) == 1.0
