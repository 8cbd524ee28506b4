import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from caselane.functions.taxonomy import COARSE_GRID, FINE_GRID
from caselane.operators import audit, compare, curves, evaluate, profile

# tn, fp, fn, tp, accuracy, macro precision, macro recall, macro F1
GOLDEN = [
    (3549, 5, 5, 1368, 0.9980, 0.9975, 0.9975, 0.9975),
    (553, 141, 95, 211, 0.7640, 0.7264, 0.7432, 0.7327),
    (2736, 735, 963, 566, 0.6604, 0.5874, 0.5792, 0.5816),
    (3195, 276, 1208, 321, 0.7032, 0.6317, 0.5652, 0.5568),
    (630, 64, 111, 195, 0.8250, 0.8015, 0.7725, 0.7842),
]


@pytest.mark.parametrize("tn,fp,fn,tp,acc,p,r,f1", GOLDEN)
def test_published_matrices(spark, tn, fp, fn, tp, acc, p, r, f1):
    counts = spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")
    m = evaluate.metrics_of(counts, []).first()
    got = [round(m[k], 4) for k in ("accuracy", "precision_macro", "recall_macro", "f1_macro")]
    assert got == [acc, p, r, f1]


def test_published_escalated_metrics(spark):
    m = evaluate.metrics_of(spark.createDataFrame([(608, 86, 90, 216)], "tn long, fp long, fn long, tp long"), []).first()
    assert (round(m.precision_escalated, 4), round(m.recall_escalated, 4), round(m.f1_macro, 4)) == (0.7152, 0.7059, 0.7920)


def test_published_seed_summary(spark):
    runs = spark.createDataFrame([("u", 0.7842), ("u", 0.7967), ("u", 0.8097)], "encoder string, macro_f1 double")
    row = compare.seed_summary(runs).first()
    assert (round(row["mean"], 4), round(row["std"], 4)) == (0.7969, 0.0128)


def test_published_gaps(spark):
    cells = [("base", "ceiling", 0.9975), ("base", "cross", 0.5816), ("base", "inside", 0.7327),
             ("other", "ceiling", 0.9980), ("other", "cross", 0.5568), ("other", "inside", 0.7969)]
    runs = spark.createDataFrame(cells, "model string, setting string, f1_macro double")
    matrix = compare.design_matrix(runs, ["ceiling", "cross", "inside"], "inside", "cross")
    row = compare.gap_decomposition(matrix, "base", "other", "ceiling", "cross", "inside").first()
    assert [round(x, 4) for x in row] == [0.0642, -0.0248, 0.1511, 0.2401, 0.7969, 0.2006]


def scored(spark, n=3000, levels=40, seed=1):
    rng = random.Random(seed)
    rows = [(i, int(rng.random() < 0.3), rng.randrange(levels) / levels, rng.choice("xy")) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y_true int, y_prob double, model string"), rows


def brute_auc(rows):
    pos, neg = [r[2] for r in rows if r[1] == 1], [r[2] for r in rows if r[1] == 0]
    won = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return won / (len(pos) * len(neg))


def test_auc_is_exact_under_ties(spark):
    df, rows = scored(spark)
    got = {r.model: r.roc_auc for r in curves.roc_auc(df, ("model",)).collect()}
    for m in "xy":
        assert got[m] == pytest.approx(brute_auc([r for r in rows if r[3] == m]), abs=1e-12)
    ml = BinaryClassificationEvaluator(rawPredictionCol="y_prob", labelCol="y_true", numBins=0)
    assert curves.roc_auc(df).first().roc_auc == pytest.approx(ml.evaluate(df.withColumn("y_true", F.col("y_true").cast("double"))), abs=1e-12)


def test_auc_only_reads_the_order(spark):
    df, _ = scored(spark)
    base = curves.roc_auc(df).first().roc_auc
    bent = df.withColumn("y_prob", F.pow("y_prob", 3) / 7 + 1)
    assert curves.roc_auc(bent.repartition(13, "y_prob")).first().roc_auc == pytest.approx(base, abs=1e-12)


def test_one_class_and_empty(spark):
    df, _ = scored(spark, 50)
    assert curves.roc_auc(df.filter("y_true = 0")).first().roc_auc is None
    empty = evaluate.binary_metrics(df.filter("id < 0")).first()
    assert empty.roc_auc is None and empty.tn == 0 and empty.f1_macro == 0 and empty.accuracy is None
    one = evaluate.binary_metrics(df.filter("y_true = 0")).first()
    assert one.f1_escalated == 0 and one.fn + one.tp == 0


def test_all_scores_tied(spark):
    df, _ = scored(spark, 200, 1)
    assert curves.roc_auc(df).first().roc_auc == 0.5
    assert curves.roc_curve(df).collect()[0][:] == (0.0, 1.0, 1.0)


def test_exactly_half_is_escalated(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.4999999)], "id long, y_true int, y_prob double")
    assert [r.y_pred for r in evaluate.with_pred(df).orderBy("id").collect()] == [1, 0]


@pytest.mark.parametrize("grid", [COARSE_GRID, FINE_GRID])
def test_sweep_against_brute_force(spark, grid):
    df, rows = scored(spark, 400, 100)
    got = {r.threshold: (r.missed_escalations, r.false_alarms) for r in curves.threshold_sweep(df, grid).collect()}
    assert len(got) == len(grid)
    for t in grid:
        assert got[t] == (sum(r[1] == 1 and r[2] < t for r in rows), sum(r[1] == 0 and r[2] >= t for r in rows))


def test_sweep_at_half_equals_the_metrics(spark):
    df, _ = scored(spark)
    at_half = curves.threshold_sweep(df, COARSE_GRID).filter("threshold = 0.5").first()
    m = evaluate.binary_metrics(df).first()
    assert (at_half.macro_f1, at_half.missed_escalations, at_half.false_alarms) == (m.f1_macro, m.fn, m.fp)


def test_sweep_keeps_cut_offs_nothing_reaches(spark):
    df = spark.createDataFrame([(1, 1, 0.05), (2, 0, 0.01)], "id long, y_true int, y_prob double")
    out = curves.threshold_sweep(df, COARSE_GRID).collect()
    assert len(out) == 13 and all(r.missed_escalations == 1 and r.pct_routed_to_agent == 0 for r in out)


def test_best_threshold_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.1)], "id long, y_true int, y_prob double")
    row = curves.best_threshold(df, FINE_GRID).first()
    assert row.best_threshold == 0.105 and row.best_macro_f1 == 1.0


def test_report_and_errors(spark):
    df, rows = scored(spark)
    pred = evaluate.with_pred(df)
    report = {r.label: r for r in evaluate.classification_report(pred).collect()}
    assert report["0"].support + report["1"].support == report["macro avg"].support == len(rows)
    errors = evaluate.error_counts(pred).first()
    assert errors.escalations == report["1"].support
    assert evaluate.specificity(pred).first().specificity == pytest.approx(report["0"].recall)


def test_kappa(spark):
    rows = [(0, 0)] * 20 + [(0, 1)] * 5 + [(1, 0)] * 10 + [(1, 1)] * 15
    out = audit.agreement(spark.createDataFrame(rows, "escalated int, human_escalated int")).first()
    assert out.kappa == pytest.approx(0.4) and out.pct_agreement == pytest.approx(70)
    sure = audit.agreement(spark.createDataFrame([(1, 1)], "escalated int, human_escalated int")).first()
    assert sure.kappa is None


def test_histogram_covers_every_row(spark):
    df, rows = scored(spark)
    for common in (True, False):
        out = profile.histogram(df, "y_prob", "model", bins=7, common_range=common)
        assert out.agg(F.sum("n")).first()[0] == len(rows)
        assert out.agg(F.max("bin")).first()[0] == 6
    flat = profile.histogram(df.withColumn("y_prob", F.lit(2.0)), "y_prob", "model", bins=4).collect()
    assert len(flat) == 2 and all(r.left == 2.0 for r in flat)
