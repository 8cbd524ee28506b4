import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from caselane.operators import classify, ngrams
from caselane.plans.language import training
from caselane.sources import readers
from caselane.sources.views import Views

STOP = ["the", "of"]


@pytest.fixture(scope="module")
def rows(spark, folder):
    return training(Views(spark, folder)).select("thread_id", "text", "escalated").cache()


@pytest.fixture(scope="module")
def model(rows):
    return classify.fit(rows, "thread_id", "text", "escalated", stop=STOP, size=400)


def test_vectors_equal_long_form(rows):
    features = classify.fit_features(rows, "thread_id", "text", STOP, 400)
    names = next(s for s in features.stages if type(s).__name__ == "CountVectorizerModel").vocabulary
    dense = classify.featurize(features, rows).select("thread_id", vector_to_array("features").alias("v")).collect()
    vector = {(r.thread_id, names[i]): x for r in dense for i, x in enumerate(r.v) if x}
    long = {(r.thread_id, r.term): r.weight for r in ngrams.tfidf(rows, "thread_id", "text", STOP, 400).collect()}
    assert vector.keys() == long.keys()
    assert max(abs(vector[k] - long[k]) for k in long) < 1e-12


def test_weights_by_hand(spark):
    df = spark.createDataFrame([(1, "cat cat dog"), (2, "dog")], "id long, t string")
    got = {(r.id, r.term): r.weight for r in ngrams.tfidf(df, "id", "t", [], 10).collect()}
    idf = math.log(3 / 2) + 1
    raw = {"cat": (1 + math.log(2)) * idf, "dog": 1.0, "cat cat": idf, "cat dog": idf}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert got == pytest.approx({**{(1, t): x / norm for t, x in raw.items()}, (2, "dog"): 1.0})


def test_vocabulary_cut_breaks_ties_by_term(spark):
    df = spark.createDataFrame([(1, "bb aa cc")], "id long, t string")
    assert [r.term for r in ngrams.vocabulary(df, "id", "t", [], 3).collect()] == sorted(["bb", "aa", "cc", "bb aa", "aa cc"])[:3]


def test_fit_reaches_the_optimum(rows, model):
    """The gradient of the weighted, penalised loss vanishes at the fitted coefficients."""
    linear = model.stages[-1]
    data = classify.featurize(
        classify.PipelineModel(model.stages[:-1]), rows).select(vector_to_array("features").alias("v"), "escalated").collect()
    x, y = np.array([r.v for r in data]), np.array([r.escalated for r in data])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-(x @ linear.coefficients.toArray() + linear.intercept)))
    gradient = x.T @ (w * (p - y)) + linear.coefficients.toArray()
    assert np.abs(gradient).max() < 1e-6 and abs((w * (p - y)).sum()) < 1e-6


def test_fit_equals_the_library(rows, model):
    """Spark's own solver stops early; it is as far from this fit as from its optimum."""
    linear = model.stages[-1]
    data = classify.featurize(classify.PipelineModel(model.stages[:-1]), rows)
    sizes = {r.label: r for r in ngrams.class_weights(data).collect()}
    weighted = data.withColumn("w", F.when(F.col("escalated") == 1, sizes[1].weight).otherwise(sizes[0].weight))
    other = LogisticRegression(labelCol="escalated", weightCol="w", regParam=1 / data.count(), standardization=False, tol=1e-12, maxIter=500).fit(weighted)
    assert np.abs(other.coefficients.toArray() - linear.coefficients.toArray()).max() < 1e-4
    assert abs(other.intercept - linear.intercept) < 1e-4


def test_table_scores_equal_the_model(spark, rows, model):
    table, intercept = classify.model_table(spark, model)
    blank = spark.createDataFrame([(-1, "", 0), (-2, None, 0)], rows.schema)
    everything = rows.unionByName(blank)
    flat = {r.thread_id: r.y_prob for r in ngrams.table_score(
        everything, table, "thread_id", "text", STOP, intercept).collect()}
    ml = {r.thread_id: r.y_prob for r in classify.score(model, everything.na.fill({"text": ""})).collect()}
    assert flat.keys() == ml.keys()
    assert max(abs(flat[k] - ml[k]) for k in ml) < 1e-9


def test_save_and_load(rows, model, tmp_path):
    back = readers.load_model(readers.save_model(model, str(tmp_path / "m")))
    a = classify.score(model, rows).orderBy("thread_id").collect()
    assert a == classify.score(back, rows).orderBy("thread_id").collect()


def test_score_with_loads_once_per_task_and_keeps_all_rows(spark):
    df = spark.range(1000).select("id", F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("t")).repartition(4)

    def make():
        calls = []

        def scorer(texts):
            calls.append(1)
            return [len(t) / 10 for t in texts]

        return scorer

    got = {r.id: r.y_prob for r in classify.score_with(df, make, "id", "t").collect()}
    assert got == {i: (i % 7) / 10 for i in range(1000)}
    assert classify.score_with(df.filter("id < 0"), make, "id", "t").collect() == []


def test_selection_marks_the_first_best(rows):
    out = classify.select_on_validation(rows, "thread_id", "text", "escalated", [1.0, 1.0001], stop=STOP, size=200)
    picked = [r.setting for r in out.filter("selected = 1").collect()]
    best = max(r.f1_macro for r in out.collect())
    assert picked == [min(r.setting for r in out.collect() if r.f1_macro == best)]


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "escalated int")
    assert [r.weight for r in ngrams.class_weights(df).collect()] == [4 / 6, 4 / 2]
    none = ngrams.class_weights(df.filter("escalated = 0")).collect()
    assert [r.weight for r in none] == [0.5, 1.5]


def test_experiments_evaluate_every_held_out_row(rows):
    n, seeds, shares = rows.count(), [42, 7], {"half": 0.5, "all": 1.0}
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    by_seed = classify.seed_runs(rows, "thread_id", "text", "escalated", seeds, stop=STOP, size=100)
    assert {r.seed: r.n for r in by_seed.select("seed", total.alias("n")).collect()} == dict.fromkeys(seeds, math.ceil(n / 5))
    curve = classify.learning_curve(rows, "thread_id", "text", "escalated", shares, stop=STOP, size=100)
    assert {r.size_name: r.n for r in curve.select("size_name", total.alias("n")).collect()} == dict.fromkeys(
        shares, math.ceil(n / 5))
    # All training rows of the curve is the same fit as the same seed's run.
    a = by_seed.filter("seed = 42").drop("seed").first()
    assert a == curve.filter("size_name = 'all'").drop("size_name").first()


def test_cross_domain_fits_nothing_again(spark, folder, model):
    every = training(Views(spark, folder))
    out = classify.evaluate(model, every, "escalated", ("lang",))
    want = {r.lang: r["count"] for r in every.groupBy("lang").count().collect()}
    assert {r.lang: r.tn + r.fp + r.fn + r.tp for r in out.collect()} == want
