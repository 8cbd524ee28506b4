"""The n-gram classifier on Spark ML, batch scoring with any model, and the experiments around them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, SQLTransformer, StopWordsRemover,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame, SparkSession, functions as F

from caselane.functions.scores import decide
from caselane.functions.text import WORD
from caselane.operators.evaluate import binary_metrics
from caselane.functions import text as tx
from caselane.operators.ngrams import MAX_FEATURES, count_terms
from caselane.operators.ordered import fill_cores
from caselane.operators.solver import Arm, Fit, prepare, score as score_rows, solve
from caselane.operators.split import nested_train_sizes, stratified_split, three_way_split
from caselane.session import durable, written


@F.arrow_udf(VectorUDT())
def _one_plus_log(vectors: pa.Array) -> pa.Array:
    """Replace the counts inside sparse vectors by ``1 + ln(count)``, a whole batch at a time."""
    parts = vectors.storage if hasattr(vectors, "storage") else vectors
    counts = parts.field("values")
    logged = pa.array(1.0 + np.log(counts.values.to_numpy(zero_copy_only=False)))
    fields = {name: parts.field(name) for name in ("type", "size", "indices")}
    fields["values"] = pa.ListArray.from_arrays(counts.offsets, logged)
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))


class SublinearTf(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Dampen term counts; the one step Spark ML has no stage for."""

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        if inputCol:
            self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), _one_plus_log(F.col(self.getInputCol())))


def default_stopwords() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def term_stages(text: str, stop: list[str]) -> list:
    """Stages giving the same terms as :func:`caselane.operators.ngrams.terms_of`, missing text included."""
    tokens = f"regexp_extract_all(lower(coalesce({text}, '')), r'{WORD}', 0)"
    return [
        SQLTransformer(statement=f"SELECT *, {tokens} AS _tokens FROM __THIS__"),
        StopWordsRemover(inputCol="_tokens", outputCol="_words", stopWords=stop, caseSensitive=True),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
    ]


def term_table(df: DataFrame, doc_id: str, text: str, label: str, stop: list[str] | None = None) -> DataFrame:
    """(doc_id, label, _words), written down: texts are taken apart once, whatever is fitted on them. Pairs of words are never written."""
    stop = default_stopwords() if stop is None else stop
    words = tx.without(tx.tokens(F.coalesce(F.col(text), F.lit(""))), stop)
    return written(fill_cores(df.select(doc_id, label, text), doc_id).select(doc_id, label, words.alias("_words")), "terms")


def weighing_stages(vocabulary: list[str], idf: np.ndarray, column: str = "_terms") -> list:
    """Stages from terms to unit-length TF-IDF vectors."""
    return [
        CountVectorizerModel.from_vocabulary(vocabulary, inputCol=column, outputCol="_counts"),
        SublinearTf("_counts", "_damped"),
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_damped", outputCol="_weighted"),
        Normalizer(p=2.0, inputCol="_weighted", outputCol="features"),
    ]


def vector_stages(terms: DataFrame, size: int = MAX_FEATURES) -> list:
    """The stages fitted on a table of ``_words``; only the vocabulary (at most ``size`` rows) reaches the driver."""
    rows = count_terms(terms.select("_words"), size).collect()
    n_docs = terms.count()
    return weighing_stages([r.term for r in rows], np.array([np.log((n_docs + 1) / (r.df + 1)) + 1 for r in rows]))


def fit_features(df: DataFrame, doc_id: str, text: str, stop: list[str] | None = None,
                 size: int = MAX_FEATURES) -> PipelineModel:
    """Text → unit-length TF-IDF vector."""
    stop = default_stopwords() if stop is None else stop
    terms = term_table(df.select(doc_id, text).withColumn("_none", F.lit(0)), doc_id, text, "_none", stop)
    return PipelineModel([*term_stages(text, stop), *vector_stages(terms, size)])


def featurize(features: PipelineModel, df: DataFrame) -> DataFrame:
    """Apply the feature stages and leave their working columns out."""
    return features.transform(df).select(*df.columns, "features")


def linear_model(coefficients: np.ndarray, intercept: float) -> LogisticRegressionModel:
    """Coefficients found elsewhere as a Spark ML model on ``features``, which scores, saves and loads as any other."""
    made = JavaWrapper._new_java_obj(
        "org.apache.spark.ml.classification.LogisticRegressionModel", f"LogisticRegression_{uuid.uuid4().hex[:12]}",
        Vectors.dense(coefficients), float(intercept))
    return LogisticRegressionModel(made).setFeaturesCol("features")


def model_stages(fit: Fit, column: str = "_terms") -> list:
    """A fitted arm as stages from terms to probabilities."""
    return [*weighing_stages(fit.terms, fit.idf, column), linear_model(fit.coefficients, fit.intercept)]


def fit(train: DataFrame, doc_id: str, text: str, label: str, c: float = 1.0, stop: list[str] | None = None,
        size: int = MAX_FEATURES, max_iter: int = 1000) -> PipelineModel:
    """The whole classifier as one model that can be saved and loaded: L2 logistic regression on balanced classes."""
    stop = default_stopwords() if stop is None else stop
    terms = term_table(train, doc_id, text, label, stop).withColumn("_all", F.lit(1))
    problem = prepare(terms, doc_id, label, [Arm("fit", "_all", c)], size)
    return PipelineModel([*term_stages(text, stop), *model_stages(solve(problem, most=max_iter)[0])])


def scored_arms(rows: DataFrame, row_id: str, label: str, arms: list[Arm], size: int = MAX_FEATURES) -> DataFrame:
    """row_id, y_true, arm, y_prob and y_pred: every row scored by every arm, all of them fitted in shared passes."""
    problem = prepare(rows, row_id, label, arms, size)
    scored = score_rows(problem, solve(problem))
    return scored.select(F.col("id").alias(row_id), F.col("label").alias("y_true"), "arm", "y_prob", decide(F.col("y_prob")).alias("y_pred"))


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5, spread_by: str | None = None) -> DataFrame:
    """Add P(escalated) and the decision; the decision always compares the probability with the cut-off.

    No row moves, unless ``spread_by`` names a key by which a scan of few files may be dealt out.
    """
    probability = vector_to_array("probability")[1].alias("y_prob")
    rows = fill_cores(df, spread_by) if spread_by and not df.isStreaming else df
    scored = model.transform(rows).select(*df.columns, probability)
    return scored.withColumn("y_pred", decide(F.col("y_prob"), threshold))


def model_table(spark: SparkSession, model: PipelineModel) -> tuple[DataFrame, float]:
    """(term, idf, coef) rows and the intercept: the same model without ML objects, at most one row per feature."""
    stages = {type(s).__name__: s for s in model.stages}
    words = stages["CountVectorizerModel"].vocabulary
    scale = stages["ElementwiseProduct"].getScalingVec().toArray()
    linear = stages["LogisticRegressionModel"]
    rows = [(w, float(i), float(c)) for w, i, c in zip(words, scale, linear.coefficients.toArray())]
    return spark.createDataFrame(rows, "term string, idf double, coef double"), float(linear.intercept)


Scorer = Callable[[Sequence[str]], Sequence[float]]


def score_with(df: DataFrame, make_scorer: Callable[[], Scorer], doc_id: str, text: str,
               threshold: float = 0.5) -> DataFrame:
    """Score with a caller's model of any kind.

    ``make_scorer`` is called once per task and returns a function from texts to probabilities. Texts of an
    Arrow batch go in order of length, so a model that pads its input wastes little. Empty in, empty out.
    """
    id_type = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for batch in batches:
            if not len(batch):
                continue
            scorer = scorer or make_scorer()
            texts = batch[text].fillna("")
            ordered = batch.assign(_t=texts).iloc[texts.str.len().argsort(kind="stable").to_numpy()]
            yield pd.DataFrame({
                doc_id: ordered[doc_id].to_numpy(),
                "y_prob": np.asarray(scorer(ordered["_t"].tolist()), dtype="float64"),
            })

    scored = df.select(doc_id, text).mapInPandas(run, f"{doc_id} {id_type}, y_prob double")
    return scored.withColumn("y_pred", decide(F.col("y_prob"), threshold))


def _truth(df: DataFrame, label: str) -> DataFrame:
    return df.withColumnRenamed(label, "y_true")


def evaluate(model: PipelineModel, df: DataFrame, label: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The metric set of a model on labeled rows; nothing is fitted again."""
    return binary_metrics(_truth(score(model, df), label).select(*keep, "y_true", "y_prob", "y_pred"), keep)


def selection_scores(df: DataFrame, doc_id: str, text: str, label: str, grid: list[float], ngrams: tuple[int, ...] = (1, 2),
                     seed: int = 42, stop: list[str] | None = None, size: int = MAX_FEATURES) -> DataFrame:
    """Scores of the validation rows under each setting, C with single words or with pairs too, fitted on training rows."""
    terms = term_table(df, doc_id, text, label, stop)
    ids = three_way_split(terms.select(doc_id, label), label, doc_id, seed=seed).filter("split <> 'test'")
    parts = written(terms.join(ids.select(doc_id, "split"), doc_id).withColumn("_train", (F.col("split") == "train").cast("int")), "parts")
    settings = {f"{c}|{n}": (float(c), n) for n in ngrams for c in grid}
    arms = [Arm(name, "_train", c, n > 1) for name, (c, n) in settings.items()]
    scored = scored_arms(parts, doc_id, label, arms, size).join(parts.filter("_train = 0").select(doc_id), doc_id, "left_semi")
    known = F.split("arm", r"\|")
    return scored.select(doc_id, known[0].cast("double").alias("setting"), known[1].cast("int").alias("ngram"), "y_true", "y_prob", "y_pred")


def select_on_validation(df: DataFrame, doc_id: str, text: str, label: str, grid: list[float], ngrams: tuple[int, ...] = (1, 2),
                         seed: int = 42, stop: list[str] | None = None, size: int = MAX_FEATURES) -> DataFrame:
    """The metrics of each setting on validation rows, and which is ``selected``.

    Test rows are not touched. Of equals the smaller C, then the shorter n-gram wins.
    """
    scored = selection_scores(df, doc_id, text, label, grid, ngrams, seed, stop, size)
    kept = durable(binary_metrics(scored, ("setting", "ngram")))
    place = F.struct("f1_macro", -F.col("setting"), -F.col("ngram"))
    winner = kept.agg(F.max_by(F.struct("setting", "ngram"), place)).scalar()
    return kept.withColumn("selected", (F.struct("setting", "ngram") == winner).cast("int"))


def seed_scores(df: DataFrame, doc_id: str, text: str, label: str, seeds: list[int],
                stop: list[str] | None = None, size: int = MAX_FEATURES) -> DataFrame:
    """Scores of each seed's test rows by the fit on its training rows."""
    terms = term_table(df, doc_id, text, label, stop)
    marked = terms.select(doc_id, label)
    for seed in seeds:
        marked = stratified_split(marked, label, doc_id, seed=seed, names=("1", "0"), column=f"_m{seed}")
    marked = written(marked.select(doc_id, *[F.col(f"_m{s}").cast("int").alias(f"_m{s}") for s in seeds]), "seeds")
    rows = written(terms.join(marked, doc_id), "parts")
    scored = scored_arms(rows, doc_id, label, [Arm(str(s), f"_m{s}") for s in seeds], size)
    held_out = marked.select(doc_id, F.explode(F.array_compact(F.array(*[F.when(F.col(f"_m{s}") == 0, F.lit(str(s))) for s in seeds]))).alias("arm"))
    return scored.join(held_out, [doc_id, "arm"]).select(doc_id, F.col("arm").cast("int").alias("seed"), "y_true", "y_prob", "y_pred")


def seed_runs(df: DataFrame, doc_id: str, text: str, label: str, seeds: list[int],
              stop: list[str] | None = None, size: int = MAX_FEATURES) -> DataFrame:
    """The same setting on several splits: one metric record per seed."""
    return binary_metrics(seed_scores(df, doc_id, text, label, seeds, stop, size), ("seed",))


def curve_scores(df: DataFrame, doc_id: str, text: str, label: str, fractions: dict[str, float],
                 seed: int = 42, stop: list[str] | None = None, size: int = MAX_FEATURES) -> DataFrame:
    """Scores of the test rows by fits on nested shares of the training rows."""
    terms = term_table(df, doc_id, text, label, stop)
    ids = written(stratified_split(terms.select(doc_id, label), label, doc_id, seed=seed), "split")
    sizes = nested_train_sizes(ids.filter("split = 'train'").drop("split"), label, doc_id, fractions, seed)
    flags = sizes.groupBy(doc_id).agg(*[F.max((F.col("size_name") == n).cast("int")).alias(f"_s{k}") for k, n in enumerate(fractions)])
    known = ids.select(doc_id, "split").join(flags, doc_id, "left")
    rows = written(terms.join(known, doc_id).na.fill(0, [f"_s{k}" for k in range(len(fractions))]), "parts")
    scored = scored_arms(rows, doc_id, label, [Arm(n, f"_s{k}") for k, n in enumerate(fractions)], size)
    test = rows.filter("split = 'test'").select(doc_id)
    return scored.join(test, doc_id, "left_semi").select(doc_id, F.col("arm").alias("size_name"), "y_true", "y_prob", "y_pred")


def learning_curve(df: DataFrame, doc_id: str, text: str, label: str, fractions: dict[str, float],
                   seed: int = 42, stop: list[str] | None = None, size: int = MAX_FEATURES) -> DataFrame:
    """Test metrics after training on nested shares of the training rows."""
    return binary_metrics(curve_scores(df, doc_id, text, label, fractions, seed, stop, size), ("size_name",))
