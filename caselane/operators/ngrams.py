"""The n-gram model as relations: tokens, vocabulary, TF-IDF weights, linear scores."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from caselane.functions import text as tx
from caselane.functions.scores import share
from caselane.operators.heavy import all_counts, coded, items_of, lengths_of, most_frequent, slices
from caselane.operators.ordered import FEW_SPLITS, fill_cores
from caselane.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_FEATURES = 10_000
FEW_TERMS = 1 << 17  # terms of a table up to which every task gets them

# Every text carries this marker; no real term is empty.
NO_TERM = ""


def tokenize(df: DataFrame, text: str, column: str = "tokens") -> DataFrame:
    return df.withColumn(column, tx.tokens(F.col(text)))


def remove_stopwords(df: DataFrame, stop: list[str], column: str = "tokens") -> DataFrame:
    return df.withColumn(column, tx.without(F.col(column), stop))


def ngrams(df: DataFrame, column: str = "tokens", output: str = "terms") -> DataFrame:
    """Single words and pairs; pairs join words that are neighbours once stop words are gone."""
    return df.withColumn(output, tx.unigrams_and_bigrams(F.col(column)))


def words_of(text: Column, stop: list[str]) -> Column:
    return tx.without(tx.tokens(text), stop)


def terms_of(text: Column, stop: list[str]) -> Column:
    return tx.unigrams_and_bigrams(words_of(text, stop))


def vocabulary(df: DataFrame, doc_id: str, text: str, stop: list[str], size: int = MAX_FEATURES) -> DataFrame:
    """The most frequent terms of the corpus, ties in term order, with their document frequency.

    Tasks hand on bounded summaries of what they count; see :mod:`caselane.operators.heavy`.
    """
    splits = df.rdd.getNumPartitions()
    return count_terms(fill_cores(df.select(doc_id, text), doc_id).select(words_of(F.col(text), stop).alias("_words")), size, splits)


def count_terms(taken: DataFrame, size: int = MAX_FEATURES, splits: int | None = None) -> DataFrame:
    """The vocabulary of texts that have been taken apart into ``_terms``, or into ``_words`` whose pairs are terms too.

    Summaries pay where many tasks hold the same terms; what a scan of few splits counts is not worth them. Either way gives
    the same terms.
    """
    if splits is not None and splits <= FEW_SPLITS:
        return all_counts(taken).orderBy(F.desc("n"), "term").limit(size)
    return most_frequent(taken, size)


def count_terms_of(taken: DataFrame, members: list[str]) -> DataFrame:
    """term, and ``n_<m>`` and ``df_<m>`` for each 0/1 column m: the counts among its rows of ``_terms`` or ``_words``. One pass serves all.

    Terms are counted as numbers, some rows at a time, and become strings once for these rows.
    """
    column, pairs = items_of(taken)
    names = [f"n_{m}" for m in members] + [f"df_{m}" for m in members]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [batch.column(1 + k).to_numpy(zero_copy_only=False) == 1 for k in range(len(members))]
            for at, upto in slices(batch.column(0)):
                row, code, terms = coded(batch.column(0).slice(at, upto - at), pairs)
                width = max(1, len(terms))
                found, times = np.unique(row * width + code, return_counts=True)
                term, inside = found % width, [f[at:upto][found // width] for f in flags]
                sums = [np.bincount(term, times * i, width) for i in inside] + [np.bincount(term, i, width) for i in inside]
                yield pa.RecordBatch.from_arrays([terms.cast(pa.string()), *[pa.array(s[:len(terms)].astype(np.int64)) for s in sums]], ["term", *names])

    counted = taken.select(column, *members).mapInArrow(count, ", ".join(["term string", *[f"`{n}` long" for n in names]]))
    return counted.groupBy("term").agg(*[F.sum(n).alias(n) for n in names])


class Known:
    """The places of a table's terms, found from the words of texts without writing a pair as a string.

    Without ``pairs`` the texts are lists of terms, and a pair is a term like any other.
    """

    def __init__(self, terms: list[str], pairs: bool = True):
        parts = [[t] if not pairs else t.split(" ") if t != NO_TERM else [] for t in terms]
        names = sorted({w for p in parts if len(p) <= 2 for w in p})
        number = {w: k for k, w in enumerate(names)}
        self.words, self.width = pa.array(names, pa.string()), len(names) + 1  # the last number is that of any other word
        self.single = np.full(self.width, -1)
        both = {}
        for at, p in enumerate(parts):
            if len(p) == 1:
                self.single[number[p[0]]] = at
            elif len(p) == 2:
                both[number[p[0]] * self.width + number[p[1]]] = at
        self.pairs = np.array(sorted(both), np.int64)
        self.pair_place = np.array([both[p] for p in sorted(both)], np.int64)
        self.marker = [at for at, p in enumerate(parts) if not p]

    def counts(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and count of each known term of some rows of words."""
        words = lists.flatten().dictionary_encode()
        number = pc.fill_null(pc.index_in(words.dictionary.cast(pa.string()), self.words), self.width - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        word = number[words.indices.to_numpy(zero_copy_only=False)]
        row = np.repeat(np.arange(len(lists)), lengths_of(lists))
        rows, places = [row], [self.single[word]]
        if len(self.pairs):
            beside = row[1:] == row[:-1]
            key = (word[:-1] * self.width + word[1:])[beside]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rows.append(row[1:][beside])
            places.append(np.where(self.pairs[at] == key, self.pair_place[at], -1))
        for marker in self.marker:
            rows.append(np.arange(len(lists)))
            places.append(np.full(len(lists), marker))
        row, place = np.concatenate(rows), np.concatenate(places)
        many = max(1, int(place.max(initial=0)) + 1)
        found, times = np.unique((row * many + place)[place >= 0], return_counts=True)
        return found // many, found % many, times


def known_counts(df: DataFrame, table: DataFrame, doc_id: str, text: str, stop: list[str]) -> DataFrame:
    """(doc, term, tf, columns of ``table``) for the terms of a table.

    Texts are folded where they lie and unknown terms drop out; what moves, once, is the counts of known terms. A table of few
    terms goes to every task, which knows a term by its place in it; a larger one is joined.
    """
    extra = [c for c in table.columns if c != "term"]
    spread = fill_cores(df.select(doc_id, text), doc_id)
    listed = table.filter("term IS NOT NULL").limit(FEW_TERMS + 1).collect()
    if len(listed) > FEW_TERMS:
        terms = F.concat(F.array(F.lit(NO_TERM)), terms_of(F.col(text), stop))
        return (
            spread.select(doc_id, F.inline(tx.folded(terms))).join(table, "term").repartition(doc_id)
            .groupBy(doc_id, "term").agg(F.sum("tf").alias("tf"), *[F.first(c).alias(c) for c in extra])
        )
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast([r.term for r in listed])  # plain values: a broadcast object would need its module on the workers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(sent.value)
        for batch in batches:
            for at, upto in slices(batch.column(1)):
                row, place, times = known.counts(batch.column(1).slice(at, upto - at))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + at)), pa.array(place.astype(np.int32)), pa.array(times)],
                                                 [doc_id, "_place", "tf"])

    ident = df.schema[doc_id].dataType.simpleString()
    counted = spread.select(doc_id, words_of(F.col(text), stop).alias("_words")).mapInArrow(count, f"`{doc_id}` {ident}, _place int, tf long")
    summed = counted.repartition(doc_id).groupBy(doc_id, "_place").agg(F.sum("tf").alias("tf"))
    places = spark.createDataFrame([(*r, k) for k, r in enumerate(listed)], T.StructType([*table.schema.fields, T.StructField("_place", T.IntegerType())]))
    return summed.join(F.broadcast(places), "_place").select(doc_id, "term", "tf", *extra)


def idf(df: Column, n_docs: Column) -> Column:
    return F.log((n_docs + 1) / (df + 1)) + 1


def sublinear(tf: Column) -> Column:
    return F.log(tf.cast("double")) + 1


def tfidf(df: DataFrame, doc_id: str, text: str, stop: list[str], size: int = MAX_FEATURES,
          terms: DataFrame | None = None) -> DataFrame:
    """(doc, term, weight): sublinear tf times smoothed idf, each document scaled to unit length.

    ``terms`` is the vocabulary of ``df``, where a caller has it already.
    """
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    known = terms if terms is not None else vocabulary(df, doc_id, text, stop, size)
    table = written(known.select("term", idf(F.col("df"), n_docs).alias("idf")), "idf")
    return weigh(known_counts(df, table, doc_id, text, stop), doc_id)


def weigh(counts: DataFrame, doc_id: str) -> DataFrame:
    raw = counts.withColumn("_w", sublinear(F.col("tf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc_id)))
    return raw.select(doc_id, "term", (F.col("_w") / length).alias("weight"))


def class_weights(df: DataFrame, label: str = "escalated") -> DataFrame:
    """``n / (2 n_c)`` per class, an absent class counting as one row."""
    m = df.agg(*[F.count_if(F.col(label) == k).alias(f"_n{k}") for k in (0, 1)])
    n = F.col("_n0") + F.col("_n1")
    return m.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("label"), F.col(f"_n{k}").alias("n"),
                 (n / (2.0 * F.greatest(F.col(f"_n{k}"), F.lit(1)))).alias("weight"))
        for k in (0, 1)
    ])))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def linear_score(weights: DataFrame, coefficients: DataFrame, doc_id: str, intercept: float = 0.0) -> DataFrame:
    """P(escalated) from TF-IDF rows and a (term, coef) table."""
    scored = weights.join(coefficients, "term", "left")
    z = F.coalesce(F.sum(F.col("weight") * F.col("coef")), F.lit(0.0)) + F.lit(float(intercept))
    return scored.groupBy(doc_id).agg(sigmoid(z).alias("y_prob"))


def table_score(df: DataFrame, model: DataFrame, doc_id: str, text: str, stop: list[str], intercept: float) -> DataFrame:
    """Score raw texts with a fitted (term, idf, coef) table: one shuffle of texts, everything in the JVM.

    The marker every text carries has weight 0 here, so texts without any known term score at the intercept.
    """
    marker = df.sparkSession.createDataFrame([(NO_TERM, 0.0, 0.0)], model.schema)
    rows = known_counts(df, model.unionByName(marker), doc_id, text, stop)
    w = sublinear(F.col("tf")) * F.col("idf")
    z = share(F.sum(w * F.col("coef")), F.sqrt(F.sum(w * w)))
    return rows.groupBy(doc_id).agg(sigmoid(F.coalesce(z, F.lit(0.0)) + F.lit(float(intercept))).alias("y_prob"))
