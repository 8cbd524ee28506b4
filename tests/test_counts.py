"""Terms counted from words, pairs as numbers, against terms counted as strings."""

import pytest
from pyspark.sql import functions as F

from caselane.operators import heavy, ngrams

TEXTS = [(1, "Aa bb aa BB cc"), (1, "bb cc"), (2, None), (3, ""), (4, "the zz the aa"), (5, "cc cc cc aa bb"), (6, "ééé aa, bb")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "id long, t string").repartition(3)


@pytest.mark.parametrize("items", [1, 3, 1 << 20])
def test_words_give_the_counts_of_their_terms(docs, monkeypatch, items):
    monkeypatch.setattr(heavy, "ITEMS", items)
    words = docs.select(ngrams.words_of(F.col("t"), ["the"]).alias("_words"))
    terms = docs.select(ngrams.terms_of(F.col("t"), ["the"]).alias("_terms"))
    for count in (heavy.all_counts, lambda taken: heavy.most_frequent(taken, 4), lambda taken: heavy.most_frequent(taken, 4, 2)):
        assert sorted(count(words).collect()) == sorted(count(terms).collect())


def test_known_counts_by_place_and_by_join(spark, docs, monkeypatch):
    """Repeated ids add up, missing texts hold the marker alone, unknown words break pairs."""
    table = spark.createDataFrame([("aa", 1.0), ("aa bb", 2.0), ("zz aa", 3.0), ("cc cc", 4.0), ("nn", 5.0), ("aa nn", 6.0), ("", 0.0)], "term string, v double")
    placed = sorted(ngrams.known_counts(docs, table, "id", "t", ["the"]).collect())
    monkeypatch.setattr(ngrams, "FEW_TERMS", 2)
    assert placed == sorted(ngrams.known_counts(docs, table, "id", "t", ["the"]).collect())
    assert (1, "", 2, 0.0) in placed and (2, "", 1, 0.0) in placed and (5, "cc cc", 2, 4.0) in placed
    assert ngrams.known_counts(docs, table.filter("v > 9"), "id", "t", []).count() == 0
