"""Spelling variants against brute force: all strings one edit away from each word."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caselane.llm import variants
from tests.llm.cases import documents

LETTERS = [chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)]]


def count(docs):
    """Words of (id, text) pairs and how often they occur."""
    found = Counter()
    for ident, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            key = zlib.crc32(f"{'' if ident is None else ident}:{word}".encode())
            if key % 97 == 0:
                word = word[:key % len(word)] + word[key % len(word) + 1:]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def expected(n):
    near = {}
    for w in n:
        cuts = [(w[:k], w[k:]) for k in range(len(w) + 1)]
        edits = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in LETTERS} | {a + c + b[1:] for a, b in cuts if b for c in LETTERS}
        near[w] = {x for x in edits if x in n and x != w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def listed(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, name):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    want = expected(count([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert listed(variants.report(docs)) == want
    assert sum(v[0] is not None for v in want.values()) > 100


def test_many_words_of_few_letters(spark):
    """Dense vocabularies: repeated letters, prefixes of each other, groups as large as the alphabet, chains, ties."""
    rng = random.Random(1)
    words = {"".join(rng.choice("aàb") for _ in range(rng.randint(5, 9))): rng.randint(3, 40) for _ in range(900)}
    words |= {f"crow{c}ds": 7 + (k % 3) for k, c in enumerate(LETTERS)} | {"crowds": 90, "aaaaaaa": 6, "aaaaaa": 3, "z" * 300: 9, "z" * 299: 4, "z" * 301: 2000}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert listed(variants.group(df)) == expected(words)


def test_nodes_agree_across_ranges(spark):
    """Prefixes that span several sorted ranges have one number, and no two prefixes share one."""
    words = ["a" * k for k in range(5, 60)] + ["a" * 30 + c + d for c in "bcd" for d in "xyz"] + ["b" * 9]
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        numbered = variants.number_nodes(df, "word")
        assert numbered.select("range").distinct().count() > 10
        rows = variants.agreed(numbered).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    nodes = {(r.word[:k + 1], x) for r in rows for k, x in enumerate(r.nodes)}
    assert len({p for p, _ in nodes}) == len({x for _, x in nodes}) == len(nodes)
    assert [r.word for r in sorted(rows, key=lambda r: r.id)] == sorted(words)


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert listed(variants.report(docs)) == expected(count(rows))
    assert variants.report(docs.limit(0)).collect() == []


def test_long_words(spark):
    run = "".join(random.Random(2).choice("abcdefgh") for _ in range(20_000))
    cut = run[:10_000] + run[10_001:]
    rows = listed(variants.group(spark.createDataFrame([(run, 3), (cut, 7)], "word string, n long")))
    assert rows == {run: (cut, cut, 3, 1, 7), cut: (None, cut, 7, 1, None)}
    docs = spark.createDataFrame([(k, run) for k in range(3)] + [(5, None)], "doc_id long, text string")
    assert listed(variants.report(docs)) == expected_alone(count([(k, run) for k in range(3)]))


def expected_alone(n):
    return {w: (None, w, c, 0, None) for w, c in n.items()}


def test_group_of_a_pair_is_bounded(spark):
    """What meets under one pair of nodes skips one letter, so there are no more than there are letters, and one whole word."""
    df = spark.createDataFrame([(f"wo{c}rd", 3) for c in LETTERS] + [("word", 3), ("words", 3)], "word string, n long")
    _, under = variants.entries(df)
    assert under.groupBy("p", "s").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] == len(LETTERS) + 1
