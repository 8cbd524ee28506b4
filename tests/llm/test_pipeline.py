"""The stages in order, each against a plain version of what it must do to its own input."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from caselane.llm import packing
from caselane.session import written
from corpus_pipeline import pack_sequences
from tests.llm.cases import DOCS, ROWS, documents


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return Counter(tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1)))


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


@pytest.fixture(scope="module")
def stages(spark):
    """The documents of sf0.01 and what each stage made of its predecessor's."""
    folder = "/root/testdata/sf0.01"
    tables = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], folder), name))
    return [t.collect() for t in tables]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_language_keeps_what_is_written_in_one(stages):
    before, after = stages[:2]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}


def test_exact(stages):
    before, after = stages[1:3]
    last = {}
    for r in before:
        last[lowered(r.text)] = max(r.doc_id, last.get(lowered(r.text), -1))
    assert sorted(r.doc_id for r in after) == sorted(last.values()) and len(after) < len(before)


def test_near(stages):
    before, after = stages[2:4]
    kept = {r.doc_id for r in after}
    sets = {r.doc_id: shingles(r.text) for r in before}
    by_shingle = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].add(i)
    alike = defaultdict(dict)
    for i, s in sets.items():
        for j in set().union(*(by_shingle[x] for x in s)) - {i}:
            alike[i][j] = jaccard(s, sets[j])
    dropped = set(sets) - kept
    assert dropped
    for i in dropped:  # each is a near copy of some document; the estimate may be a little off the bound
        assert max(alike[i].values()) >= 0.7
    strong = {(i, j) for i in sets for j, a in alike[i].items() if a >= 0.9}
    assert strong and not any(i in kept and j in kept for i, j in strong)


def test_mix(stages):
    before, after = stages[3:5]
    times = Counter(r.doc_id for r in after)
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and max(times.values()) <= 2
    assert after[0].__fields__ == before[0].__fields__
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    assert abs(words(after) - 1.5 * words(before)) < 0.15 * words(before)


def test_pack(stages):
    before, after = stages[4:6]
    assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)
    fill = Counter()
    for r in after:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= 1.05 * sum(fill.values()) / 2048 + 1
    assert len({(r.doc_row, r.piece) for r in after}) == len(after) and len({r.doc_row for r in after}) == len(before)
    for r in after:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_awkward_rows(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, ""), name)
        assert docs.schema == DOCS
    assert 0 < docs.count() <= 2 * len(ROWS)
    packed = packing.pack(documents(spark), keep_ids=True).collect()  # no row is lost before it
    assert len({r.doc_row for r in packed}) == len(ROWS) and Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in ROWS)
    assert all(len(r.ids) == r.length for r in packed) and any(r.piece > 0 for r in packed)
    assert pack_sequences(spark, docs, "").count() >= docs.count()


def test_empty(spark):
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
    assert docs.count() == 0 and "sequence_id" in docs.columns
