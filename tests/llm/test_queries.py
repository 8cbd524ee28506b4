"""Registered corpus queries: against SQL where SQL can say it, else against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from xxhash import xxh64_intdigest

import __spark_entry__ as contract
from caselane.llm import queries

TABLES = ("documents", "pages", "labels", "embeddings")


@pytest.fixture(scope="module")
def docs(spark, folder):
    return {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def run(spark, folder, name):
    return contract.queries()[name](spark, folder)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, folder, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = run(spark, folder, name)
    cols = sorted(df.columns)
    rel = duck.sql(queries.SQL[name])
    assert sorted(rel.columns) == cols
    pick = [rel.columns.index(c) for c in cols]
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert got and got == sorted(repr(tuple(r[i] for i in pick)) for r in rel.fetchall())


def test_every_operator_is_registered():
    names = contract.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_languages(spark, folder, docs):
    rows = run(spark, folder, "op5_language").collect()
    assert {r.doc_id for r in rows} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_secrets(spark):
    folder = "/root/testdata/sf0.01"  # the smallest tables hold no secret
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    patterns = {"assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
                "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}
    good = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    seen = Counter()
    for r in run(spark, folder, "op6_secrets").collect():
        text = docs[r.doc_id].text or ""
        found = {k: [m.span() for m in p.finditer(text) if good[k](m)] for k, p in patterns.items()}
        spans = sorted((s, rank, e, k) for rank, (k, v) in enumerate(found.items()) for s, e in v)
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(len(found[k]) for k in patterns)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
        seen.update(k for *_, k in spans)
    assert seen["assign"] and seen["hex"]


def test_packing(spark, folder, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, places = defaultdict(dict), defaultdict(list)
    for r in run(spark, folder, "op7_packing").collect():
        by_doc[r.doc_id][r.piece] = r
        places[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(docs)
    total = 0
    for ident, found in by_doc.items():
        ids = np.array([*tokenizer.encode(docs[ident].text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        assert sorted(found) == list(range(-(-len(ids) // 2048)))
        for k, r in found.items():
            part = ids[2048 * k:2048 * (k + 1)]
            assert (r.start, r.length, r.ids_crc32) == (2048 * k, len(part), zlib.crc32(part.tobytes()))
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.05 * total / 2048 + 2


def test_shards(spark, folder, docs):
    rows = sorted(run(spark, folder, "op8_sharding").collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(docs)
    sizes, last = Counter(), (0, -1)
    for r in rows:
        body = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 1, zlib.crc32(body), "bytes", None)
        assert (r.shard, r.slot) in ((last[0], last[1] + 1), (last[0] + 1, 0))
        last = (r.shard, r.slot)
        sizes[r.shard] += r.size
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)


def test_edits(spark, folder, docs):
    order = sorted(docs)
    rows = {r.doc_id: r for r in run(spark, folder, "op9_merkle").collect()}
    by_text, near, far = {}, [], []
    for ident, after in zip(order, order[1:] + order[:1]):
        text, other, r = docs[ident].text or "", docs[after].text or "", rows[ident]
        k = len(text) // 4
        edited = text[:len(text) - k] + other[:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        near.append(r.near_edited)
        far.append(r.near_next)
    assert len(set(by_text.values())) == len(by_text)
    assert np.mean(near) > 0.5 and np.mean(far) < 0.1


def fingerprint(text, words=4):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_components(prints, bits=4):
    ids = sorted(prints, key=lambda i: (i is None, i))
    root = {i: i for i in ids}
    codes = np.array([prints[i] for i in ids], np.uint64)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(codes ^ codes[k]) <= bits):
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, folder, docs):
    prints = {i: fingerprint(r.text) for i, r in docs.items()}
    want = linked_components(prints)
    rows = run(spark, folder, "op10_simhash").collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in docs}
    assert len(set(want.values())) < len(docs)
