"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names for every operator."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from caselane.llm import exactdup, langid, merkle, mixing, packing, secrets, sharding, simhash, styletree, warc
from tests.llm.cases import DOCS, ENGLISH, GERMAN, LONG, ROWS, documents, listing, pages
from tests.llm.test_queries import fingerprint, linked_components

REPORTS = [mixing.report, exactdup.decide, langid.report, secrets.report, packing.pack, sharding.report, merkle.report, simhash.report]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("report", REPORTS, ids=lambda r: r.__module__.rpartition(".")[2])
def test_empty_table(spark, report):
    out = report(documents(spark, []))
    assert out.count() == 0 and "doc_id" in out.columns


@pytest.mark.parametrize("keep", [mixing.mix, exactdup.dedup, simhash.dedup], ids=["mix", "exact", "near"])
def test_columns_are_kept(spark, keep):
    assert keep(documents(spark, [])).schema == DOCS
    out = keep(documents(spark))
    assert out.schema == DOCS and all(r.size == "s" and r.row == "r" and r.code == "c" for r in out.collect())


def test_mixing(spark):
    rows = mixing.report(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    assert listing(mixing.report(documents(spark))) == sorted(repr(tuple(r)) for r in rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(size(t) for _, t, *_ in ROWS)
    goals = {}
    for r, (i, t, _, s) in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.size)), sorted(ROWS, key=lambda r: (r[0] is None, r[0], size(r[1])))):
        assert r.size == size(t) and r.taken <= 2 * r.size and r.source_size == sum(size(u) for _, u, _, v in ROWS if v == s)
        goals[s] = r.target
        assert r.target <= 2 * r.source_size
    assert abs(sum(goals.values()) - 1.5 * total) < 1e-6 * total


def test_targets_by_brute_force(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300, "Z": 0}
    table = spark.createDataFrame([(k, v) for k, v in sizes.items()], "mix_source string, mix_size long")
    got = {r.mix_source: r.mix_target for r in mixing.targets(table).collect()}
    order = sorted((k for k in sizes if k), key=lambda k: k.encode()) + [None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[k], mid * weight[k]) for k in sizes) < 1.5 * sum(sizes.values()) else (low, mid)
    assert all(abs(got[k] - min(2 * sizes[k], low * weight[k])) < 1e-6 for k in sizes)


@pytest.mark.parametrize("block", [3, 1024])
def test_exact(spark, block):
    rows = exactdup.decide(documents(spark), size=block).collect()
    want = {}
    for i, t, *_ in ROWS:
        want.setdefault(lowered(t), []).append(i)
    assert len(rows) == len(ROWS)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    for r in rows:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == max(known, default=None)
    kept = exactdup.dedup(documents(spark), size=block).collect()
    assert sorted(lowered(r.text) for r in kept) == sorted(want)


def test_blocks_are_told_apart_by_order_and_length(spark):
    texts = ["abcdef", "defabc", "abc", "abcabc", "abcabcabc", "ab", "", "abcdefabc", "😀😀😀😀", "😀😀😀"]
    rows = exactdup.identities(documents(spark, [(k, t, None, None) for k, t in enumerate(texts * 2)]), size=3).collect()
    names = {}
    for r in rows:
        names.setdefault((r.level, r.name), set()).add(texts[r.doc_id % len(texts)])
    assert len(names) == len(texts) and all(len(v) == 1 for v in names.values())


def test_languages(spark):
    rows = [(k, ENGLISH[k % 9:] if k % 2 else GERMAN[k % 9:], "en" if k % 2 else "de", "a") for k in range(100, 200)]
    out = langid.report(documents(spark, ROWS + rows)).collect()
    assert len(out) == len(ROWS) + 100
    said = {r.doc_id: r for r in out}
    assert all(said[i].lang_pred == "und" and said[i].score == 0 for i in (3, 4, 5, 10))
    assert said[1].lang_pred == "en" and said[6].lang_pred == "de"
    nothing = langid.report(documents(spark, [(1, ENGLISH, None, "a"), (2, None, "en", "b")])).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    kept = langid.accept(documents(spark, ROWS + rows), langid.train(documents(spark, ROWS + rows)), 0.3)
    assert kept.schema == DOCS and {3, 4, 5, 10}.isdisjoint({r.doc_id for r in kept.collect()})


def test_language_sample_is_bounded(spark, monkeypatch):
    """One id on most rows, and one row on many."""
    rows = [(7, f"{ENGLISH} {k}", "en", "a") for k in range(400)] + [(8, GERMAN, "de", "a")] * 300
    fitted, fit = [], langid.fit_weights
    monkeypatch.setattr(langid, "fit_weights", lambda rows, *rest: fitted.append(len(rows)) or fit(rows, *rest))
    monkeypatch.setattr(langid, "temperature", lambda logits, labels: fitted.append(len(labels)) or 1.0)
    model = langid.train(documents(spark, rows), per_language=50)
    assert model["languages"] == ["de", "en"] and sum(fitted) == 51


def test_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    chances = langid.softmax(logits)
    labels = np.array([rng.choice(3, p=p) for p in chances])
    assert abs(langid.temperature(logits * 5, labels) - 5) < 0.6


def test_secrets(spark):
    key = "Zx9" + "q7Lk2Vw8Rt5Ys1Bn4Mc6"
    rows = [(k, ENGLISH, "en", "a") for k in range(20, 40)] + [
        (50, f"😀 token = abc secret=token: abcdefgh password='{key}' AKIA{'A1' * 10} AKIAshort {'0a1b' * 8}", None, None), (51, None, None, None),
        (52, "passWORD:" + "x" * 6 + "\nPASSWD=short", None, None)]
    out = {r.doc_id: r for r in secrets.report(documents(spark, rows)).collect()}
    assert (out[50].n_assign, out[50].n_access, out[50].n_hex) == (1, 1, 1)
    assert (out[51].n_assign, out[51].spans, out[51].base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert out[52].n_assign == 1 and "assign:0:15" in out[52].spans
    start = rows[-3][1].index("password")
    assert f"assign:{start}:{start + len('password=') + 1 + len(key)}" in out[50].spans.split(",")
    assert all(out[k].spans == "" for k in range(20, 40))


def test_markov_model(spark):
    rng = np.random.default_rng(1)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    samples = [("".join(rng.choice(alphabet, 32)), True) for _ in range(300)] + [(w, False) for w in "get_user_name compute_total_price read_file_lines connection_manager parse_argument_list".split() * 60]
    ratios = secrets.train(spark.createDataFrame(samples, "value string, random boolean"))
    assert len(ratios) == secrets.WIDTH**2
    random = "".join(rng.choice(alphabet, 40))
    found = secrets.scan(documents(spark, [(1, f"call compute_total_user_price_list and {random} here", None, None)]), ratios)
    assert found.select(secrets.listed(found["spans"])).first()[0] == "markov:39:79"
    assert secrets.train(spark.createDataFrame(samples[:300], "value string, random boolean")) is None

    keys = ["".join(rng.choice(alphabet, n)) for n in (40, 40, 16, 19, 40)]
    glued = ["0a1b2c3d" * 3 + "=" + keys[0], "/path/to/the/configuration/directory/" + keys[1], f"a {keys[2]} é {keys[3]}", "4111111111111111", f"'token': {'x' * 6}!{keys[4]}", None, ""]
    got = [r[0] for r in secrets.scan(documents(spark, [(k, t, None, None) for k, t in enumerate(glued)]), ratios)
           .orderBy("doc_id").select(secrets.listed(secrets.F.col("spans"))).collect()]
    assert got == ["hex:0:24,markov:25:65", "markov:37:77", "markov:2:18,markov:21:40", "", "assign:1:15,markov:16:56", "", ""]


def test_added_spans_by_brute_force(spark):
    """The query's added spans on sf0.01 and planted keys, recounted in plain Python from the table of ratios."""
    rng = np.random.default_rng(2)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in table.collect()]
    planted = ["".join(rng.choice(alphabet, n)) for n in (12, 14, 16, 20, 24, 32, 40, 64) for _ in range(20)]
    rows += [(10_000 + k, f"words before {v}, {rows[k][1]}", "en", "a") for k, v in enumerate(planted)]
    docs = documents(spark, rows)
    ratios = secrets.train(secrets.labelled(docs))
    got = {r.doc_id: (r.base, r.spans) for r in secrets.scan(docs, ratios).collect()}
    found = 0
    for k, text, *_ in rows:
        base, every = got[k]
        rest = list(text or "")
        for s in base:
            rest[s.start:s.end] = " " * (s.end - s.start)
        want = []
        for m in re.finditer(r"[A-Za-z0-9+_]{12,}", "".join(rest)):
            steps = [ratios[(ord(a) - secrets.FIRST) * secrets.WIDTH + ord(b) - secrets.FIRST] for a, b in zip(m[0], m[0][1:])]
            if not m[0].isdigit() and sum(steps) >= secrets.THRESHOLD * (max(len(m[0]), secrets.SURE) - 1):
                want.append(m.span())
        assert [(s.start, s.end) for s in every if s.rank == 3] == want
        found += k >= 10_000 and (13, 13 + len(planted[k - 10_000])) in want
    assert found >= 0.9 * len(planted)


def test_many_spans_in_one_text(spark):
    text = "".join(f"é{k} password=secret{k:06d} {'ab01' * 6}\n" for k in range(3000))
    row = secrets.scan(documents(spark, [(1, text, None, None)]), None).first()
    assert [(s.start, s.end) for s in row.assign] == [m.span() for m in re.finditer(r"password=[a-z0-9]+", text)]
    assert [(s.start, s.end) for s in row.hex] == [m.span() for m in re.finditer(r"[0-9a-f]{24,}", text)]


def test_packing(spark):
    rows = packing.pack(documents(spark)).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert [r.length for i in (3, 4, 5) for r in by_doc[i]] == [1, 1, 1] and by_doc[3][0].ids_crc32 == zlib.crc32(bytes(4))
    assert len(by_doc[2]) == 2 and len(by_doc[8]) > 20 and sum(r.length for r in by_doc[8]) > 40_000
    assert all(r.length == 2048 for r in sorted(by_doc[8], key=lambda r: r.piece)[:-1])
    kept = packing.pack(documents(spark), keep_ids=True).filter("doc_id = 1").first()
    assert zlib.crc32(np.array(kept.ids, "<u4").tobytes()) == kept.ids_crc32


def test_open_bins_by_brute_force():
    rng = np.random.default_rng(3)
    bins, fills, closed = packing.OpenBins(100, 7, 0), {}, set()
    for size in rng.integers(1, 101, 2000).tolist():
        best = max((f for b, f in fills.items() if b not in closed and f + size <= 100), default=None)
        opened = [b for b in fills if b not in closed and fills[b] < 100]
        found, offset = bins.place(size)
        if best is None:
            assert offset == 0 and found not in fills
            if len(opened) == 7:
                closed.add(min((b for b in opened if fills[b] == max(fills[o] for o in opened)), key=lambda b: bins.by_free.get(100 - fills[b], []).count(b)))
        else:
            assert offset == best == fills[found]
        fills[found] = fills.get(found, 0) + size
    assert max(fills.values()) <= 100


def test_words_of_any_script():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    known = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("", "It's I'M we'll 'sx d'd", "ΑΣ ΣΑΣ.σ İstanbul ǅ", "é é ẛ̣ ﬁ", "a\x1cb\x1f c\x85d\xa0e f　g", "日本語 テスト 123 ４５", "😀👍🏽 <|endoftext|> x",
                 "a <|endoftext|> b", "a<|startoftext|>é<|endoftext|><|endoftext|>c d <|EndOfText|> <|endoftext", "<|endoftext|>", " <|endoftext|>́x",
                 "mixed,CASE...and--dashes 3.14", "İı", "नमस्ते दुनिया", "a​b ﻿c", GERMAN, LONG[:5000]):
        assert np.frombuffer(known.ids(text), "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0], text


def test_shards(spark):
    rows = sharding.report(documents(spark)).collect()
    assert len(rows) == len(ROWS) and all(r.grown_shard is None for r in rows)
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_merkle(spark):
    rows = merkle.report(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    empty = [r for r in rows if r.doc_id in (3, 4)]
    assert len({r.fingerprint for r in empty}) == 1 and {r.n_chars for r in empty} == {0}
    one = merkle.report(documents(spark, [(1, "abcdefgh", None, None)])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0


def test_merkle_covers_every_character(spark):
    texts = ["a b", " a b", "a b ", "a  b", "a\nb", "a\n\nb", "\na\nb", "a\tb", "a\x0bb", "\n", "\n\n", " ", "a b", "line\n" * 20, "line\n" * 19 + "line"]
    rows = merkle.fingerprints(documents(spark, [(k, t, None, None) for k, t in enumerate(texts)])).collect()
    assert len({r.fingerprint for r in rows}) == len(texts)


def test_differing_branches(spark):
    a = "\n".join(f"line {k} with a few words" for k in range(40))
    b = a.replace("line 17 with", "line 17 without")
    rows = {r.doc_id: r.fingerprint for r in merkle.fingerprints(documents(spark, [(1, a, None, None), (2, b, None, None)])).collect()}
    pair = spark.createDataFrame([(rows[1], rows[2])], "a string, b string")
    assert pair.select(merkle.differing(pair.a, pair.b)).first()[0] == [17]


def test_simhash(spark):
    rows = simhash.report(documents(spark)).collect()
    codes = [fingerprint(t) for _, t, *_ in ROWS]
    want = linked_components(dict(enumerate(codes)))
    best = {}
    for k, root in want.items():
        known = [i for i in (best.get(root), ROWS[k][0]) if i is not None]
        best[root] = min(known, default=None)
    assert sorted(map(repr, ((r.doc_id, r.fingerprint, r.component_id) for r in rows))) == sorted(
        map(repr, ((ROWS[k][0], f"{codes[k]:016x}", best[want[k]]) for k in range(len(ROWS)))))


@pytest.mark.parametrize("masks, radius", [(simhash.band_masks(), 0), (simhash.band_masks(bands=4, joined=1), 1), (simhash.band_masks(bands=1, joined=1), 4)])
def test_forest_against_all_pairs(spark, masks, radius):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = codes[rng.integers(0, 400, 500)].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    codes = np.unique(np.concatenate((codes, near)))
    table = spark.createDataFrame([(k, bytes(c.tobytes())) for k, c in enumerate(codes)], "node long, code binary")
    links = simhash.find_links(table, masks, 1, 4, radius, ratio=2, per_leaf=16)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    want = linked_components(dict(enumerate(codes.tolist())))
    assert {k: got.get(k, k) for k in want} == want and len(got) > 200


def test_crowded_shards_are_split(spark):
    rng = np.random.default_rng(9)
    codes = np.unique(np.concatenate([np.uint64(0) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)),
                                      rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    table = spark.createDataFrame([(k, bytes(c.tobytes())) for k, c in enumerate(codes)], "node long, code binary")
    links = simhash.find_links(table, simhash.band_masks(), 1, 4, block=20)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    want = linked_components(dict(enumerate(codes.tolist())))
    assert {k: got.get(k, k) for k in want} == want


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 5), (2000, 2001), (7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(301)}, 1000: 0, 2000: 2000, 2001: 2000}


def test_near_dedup(spark):
    words = LONG.split()
    base = [" ".join(words[300 * k:300 * k + 300]) for k in range(30)]
    rows = [(k, t, "en", "a") for k, t in enumerate(base)] + [(100 + k, t.replace(t.split()[77], "changed", 1) + " more", "en", "a") for k, t in enumerate(base)]
    assert sorted(r.doc_id for r in simhash.dedup(documents(spark, rows)).collect()) == list(range(30))


def test_near_dedup_at_the_bound(spark):
    def text(k, changed=()):
        return " ".join(f"new{k}x{i}" if i in changed else f"w{k}x{i}" for i in range(454))  # 450 shingles

    bound, under = range(20, 440, 42), range(20, 440, 38)  # 400 of 500 and 390 of 510 or so alike
    assert len(bound) == 10 and len(under) > 10
    rows = [(k, text(k, c), "en", "a") for k in range(120) for c in ((), bound)]
    rows = [(2 * k + (k % 2), t, lang, s) for k, (_, t, lang, s) in enumerate(rows)]
    firsts = {r[0] for r in rows[::2]}
    rows += [(10_000 + 2 * k + j, text(5000 + k, c), "en", "a") for k in range(30) for j, c in enumerate(((), under))]
    firsts |= set(range(10_000, 10_060))
    short = [" ".join(f"s{k}y{i}" for i in range(9)) for k in range(120)]  # 5 shingles, of which the copy has 4
    rows += [(20_000 + 2 * k + j, t, "en", "a") for k, s in enumerate(short) for j, t in enumerate((s, s.rsplit(" ", 1)[0]))]
    firsts |= set(range(20_000, 20_240, 2))
    assert {r.doc_id for r in simhash.dedup(documents(spark, rows)).collect()} == firsts
    assert {r.doc_id for r in simhash.dedup(documents(spark, rows[:40]), block=600).collect()} == {r[0] for r in rows[:40:2]}


@pytest.mark.parametrize("changed", [4, 22])
def test_near_dedup_of_a_crowd(spark, changed):
    """A group cut into blocks, of which most rows or only some are one component."""
    rng = np.random.default_rng(changed)
    base = [f"w{i}" for i in range(304)]
    texts = []
    for k in range(60):
        words = list(base)
        for i in rng.choice(304, rng.integers(1, changed), replace=False):
            words[i] = f"x{k}y{i}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i:i + 5]) for i in range(300)} for t in texts]
    label = list(range(60))
    for i in range(60):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    firsts = {label.index(x) for x in label}
    assert len(firsts) < 60 and (len(firsts) > 1) == (changed > 10)
    kept = simhash.dedup(documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]), block=1200).collect()
    assert {r.doc_id for r in kept} == firsts


def test_repeated_lines_link_nothing(spark):
    line = "this line of eleven words stands in each of the documents "
    rows = [(k, line * 60 + " ".join(f"own{k}x{i}" for i in range(404)), "en", "a") for k in range(8)]
    rows += [(100 + k, rows[k][1].replace(line, line * 2, 1), "en", "a") for k in range(8)]  # the same set
    assert {r.doc_id for r in simhash.dedup(documents(spark, rows)).collect()} == set(range(8))


def test_set_links_connect_every_pair():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(40, rng.integers(0, 12))).astype(np.uint64) for _ in range(150)]
    sets += [np.unique(np.append(s, np.uint64(99))) for s in sets[:60]]
    near = [(i, j) for i in range(210) for j in range(i) if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))]
    links = simhash.set_links(np.arange(210), sets, 0.8)
    assert {(max(p), min(p)) for p in links} <= set(near) and len(near) > len(links)
    label = list(range(210))
    for u, v in links:
        label = [label[u] if x == label[v] else x for x in label]
    assert all(label[i] == label[j] for i, j in near)


PAGES = [(1, "http://a.example/x", "<p>" + "same payload " * 20), (2, "http://a.example/ä b\r\n%41", "<p>" + "same payload " * 20), (3, None, None), (4, "http://b.example", ""),
         (5, "http://b.example", "short"), (6, "http://b.example", "short"), (None, "http://c.example", "<p>" + "same payload " * 20), (7, "http://a.example/x", "é" * 3_000_000),
         (1, "http://a.example/x", "<p>" + "same payload " * 20)]


def test_warc(spark, tmp_path):
    folder = str(tmp_path / "archives")
    warc.write(pages(spark, PAGES), folder)
    rows = warc.read(spark, folder).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        url, html = next((u, h or "") for i, u, h in PAGES if i == r.page_id and (i is not None or u == r.url))
        revisit = r.page_id in (2, None)
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        assert (r.record_type, r.refers_to, r.html) == (("revisit", 1, None) if revisit else ("response", None, html))
    assert warc.report(pages(spark, [])).count() == 0


def test_warc_files_are_gzip_members(spark, tmp_path):
    import gzip

    folder = tmp_path / "archives"
    warc.write(pages(spark, PAGES), str(folder))
    files = [p for p in folder.rglob("part-*")]
    assert sum(gzip.decompress(p.read_bytes()).count(b"WARC/1.1\r\n") for p in files) == len(PAGES)
    data = max(files, key=lambda p: p.stat().st_size).read_bytes()
    with pytest.raises((ValueError, zlib.error)):
        list(warc.members(data[:-9]))
    record = next(warc.members(data))
    with pytest.raises(ValueError):
        warc.parse(record.replace(b"payload", b"Payload", 1) if b"payload" in record else record[:-5])


def test_warc_archives_are_bounded(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, "http://a.example", rng.bytes(3000).hex()) for k in range(200)]
    warc.write(pages(spark, rows).coalesce(1), str(tmp_path / "archives"), archive_bytes=50_000)
    sizes = [p.stat().st_size for p in (tmp_path / "archives").rglob("part-*")]
    assert len(sizes) > 8 and max(sizes) < 55_000
    found = warc.read(spark, str(tmp_path / "archives")).collect()
    assert sorted((r.page_id, r.html) for r in found) == sorted((i, h) for i, _, h in rows)


SITE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="no-sidebar"><nav><ul><li>Home</ul></nav>
<div class="site-header">Brand</div><div class="cookie-notice">We use cookies</div>{main}<aside>Side</aside><section id="comments"><p>First!</p></section>
<form><p>Search</p></form><footer>&copy; 2024</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "http://a.example/1", SITE.format(main="<article><h1>Title  &amp;\n more</h1><p><b>One<br>two<p>Three &lt;x&gt;&nbsp;4<div class=ad>Buy</div><ul><li>a<li>b</ul></article>")),
            (2, None, None), (3, "http://a.example/2", ""), (4, "no url", "plain text <3 and\n more"), (5, "http://a.example/3", "<article><p>cut off <a hre"),
            (6, "http://a.example/4", "<!-- open <p>x</p>"), (7, "http://a.example/5", SITE.format(main="<div><p>Only a div</p></div>"))]
    got = {r.page_id: r for r in styletree.report(pages(spark, rows)).collect()}
    assert got[1].text == "Title & more\nOne two\nThree <x> 4\na\nb"
    assert [got[k].text for k in (2, 3, 6)] == ["", "", ""] and got[1].n_chars == len(got[1].text)
    assert got[4].text == "plain text <3 and more" and got[5].text == "cut off" and got[7].text == "Only a div"
    assert styletree.report(pages(spark, [])).count() == 0


def test_low_branches_go(spark):
    page = "<html><body><div class=top>Same on each page</div><div class=story><p>{0} alone</p><p>and {0} again</p></div></body></html>"
    rows = [(k, "http://h.example/" + str(k), page.format(f"story {k * k}")) for k in range(30)]
    got = {r.page_id: r.text for r in styletree.report(pages(spark, rows)).collect()}
    assert got == {k: f"story {k * k} alone\nand story {k * k} again" for k in range(30)}
    tree = {r.importance < styletree.LOW: r.pages for r in styletree.style_tree(pages(spark, rows)).collect()}
    assert tree == {True: 30, False: 60} or tree.keys() == {True, False}


def test_menu_with_variants_goes(spark):
    page = "<html><body><div class=top>{0}</div><div class=story><p>story {1} alone</p></div></body></html>"
    rows = [(k, "http://h.example/" + str(k), page.format(f"Menu {k}" if k % 10 == 0 else "Menu", k)) for k in range(200)]
    got = {r.page_id: r.text for r in styletree.report(pages(spark, rows)).collect()}
    assert got == {k: f"story {k} alone" for k in range(200)}
    copied = [(k, "http://c.example/" + str(k), page.format("Menu", 7)) for k in range(40)]
    assert {r.text for r in styletree.report(pages(spark, copied)).collect()} == {"Menu\nstory 7 alone"}


def test_copies_of_one_article_stay(spark):
    page = SITE.format(main="<article><h1>Same</h1><p>The same words</p></article>")
    got = {r.text for r in styletree.report(pages(spark, [(k, "http://h.example/", page) for k in range(40)])).collect()}
    assert got == {"Same\nThe same words"}
