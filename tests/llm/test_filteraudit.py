"""The filter audit against applying every order of filters to every document."""

from collections import Counter
from itertools import permutations
import re

from caselane.llm import filteraudit

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def expected(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    known = []
    for i, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        fails |= {"D"} if set("#$%&*|") & set(t) else set()
        fails |= {"E"} if i is not None and i > smallest[t] else set()
        known.append((source or "", fails, i in good and i is not None, i in toxic and i is not None))
    out, shapley = {}, Counter()
    for part in {k[0] for k in known}:
        for order in permutations("ABCDE"):
            left = [k for k in known if k[0] == part]
            for step, name in enumerate(order, 1):
                gone = [k for k in left if name in k[1]]
                stay = [k for k in left if name not in k[1]]
                failing = [k for k in known if k[0] == part and name in k[1]]
                out[part, "".join(order), step] = [len(stay), len(gone), len(failing) - len(gone), sum(k[1] == {name} for k in failing),
                                                   sum(k[2] for k in gone), sum(k[3] for k in gone)]
                shapley[part, name] += len(gone)
                left = stay
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def listed(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in FIELDS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_tables(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    want = expected([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert listed(filteraudit.report(docs, labels)) == want


def test_awkward_rows(spark):
    long = " ".join(f"word{k}" for k in range(60))
    docs = [(1, long, "a"), (2, long, "a"), (2, long, None), (1, long, ""), (3, None, None), (4, "", "a"), (None, long, "a"), (None, None, "b"),
            (5, "Ab#" * 30_000, "é"), (6, "the " * 70, "a"), (7, long.upper(), "a"), (8, " \n\t", "a"), (9, "no id", "a"), (9, "no id", "a")]
    labels = [(1, 1, 0), (2, None, 1), (2, 1, None), (9, 0, 1), (None, 1, 1), (77, 1, 1), (7, 1, 1), (7, 1, 1)]
    d = spark.createDataFrame([(*r, "x", "y", "z") for r in docs], "doc_id long, text string, source string, part string, failed string, quality string")
    l = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    assert listed(filteraudit.report(d, l)) == expected(docs, labels)
    assert filteraudit.report(d.limit(0), l).collect() == []
    none = listed(filteraudit.report(d, l.limit(0)))
    assert none == expected(docs, [])


def test_hot_text_and_part(spark):
    docs = [(k, "same text" if k % 3 else f"text {k}", "hot") for k in range(3000)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    l = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 3000, 7)], "doc_id long, quality int, toxic int")
    assert listed(filteraudit.report(d, l)) == expected(docs, [tuple(r) for r in l.collect()])


def test_weights_are_those_of_all_orders():
    """The least squares give what each filter adds, averaged over the orders."""
    for n in (2, 3, 5):
        weights = filteraudit.shapley_weights(n)
        for k in range(n):
            want = Counter()
            for order in permutations(range(n)):
                before = sum(1 << j for j in order[:order.index(k)])
                want[before | 1 << k] += 1
                want[before] -= 1
            want[0] = 0  # nothing goes without a filter
            assert {s: w for s, w in enumerate(weights[k]) if w} == {s: w for s, w in want.items() if w}
