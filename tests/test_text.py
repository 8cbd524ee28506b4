from pyspark.sql import functions as F

from caselane.functions import text as tx
from caselane.operators import features, ngrams, quality

TEXTS = [(1, ""), (2, "   "), (3, "😡"), (4, None), (5, "Where is my ORDER {{Order Number}}? {{Date}}"), (6, "a OK NOW"),
         (7, "été LÀ-BAS 2FA"), (8, "x y\nz")]


def column(spark, expr):
    df = spark.createDataFrame(TEXTS, "id int, t string")
    return {r.id: r.v for r in df.select("id", expr(F.col("t")).alias("v")).collect()}


def test_lengths_follow_python(spark):
    chars, words = column(spark, tx.char_len), column(spark, tx.word_len)
    for i, t in TEXTS:
        assert chars[i] == len(t or "")
        assert words[i] == len((t or "").split())


def test_caps_follow_python(spark):
    got = column(spark, tx.has_all_caps)
    for i, t in TEXTS:
        assert got[i] == int(any(len(w) > 3 and w.isupper() for w in (t or "").split()))


def test_slots(spark):
    assert column(spark, tx.slot_count)[5] == 2
    assert column(spark, tx.slot_names)[5] == ["Order Number", "Date"]


def test_bigrams_form_after_stop_words(spark):
    df = spark.createDataFrame([(1, "speak to the manager now"), (2, "the"), (3, "")], "id int, t string")
    got = {r.id: r.v for r in df.select("id", ngrams.terms_of(F.col("t"), ["the", "to"]).alias("v")).collect()}
    assert got == {1: ["speak", "manager", "now", "speak manager", "manager now"], 2: [], 3: []}


def test_normalize_and_noise(spark):
    df = spark.createDataFrame([(1, "@AppleCare see https://t.co/x1 &amp; #fail 😡😡")], "id int, t string")
    row = features.noise_profile(df, "t").first()
    assert (row.handles, row.urls, row.emoji, row.entities, row.hashtags) == (1, 1, 2, 1, 1)
    assert features.normalize_handles_urls(df, "t").first().normalized == "@USER see HTTPURL &amp; #fail 😡😡"


def test_explicit_requests(spark):
    rows = [(1, "I want to speak with a manager right now", 1), (2, "Get me a REAL PERSON", 1), (3, "talk is cheap", 0)]
    df = spark.createDataFrame(rows, "id int, t string, want int")
    assert features.keyword_rule(df, "t").filter("rule_hit <> want").count() == 0


def test_request_features(spark):
    rows = [("BQZ", "cancel {{Order}}", "ORDER", "cancel_order"), (None, "agent", "CONTACT", "contact_human_agent")]
    out = features.request_features(spark.createDataFrame(rows, "flags string, instruction string, category string, intent string"))
    a, b = out.orderBy("category").collect()[::-1]
    assert (a.escalated, a.flag_basic_syntax, a.flag_colloquial, a.flag_typos_errors, a.flag_polite) == (0, 1, 1, 1, 0)
    assert (a.entity_count_instruction, a.word_len_instruction) == (1, 2)
    assert b.escalated == 1 and sum(b[c] for c in out.columns if c.startswith("flag_")) == 0


def test_quality_small(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "row_id long, t string")
    assert quality.duplicate_summary(df, "t").first()[:] == (4, 2, 50.0)
    assert sorted(quality.dedup_first(df, "t", "row_id").collect()) == [(1, "a"), (3, "b")]
    assert quality.describe(spark.range(1, 5), "id").first().q25 == 1.75
    assert quality.cross_split_leakage(df.filter("row_id < 3"), df.filter("row_id >= 3"), "t").first()[:] == (2, 1, 1, 50.0)
