"""Queries on the n-gram model: relations first, then fitted models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from caselane.functions import text as tx
from caselane.operators import classify, evaluate, ngrams
from caselane.plans.registry import query
from caselane.plans.tables import split_sql
from caselane.session import durable, scratch_path, written
from caselane.sources.readers import load_model, save_model
from caselane.sources.views import with_views

# A short explicit list, so that the checking SQL can hold it.
STOP = ["the", "of", "and", "is", "le", "la", "der", "die", "de", "el"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)

TOKENS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
WORDS_SQL = f"list_filter({TOKENS_SQL}, lambda w: w NOT IN ({STOP_SQL}))"


def terms_sql(source: str = "documents") -> str:
    return f"""words AS (SELECT doc_id, {WORDS_SQL} AS w FROM {source}),
    t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
    FROM words), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
    vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df FROM tf GROUP BY term ORDER BY n DESC, term
    LIMIT 10000), x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM words)) / (1 + df)) + 1)
    AS w FROM tf JOIN vocab USING (term)), weights AS (SELECT doc_id, term, w / sqrt(sum(w * w)
    OVER (PARTITION BY doc_id)) AS weight FROM x) """


TERMS = "WITH " + terms_sql()


@query("tokenize", f"SELECT doc_id, CAST(len({TOKENS_SQL}) AS INTEGER) AS n, array_to_string({TOKENS_SQL}, ' ') AS tokens FROM documents")
def tokenize(v):
    out = ngrams.tokenize(v.table("documents"), "text")
    return out.select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query("stopwords", f"SELECT doc_id, array_to_string({WORDS_SQL}, ' ') AS kept FROM documents")
def stopwords(v):
    out = ngrams.remove_stopwords(ngrams.tokenize(v.table("documents"), "text"), STOP)
    return out.select("doc_id", F.array_join("tokens", " ").alias("kept"))


@query("ngrams", f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents)
    SELECT doc_id, CAST(len(w) + greatest(len(w) - 1, 0) AS INTEGER) AS n, array_to_string(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), '|') AS terms FROM w""")
def grams(v):
    words = ngrams.remove_stopwords(ngrams.tokenize(v.table("documents"), "text"), STOP)
    out = ngrams.ngrams(words)
    return out.select("doc_id", F.size("terms").alias("n"), F.array_join("terms", "|").alias("terms"))


@query("vocabulary", TERMS + "SELECT term, n, df FROM vocab")
def vocabulary(v):
    return ngrams.vocabulary(v.table("documents"), "doc_id", "text", STOP)


def weights(v):
    return ngrams.tfidf(v.table("documents"), "doc_id", "text", STOP)


@query("tfidf_weights", TERMS + "SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf_weights(v):
    return weights(v)


@query("class_weights", with_views("labeled", """SELECT escalated AS label, count(*) AS n,
    round(sum(count(*)) OVER () / (2.0 * count(*)), 6) AS weight FROM labeled GROUP BY escalated"""))
def class_weights(v):
    return ngrams.class_weights(v.labeled)


@query("linear_score", TERMS + """, coefs AS (SELECT term, (CAST(length(term) AS DOUBLE) - 6) / 4 AS coef FROM vocab)
    SELECT doc_id, round(1 / (1 + exp(-(coalesce(sum(weight * coef), 0) - 0.25))), 6) AS y_prob
    FROM weights LEFT JOIN coefs USING (term) GROUP BY doc_id""")
def linear_score(v):
    terms = written(vocabulary(v), "vocabulary")
    coefs = written(terms.select("term", ((F.length("term").cast("double") - 6) / 4).alias("coef")), "coefficients")
    weighed = ngrams.tfidf(v.table("documents"), "doc_id", "text", STOP, terms=terms)
    return ngrams.linear_score(weighed, coefs, "doc_id", -0.25)


@query("score_with", f"""WITH s AS (SELECT doc_id, (len(text) % 1009 + 1009.0 * len({TOKENS_SQL})) / 1e6 AS z FROM documents)
    SELECT doc_id, round(1 / (1 + exp(-(z - 0.1) * 5)), 6) AS y_prob, CAST(1 / (1 + exp(-(z - 0.1) * 5)) >= 0.5 AS INTEGER) AS y_pred FROM s""")
def score_with(v):
    """Any Python model over whole texts; here one that reads the length and counts the tokens itself."""

    def make_scorer():
        import regex

        word = regex.compile(r"[\p{L}\p{N}_]{2,}")

        def scorer(texts):
            marks = [(len(t) % 1009 + 1009.0 * len(word.findall(t.lower()))) / 1e6 for t in texts]
            return [1 / (1 + math.exp(-(z - 0.1) * 5)) for z in marks]

        return scorer

    return classify.score_with(v.table("documents"), make_scorer, "doc_id", "text")


# --- fitted models: the SQL fits them again, another way ---------------------------------------------------------

def training(v):
    return v.labeled.select("thread_id", F.col("first_customer_text").alias("text"), "escalated", "lang")


BASE = ", base AS (SELECT thread_id, escalated FROM labeled), "
ROUNDS = 1000  # accelerated gradient steps of the SQL


def refit_sql(arms: str, stop: str) -> str:
    """Common tables that fit every arm and score its rows; ends in table ``scored`` (arm, thread_id, y, member, p).

    ``arms`` is SQL of rows (arm, c, pairs, thread_id, member): the labelled rows that an arm is trained on (member 1) or scores
    alone (0). The coefficients at the optimum are sums of training rows, so the steps (Nesterov's, in the number of rows, from
    inner products alone) share nothing with the optimiser that they check.
    """
    words = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({stop}))"
    return f"""arms AS MATERIALIZED ({arms}),
    words AS (SELECT thread_id, escalated AS y, {words} AS w FROM (SELECT thread_id, escalated, first_customer_text AS text FROM labeled)),
    terms AS (SELECT thread_id, unnest(w) AS term, false AS pair FROM words UNION ALL
        SELECT thread_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), true FROM words),
    tf AS (SELECT thread_id, term, pair, count(*) AS tf FROM terms GROUP BY ALL),
    vocab AS (SELECT arm, term, count(*) AS df FROM tf JOIN arms USING (thread_id) WHERE member = 1 AND (pairs = 1 OR NOT pair)
        GROUP BY arm, term QUALIFY row_number() OVER (PARTITION BY arm ORDER BY sum(tf) DESC, term) <= 10000),
    sizes AS (SELECT arm, any_value(c) AS c, count(*) AS n, sum(y) AS n1 FROM arms JOIN words USING (thread_id) WHERE member = 1 GROUP BY arm),
    raw AS (SELECT arm, thread_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w
        FROM arms JOIN tf USING (thread_id) JOIN vocab USING (arm, term) JOIN sizes USING (arm)),
    x AS MATERIALIZED (SELECT arm, thread_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY arm, thread_id)) AS w FROM raw),
    rows_ AS MATERIALIZED (SELECT arm, thread_id, member, y, sizes.c * CASE WHEN y = 1 THEN n / (2.0 * n1) ELSE n / (2.0 * (n - n1)) END AS cost,
        CASE WHEN member = 1 THEN row_number() OVER (PARTITION BY arm, member ORDER BY thread_id) END AS j
        FROM arms JOIN words USING (thread_id) JOIN sizes USING (arm)),
    products AS (SELECT a.arm, a.thread_id, r.j, sum(a.w * b.w) AS k FROM x a JOIN x b ON a.arm = b.arm AND a.term = b.term
        JOIN rows_ r ON r.arm = b.arm AND r.thread_id = b.thread_id AND r.member = 1 GROUP BY ALL),
    pairs_ AS (SELECT r.arm, r.thread_id, t.j, coalesce(k, 0) AS k, sqrt(r.cost * t.cost) AS cost FROM rows_ r
        JOIN rows_ t ON r.arm = t.arm AND t.member = 1 LEFT JOIN products p ON p.arm = r.arm AND p.thread_id = r.thread_id AND p.j = t.j),
    kernel AS MATERIALIZED (SELECT arm, thread_id, list(k ORDER BY j) AS k, sum(cost * (k + 1)) AS bound FROM pairs_ GROUP BY arm, thread_id),
    steps AS MATERIALIZED (SELECT arm, 1 + max(bound) / 4 AS l, (sqrt(1 + max(bound) / 4) - 1) / (sqrt(1 + max(bound) / 4) + 1) AS m
        FROM kernel JOIN rows_ USING (arm, thread_id) WHERE member = 1 GROUP BY arm),
    trained AS MATERIALIZED (SELECT arm, j, k, y, cost FROM rows_ JOIN kernel USING (arm, thread_id) WHERE member = 1),
    fit AS (SELECT arm, 0 AS round_, list_transform(range(n), lambda i: 0.0::DOUBLE) AS beta, list_transform(range(n), lambda i: 0.0::DOUBLE) AS was,
            0.0::DOUBLE AS b, 0.0::DOUBLE AS b_was FROM sizes
        UNION ALL
        SELECT arm, round_ + 1, list(v[j] + (cost * (y - 1 / (1 + exp(-(list_dot_product(k, v) + bv)))) - v[j]) / l ORDER BY j), any_value(beta),
            any_value(bv) + sum(cost * (y - 1 / (1 + exp(-(list_dot_product(k, v) + bv))))) / any_value(l), any_value(b)
        FROM (SELECT fit.arm, round_, beta, b, l, b + m * (b - b_was) AS bv,
                list_transform(list_zip(beta, was), lambda z: z[1] + m * (z[1] - z[2])) AS v FROM fit JOIN steps ON fit.arm = steps.arm
              WHERE round_ < {ROUNDS}) f JOIN trained USING (arm) GROUP BY arm, round_),
    scored AS (SELECT arm, thread_id, y, member, 1 / (1 + exp(-(list_dot_product(k, beta) + b))) AS p
        FROM rows_ JOIN kernel USING (arm, thread_id) JOIN fit USING (arm) WHERE round_ = {ROUNDS}) """


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


CELLS_SQL = """count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 0 AND p >= 0.5) AS fp,
    count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 1 AND p >= 0.5) AS tp"""
MEASURED_SQL = """round((2.0 * tn / greatest(2 * tn + fn + fp, 1) + 2.0 * tp / greatest(2 * tp + fn + fp, 1)) / 2, 6) AS f1_macro, tn, fp, fn, tp"""


def measured(metrics, *keys):
    """Macro F1 and the confusion cells of each arm."""
    return metrics.select(*keys, "f1_macro", "tn", "fp", "fn", "tp")


@query("fit_and_score", recursive(with_views("labeled", BASE + split_sql("base", 0.2, "42") + ", "
    + refit_sql("SELECT 0 AS arm, 1.0 AS c, 1 AS pairs, thread_id, CAST(NOT taken AS INTEGER) AS member FROM part", STOP_SQL)
    + "SELECT thread_id, member AS trained, y AS escalated, round(p, 4) AS y_prob FROM scored")))
def fit_and_score(v):
    """Train on the training part and score every labelled thread, to four digits."""
    from caselane.operators.split import stratified_split

    rows = training(v)
    ids = stratified_split(rows.select("thread_id", "escalated"), "escalated", "thread_id")
    parts = written(rows.join(ids.select("thread_id", (F.col("split") == "train").cast("int").alias("trained")), "thread_id"), "parts")
    model = classify.fit(parts.filter("trained = 1"), "thread_id", "text", "escalated", stop=STOP)
    scored = classify.score(model, parts)
    return scored.select("thread_id", "trained", "escalated", (F.round(F.col("y_prob") * 1e4) / 1e4).alias("y_prob"))


@query("fit_gradient", with_views("labeled", BASE + split_sql("base", 0.2, "42") + """, train AS (SELECT d.doc_id, d.text
    FROM part JOIN documents d ON d.doc_id = thread_id WHERE NOT taken), """ + terms_sql("train")
    + "SELECT term, CAST(0 AS DOUBLE) AS gradient FROM vocab"))
def fit_gradient(v):
    """Per term the gradient of the penalised loss at the fit, to five digits: 0 for every term of an optimum.

    It is worked out from the coefficient table by joins, apart from the solver.
    """
    from caselane.operators.split import stratified_split

    rows = training(v)
    ids = stratified_split(rows.select("thread_id", "escalated"), "escalated", "thread_id")
    train = written(rows.join(ids.filter("split = 'train'").select("thread_id"), "thread_id"), "train")
    model = classify.fit(train, "thread_id", "text", "escalated", stop=STOP)
    table, intercept = classify.model_table(v.spark, model)
    counts = ngrams.known_counts(train, table, "thread_id", "text", STOP)
    weights_ = ngrams.weigh(counts, "thread_id")
    scored = classify.score(model, train).select("thread_id", "escalated", "y_prob")
    sizes = {r.label: r for r in ngrams.class_weights(train).collect()}
    gap = F.when(F.col("escalated") == 1, (F.col("y_prob") - 1) * sizes[1].weight).otherwise(F.col("y_prob") * sizes[0].weight)
    loss = weights_.join(scored.select("thread_id", gap.alias("gap")), "thread_id").groupBy("term").agg(F.sum(F.col("weight") * F.col("gap")).alias("g"))
    slope = F.coalesce("g", F.lit(0.0)) + F.col("coef")
    return table.join(loss, "term", "left").select("term", F.abs(F.round(slope, 5)).alias("gradient"))


@query("table_score", "SELECT doc_id, CAST(0 AS DOUBLE) AS difference FROM documents")
def table_score(v):
    """The same fit applied as a table of coefficients and as a pipeline: how far apart they are, for every document."""
    model = classify.fit(training(v), "thread_id", "text", "escalated", stop=STOP)
    table, intercept = classify.model_table(v.spark, model)
    documents = v.table("documents")
    by_table = ngrams.table_score(documents, table, "doc_id", "text", STOP, intercept)
    by_model = classify.score(model, documents.select("doc_id", "text")).select("doc_id", F.col("y_prob").alias("p"))
    return by_table.join(by_model, "doc_id").select("doc_id", F.abs(F.round(F.col("y_prob") - F.col("p"), 6)).alias("difference"))


@query("model_selection", recursive(with_views("labeled", BASE + split_sql("base", 0.2, "42")
    + ", tr AS (SELECT thread_id, escalated FROM part WHERE NOT taken), " + split_sql("tr", 0.1, "42-val", extra="2") + ", "
    + refit_sql("""SELECT CAST(k + g * 10 AS INTEGER) AS arm, [0.1, 1.0, 10.0][k] AS c, g - 1 AS pairs, thread_id, CAST(NOT taken AS INTEGER) AS member
        FROM part2, range(1, 4) s(k), range(1, 3) m(g)""", STOP_SQL)
    + f""", cells AS (SELECT [0.1, 1.0, 10.0][arm % 10] AS setting, arm // 10 AS ngram, {CELLS_SQL} FROM scored WHERE member = 0 GROUP BY arm)
    SELECT CAST(setting AS DOUBLE) AS setting, CAST(ngram AS INTEGER) AS ngram, {MEASURED_SQL}, CAST(row_number() OVER (ORDER BY
    round((2.0 * tn / greatest(2 * tn + fn + fp, 1) + 2.0 * tp / greatest(2 * tp + fn + fp, 1)) / 2, 12) DESC, setting, ngram) = 1 AS INTEGER)
    AS selected FROM cells""")))
def model_selection(v):
    out = classify.select_on_validation(training(v), "thread_id", "text", "escalated", [0.1, 1.0, 10.0], stop=STOP)
    return measured(out, "setting", "ngram").join(out.select("setting", "ngram", "selected"), ["setting", "ngram"])


SEEDS = [42, 1337, 2024]


@query("seed_runs", recursive(with_views("labeled", BASE + ", ".join(split_sql("base", 0.2, str(s), extra=f"_{s}") for s in SEEDS) + ", "
    + refit_sql(" UNION ALL ".join(f"SELECT {s} AS arm, 1.0 AS c, 1 AS pairs, thread_id, CAST(NOT taken AS INTEGER) AS member FROM part_{s}"
                                   for s in SEEDS), STOP_SQL)
    + f""", cells AS (SELECT arm, {CELLS_SQL} FROM scored WHERE member = 0 GROUP BY arm)
    SELECT CAST(arm AS INTEGER) AS seed, {MEASURED_SQL} FROM cells""")))
def seed_runs(v):
    return measured(classify.seed_runs(training(v), "thread_id", "text", "escalated", SEEDS, stop=STOP), "seed")


CURVE_SHARES = {"quarter": 0.25, "half": 0.5, "most": 0.9}


@query("learning_curve", recursive(with_views("labeled", BASE + split_sql("base", 0.2, "42")
    + ", inner_ AS (SELECT thread_id, escalated FROM part WHERE NOT taken), "
    + ", ".join(split_sql("inner_", f, "42", extra=f"_{n}") for n, f in CURVE_SHARES.items()) + ", "
    + refit_sql(" UNION ALL ".join(f"""SELECT {k} AS arm, 1.0 AS c, 1 AS pairs, thread_id, 1 AS member FROM part_{n} WHERE taken UNION ALL
        SELECT {k}, 1.0, 1, thread_id, 0 FROM part WHERE taken""" for k, n in enumerate(CURVE_SHARES)), STOP_SQL)
    + f""", cells AS (SELECT arm, {CELLS_SQL} FROM scored WHERE member = 0 GROUP BY arm)
    SELECT {list(CURVE_SHARES)}[arm + 1] AS size_name, {MEASURED_SQL} FROM cells""")))
def learning_curve(v):
    return measured(classify.learning_curve(training(v), "thread_id", "text", "escalated", CURVE_SHARES, stop=STOP), "size_name")


@query("cross_domain", recursive(with_views("labeled", ", "
    + refit_sql("SELECT 0 AS arm, 1.0 AS c, 1 AS pairs, thread_id, CAST(lang = 'en' AS INTEGER) AS member FROM labeled", STOP_SQL)
    + f""", cells AS (SELECT lang, {CELLS_SQL} FROM scored JOIN labeled USING (thread_id) GROUP BY lang)
    SELECT lang, {MEASURED_SQL} FROM cells""")))
def cross_domain(v):
    """Fit on English and save; the loaded model scores every language without fitting again."""
    rows = training(v)
    model = classify.fit(rows.filter("lang = 'en'"), "thread_id", "text", "escalated", stop=STOP)
    model = load_model(save_model(model, scratch_path(v.spark, "model")))
    return measured(classify.evaluate(model, rows, "escalated", ("lang",)), "lang")


@query("nearest_intent", TERMS + """, centroid AS (SELECT source, term, sum(weight) AS w FROM weights
    JOIN documents USING (doc_id) WHERE lang = 'en' GROUP BY 1, 2), unit AS (SELECT source, term,
    w / sqrt(sum(w * w) OVER (PARTITION BY source)) AS w FROM centroid),
    missed AS (SELECT doc_id FROM labels WHERE toxic = 1), c AS (SELECT doc_id, source AS intent, sum(weight * w) AS cosine
    FROM weights JOIN missed USING (doc_id) JOIN unit USING (term) GROUP BY 1, 2)
    SELECT doc_id, intent, round(cosine, 6) AS cosine FROM c QUALIFY row_number() OVER (PARTITION BY doc_id
    ORDER BY round(cosine, 9) DESC, intent DESC) = 1""")
def nearest_intent(v):
    """For each escalated document, the English source whose average vector it is closest to."""
    all_weights = durable(weights(v))
    missed = v.table("labels").filter("toxic = 1").select("doc_id")
    sources = v.table("documents").filter("lang = 'en'").select("doc_id", F.col("source").alias("intent"))
    return evaluate.nearest_intent(
        all_weights.join(missed, "doc_id", "left_semi"), all_weights.join(sources, "doc_id"))
