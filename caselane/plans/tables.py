"""Queries on request tables: readers, quality audit, features, exploratory aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselane.functions import scores as sc, text as tx
from caselane.functions.taxonomy import FLAG_NAMES
from caselane.operators import features, profile, quality, split
from caselane.plans.registry import query
from caselane.session import scratch_path
from caselane.sources import readers, runs
from caselane.sources.views import with_views

WORDS_SQL = (
    r"list_filter(regexp_split_to_array({0}, '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+'), lambda w: w <> '')"
)


def words_sql(column: str) -> str:
    return WORDS_SQL.format(column)


FEATURED = with_views("requests", """, featured AS (SELECT row_id, category, intent,
    CAST(intent IN ('src1', 'src3', 'src5', 'src7') AS INTEGER) AS escalated,
    CAST(length(instruction) AS INTEGER) AS char_len, CAST(len({words}) AS INTEGER) AS word_len
    FROM requests) """.format(words=words_sql("instruction")))

# Sources that stand for escalation intents in the test tables.
TARGETS = ("src1", "src3", "src5", "src7")


def featured(v):
    return features.text_lengths(features.map_target(v.requests, TARGETS), "instruction")


# --- sources -------------------------------------------------------------------------------------------------

@query("messages_typed", """SELECT conv_id * 1000 + turn AS message_id, CAST(role = 'user' AS INTEGER) AS inbound,
    CAST(1507680000 + conv_id * 60 + turn AS BIGINT) AS created_s, CAST(CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END
    AS INTEGER) AS n_responses, CASE WHEN turn % 2 = 0 THEN conv_id * 1000 + turn + 1 END AS first_response,
    CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id FROM conversations""")
def messages_typed(v):
    """Write the conversations the way a tweet file has them, as text, and type them again."""
    ident = F.col("conv_id") * 1000 + F.col("turn")
    at = F.timestamp_seconds(F.lit(1507680000) + F.col("conv_id") * 60 + F.col("turn"))
    raw = v.table("conversations").select(
        ident.alias("tweet_id"), F.col("conv_id").cast("string").alias("author_id"),
        F.initcap((F.col("role") == "user").cast("string")).alias("inbound"),
        F.date_format(at, "EEE MMM dd HH:mm:ss Z yyyy").alias("created_at"), "text",
        F.when(F.col("turn") % 2 == 0, F.concat_ws(",", ident + 1, ident + 2)).otherwise("").alias("response_tweet_id"),
        F.when(F.col("turn") > 0, ident - 1).alias("in_response_to_tweet_id"))
    typed = readers.type_messages(raw)
    return typed.select(
        "message_id", F.col("inbound").cast("int").alias("inbound"),
        F.unix_seconds("created_at").alias("created_s"), F.size("response_ids").alias("n_responses"),
        F.get("response_ids", F.lit(0)).alias("first_response"), "parent_id")


REQUESTS_SQL = """SELECT lang AS flags, text AS instruction, source AS category, lang AS intent, source AS response
    FROM documents"""


def requests_file(v):
    """The documents in the shared folder the way a file of requests has them."""
    rows = v.table("documents").select(
        F.col("lang").alias("flags"), F.col("text").alias("instruction"), F.col("source").alias("category"),
        F.col("lang").alias("intent"), F.col("source").alias("response"))
    return readers.write_quoted_csv(rows, scratch_path(v.spark, "requests"))


@query("requests_csv", REQUESTS_SQL)
def requests_csv(v):
    return readers.read_requests(v.spark, requests_file(v))


@query("requests_bronze", REQUESTS_SQL)
def requests_bronze(v):
    return readers.bronze(readers.read_requests(v.spark, requests_file(v)), scratch_path(v.spark, "bronze"), "instruction")


@query("labeled_csv", with_views("labeled", """SELECT CAST(thread_id AS VARCHAR) AS thread_id, CAST(quality AS INTEGER) AS turn_count,
    escalated, category, lang AS reason, source AS labeler, first_customer_text FROM labeled"""))
def labeled_csv(v):
    rows = v.labeled.select(
        F.col("thread_id").cast("string").alias("thread_id"), F.col("quality").alias("turn_count"), "escalated", "category",
        F.col("lang").alias("reason"), F.col("source").alias("labeler"), "first_customer_text")
    return readers.read_labeled(v.spark, readers.write_quoted_csv(rows, scratch_path(v.spark, "labeled")))


@query("json_explode", """SELECT event_id, 'k' AS name, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value
    FROM events""")
def json_explode(v):
    return runs.explode_json_map(v.table("events"), ["event_id"], "props")


# --- quality audit -------------------------------------------------------------------------------------------

@query("shape", with_views("requests", "SELECT count(*) AS n_rows, CAST(4 AS INTEGER) AS n_cols FROM requests"))
def shape(v):
    return quality.shape(v.requests)


@query("null_summary", with_views("messages", """SELECT 'message_id' AS column_name, count(*) FILTER (message_id IS NULL)
    AS nulls FROM messages UNION ALL SELECT 'parent_id', count(*) FILTER (parent_id IS NULL) FROM messages
    UNION ALL SELECT 'text', count(*) FILTER (text IS NULL) FROM messages"""))
def null_summary(v):
    return quality.null_summary(v.messages.select("message_id", "parent_id", "text"))


@query("duplicate_summary", with_views("requests", """SELECT count(*) AS n_rows,
    count(*) - count(DISTINCT instruction) AS duplicates,
    round((count(*) - count(DISTINCT instruction)) * 100.0 / count(*), 6) AS pct FROM requests"""))
def duplicate_summary(v):
    return quality.duplicate_summary(v.requests, "instruction")


@query("dedup_first", with_views("requests", """SELECT row_id, instruction, category, intent FROM requests
    QUALIFY row_number() OVER (PARTITION BY instruction ORDER BY row_id) = 1"""))
def dedup_first(v):
    return quality.dedup_first(v.requests, "instruction", "row_id")


@query("describe_lengths", with_views("requests", """, t AS (SELECT length(instruction) AS x FROM requests)
    SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, CAST(min(x) AS INTEGER) AS min,
    round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50,
    round(quantile_cont(x, 0.75), 6) AS q75, CAST(max(x) AS INTEGER) AS max FROM t"""))
def describe_lengths(v):
    return quality.describe_lengths(v.requests, "instruction")


@query("top_k_longest", with_views("requests", """SELECT row_id, CAST(length(instruction) AS INTEGER) AS n_chars
    FROM requests ORDER BY n_chars DESC, row_id LIMIT 3"""))
def top_k_longest(v):
    return quality.longest(v.requests, "instruction", "row_id", 3).select("row_id", "n_chars")


@query("top_k_shortest", with_views("requests", """SELECT row_id, CAST(length(instruction) AS INTEGER) AS n_chars
    FROM requests ORDER BY n_chars, row_id LIMIT 3"""))
def top_k_shortest(v):
    return quality.shortest(v.requests, "instruction", "row_id", 3).select("row_id", "n_chars")


@query("value_counts", with_views("requests", "SELECT intent, count(*) AS n FROM requests GROUP BY intent"))
def value_counts(v):
    return quality.value_counts(v.requests, "intent")


@query("value_share", with_views("requests", """SELECT category, count(*) AS n,
    round(count(*) / sum(count(*)) OVER (), 6) AS share FROM requests GROUP BY category"""))
def value_share(v):
    return quality.value_share(v.requests, "category")


@query("preview", with_views("requests", "SELECT row_id, category, intent FROM requests ORDER BY row_id LIMIT 5"))
def preview(v):
    return quality.preview(v.requests, ["row_id", "category", "intent"], "row_id", 5)


@query("split_leakage", with_views("requests", """, s AS (SELECT instruction, category = 'en' AS test FROM requests),
    g AS (SELECT instruction, count(*) FILTER (test) AS te, count(*) FILTER (NOT test) AS tr FROM s GROUP BY 1)
    SELECT CAST(sum(te) AS BIGINT) AS test_rows, count(*) FILTER (te > 0 AND tr > 0) AS leaked_texts,
    CAST(coalesce(sum(te) FILTER (te > 0 AND tr > 0), 0) AS BIGINT) AS leaked_rows,
    round(coalesce(sum(te) FILTER (te > 0 AND tr > 0), 0) * 100.0 / sum(te), 6) AS leaked_pct FROM g"""))
def split_leakage(v):
    rows = v.requests
    return quality.cross_split_leakage(
        rows.filter("category <> 'en'"), rows.filter("category = 'en'"), "instruction")


# --- features ------------------------------------------------------------------------------------------------

@query("map_target", with_views("requests", """SELECT row_id, CAST(intent IN ('src1', 'src3', 'src5', 'src7')
    AS INTEGER) AS escalated FROM requests"""))
def map_target(v):
    return features.map_target(v.requests, TARGETS).select("row_id", "escalated")


@query("taxonomy_join", with_views("requests", """, dim AS (SELECT intent, max(category) AS main_category,
    CAST(max(intent IN ('src1', 'src3', 'src5', 'src7')) AS INTEGER) AS target FROM requests GROUP BY intent)
    SELECT row_id, intent, main_category, target FROM requests JOIN dim USING (intent)"""))
def taxonomy_join(v):
    dimension = v.requests.groupBy("intent").agg(F.max("category").alias("main_category")).withColumn(
        "target", F.col("intent").isin(*TARGETS).cast("int"))
    return features.taxonomy_join(v.requests.drop("category", "instruction"), dimension).select(
        "row_id", "intent", "main_category", "target")


FLAGS_SQL = ", ".join(
    f"CAST(contains(flags, '{k}') AS INTEGER) AS flag_{name}" for k, name in FLAG_NAMES.items())


@query("decompose_flags", with_views("flagged", f"SELECT row_id, {FLAGS_SQL} FROM flagged"))
def decompose_flags(v):
    return features.decompose_flags(v.flagged).drop("intent", "category", "flags")


@query("unknown_flags", with_views("flagged", """, l AS (SELECT DISTINCT row_id, unnest(string_split(flags, ''))
    AS letter FROM flagged) SELECT letter, count(*) AS n FROM l WHERE letter NOT IN
    ('B','I','C','N','M','L','P','Q','W','K','E','Z') AND letter <> '' GROUP BY letter"""))
def unknown_flags(v):
    return features.unknown_flags(v.flagged)


@query("text_lengths", FEATURED + "SELECT row_id, char_len, word_len FROM featured")
def text_lengths(v):
    return featured(v).select("row_id", "char_len", "word_len")


SLOTTED = with_views("requests", """, slotted AS (SELECT row_id, category, intent,
    '{{' || category || '}} ' || instruction || ' {{' || intent || '}}' AS body FROM requests) """)


def slotted(v):
    body = F.concat(F.lit("{{"), "category", F.lit("}} "), "instruction", F.lit(" {{"), "intent", F.lit("}}"))
    return v.requests.withColumn("body", body)


@query("slot_count", SLOTTED + r"""SELECT row_id, CAST(len(regexp_extract_all(body, '\{\{[^}]+\}\}')) AS INTEGER)
    AS slot_count FROM slotted""")
def slot_count(v):
    return slotted(v).select("row_id", tx.slot_count(F.col("body")).alias("slot_count"))


@query("slot_by_intent", SLOTTED + r""", s AS (SELECT intent, unnest(regexp_extract_all(body, '\{\{([^}]+)\}\}', 1))
    AS slot FROM slotted) SELECT intent, slot, count(*) AS n FROM s GROUP BY intent, slot""")
def slot_by_intent(v):
    return features.slot_table(slotted(v), "intent", "body")


CAPS_SQL = f"len(list_filter({words_sql('html')}, lambda w: length(w) > 3 AND upper(w) = w AND lower(w) <> w)) > 0"


@query("caps_flag", f"SELECT page_id, CAST({CAPS_SQL} AS INTEGER) AS caps FROM pages")
def caps_flag(v):
    return v.table("pages").select("page_id", tx.has_all_caps(F.col("html")).alias("caps"))


@query("decide", with_views("scored", """SELECT id, CAST(p_a >= 0.5 AS INTEGER) AS pred_a,
    CAST(p_b >= 0.5 AS INTEGER) AS pred_b FROM scored"""))
def decide(v):
    return v.scored.select("id", sc.decide(F.col("p_a")).alias("pred_a"), sc.decide(F.col("p_b")).alias("pred_b"))


@query("confidence", with_views("scored", """SELECT id, round(CASE WHEN p_b >= 0.5 THEN p_b ELSE 1 - p_b END, 6)
    AS confidence FROM scored"""))
def confidence(v):
    return v.scored.select("id", sc.confidence(F.col("p_b")).alias("confidence"))


PIECE_SQL = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"


def pieces_sql(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '{PIECE_SQL}')"


@query("token_profile", with_views("requests", f""", t AS (SELECT category, len({pieces_sql('instruction')}) AS n
    FROM requests) SELECT category, count(*) AS n_texts, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6)
    AS median, round(quantile_cont(n, 0.99), 6) AS p99, CAST(max(n) AS INTEGER) AS max,
    round(avg(CAST(n > 128 AS DOUBLE)), 6) AS share_over_cap FROM t GROUP BY category"""))
def token_profile(v):
    return features.token_profile(v.requests, "instruction", 128, by=("category",))


@query("oov_rate", with_views("requests", f""", t AS (SELECT category, unnest({pieces_sql('instruction')}) AS token
    FROM requests), vocab AS (SELECT DISTINCT token FROM t WHERE category = 'en'),
    o AS (SELECT token, token NOT IN (SELECT token FROM vocab) AS unknown FROM t WHERE category <> 'en')
    SELECT count(*) AS n_tokens, count(*) FILTER (unknown) AS n_unknown,
    round(count(*) FILTER (unknown) * 1000.0 / count(*), 6) AS unknown_per_1k FROM o"""))
def oov_rate(v):
    english = features.token_counts(v.requests.filter("category = 'en'"), "instruction").select("token")
    return features.oov_rate(v.requests.filter("category <> 'en'"), english, "instruction")


@query("truncate_tokens", with_views("requests", f"""SELECT row_id,
    array_to_string(({pieces_sql('instruction')})[1:64], ' ') AS truncated FROM requests"""))
def truncate_tokens(v):
    return features.truncate_tokens(v.requests, "instruction", 64).select("row_id", "truncated")


def matches_sql(column: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({column}, '{pattern}')) AS INTEGER)"


NOISE_SQL = {
    "handles": "@[A-Za-z0-9_]+",
    "urls": r"https?://[^\s<>\x{22}'']+",
    "emoji": r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]",
    "entities": "&(?:[A-Za-z]+|#[0-9]+);",
    "hashtags": r"#[\p{L}\p{N}_]+",
}


@query("noise_profile", "SELECT page_id, " + ", ".join(
    f"{matches_sql('html', p)} AS {n}" for n, p in NOISE_SQL.items()) + " FROM pages")
def noise_profile(v):
    return features.noise_profile(v.table("pages"), "html").drop("url", "html")


@query("normalize_text", f"""SELECT page_id, regexp_replace(regexp_replace(html, '{NOISE_SQL["urls"]}', 'HTTPURL', 'g'),
    '@[A-Za-z0-9_]+', '@USER', 'g') AS normalized FROM pages""")
def normalize_text(v):
    return features.normalize_handles_urls(v.table("pages"), "html").select("page_id", "normalized")


# Phrases of the test texts that stand for an explicit request.
PHRASES = (r"(?i)of (?:the|and) ", r"(?i) nicht der")


@query("keyword_rule", with_views("requests", """SELECT row_id, CAST(regexp_matches(instruction, '(?i)of (?:the|and) ')
    OR regexp_matches(instruction, '(?i) nicht der') AS INTEGER) AS rule_hit FROM requests"""))
def keyword_rule(v):
    return features.keyword_rule(v.requests, "instruction", PHRASES).select("row_id", "rule_hit")


@query("casing_stats", with_views("requests", f""", t AS (SELECT unnest(regexp_extract_all(instruction, '{PIECE_SQL}'))
    AS token FROM requests) SELECT count(*) AS n_tokens, count(DISTINCT token) AS vocab_cased,
    count(DISTINCT lower(token)) AS vocab_folded, count(DISTINCT token) - count(DISTINCT lower(token)) AS merged
    FROM t"""))
def casing_stats(v):
    return features.case_folding_delta(v.requests, "instruction")


@query("filter_class", with_views("labeled", """SELECT thread_id, category FROM labeled
    WHERE escalated = 1 AND lang <> 'fr'"""))
def filter_class(v):
    mask = (F.col("escalated") == 1) & (F.col("lang") != "fr")
    return v.labeled.filter(mask).select("thread_id", "category")


# --- exploratory aggregates ----------------------------------------------------------------------------------

@query("category_by_class", with_views("labeled", """SELECT source, count(*) FILTER (escalated = 0) AS class_0,
    count(*) FILTER (escalated = 1) AS class_1, count(*) AS total FROM labeled GROUP BY source"""))
def category_by_class(v):
    return profile.category_by_class(v.labeled, "source")


@query("class_category_sizes", with_views("labeled", """SELECT escalated, category, count(*) AS threads FROM labeled
    GROUP BY escalated, category"""))
def class_category_sizes(v):
    return profile.class_category_sizes(v.labeled)


@query("class_balance", with_views("labeled", """SELECT escalated, count(*) AS n,
    round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM labeled GROUP BY escalated"""))
def class_balance(v):
    return profile.class_balance(v.labeled)


@query("base_rate", with_views("labeled", """SELECT count(*) AS n, round(avg(escalated), 6) AS base_rate
    FROM labeled"""))
def base_rate(v):
    return profile.base_rate(v.labeled)


FLAGGED_TARGET = with_views("flagged", f""", f AS (SELECT category, CAST(intent IN ('1-URGENT', '2-HIGH') AS INTEGER)
    AS escalated, {FLAGS_SQL} FROM flagged) """)


def flagged_target(v):
    return features.decompose_flags(features.map_target(v.flagged, ("1-URGENT", "2-HIGH")))


def averages(by: str) -> str:
    return f"SELECT {by}, " + ", ".join(f"round(avg(flag_{n}) * 100, 6) AS flag_{n}" for n in FLAG_NAMES.values()) + (
        f" FROM f GROUP BY {by}")


@query("flag_prevalence", FLAGGED_TARGET + f", w AS ({averages('escalated')}) " + " UNION ALL ".join(
    f"SELECT escalated, 'flag_{n}' AS flag, flag_{n} AS pct FROM w" for n in FLAG_NAMES.values()))
def flag_prevalence(v):
    return profile.flag_prevalence(flagged_target(v))


@query("flag_density", FLAGGED_TARGET + averages("category"))
def flag_density(v):
    return profile.flag_density(flagged_target(v), "category")


@query("melt_metrics", with_views("scored", """SELECT id, 'p_a' AS metric, round(p_a, 6) AS value FROM scored
    UNION ALL SELECT id, 'p_b', round(p_b, 6) FROM scored"""))
def melt_metrics(v):
    return profile.melt(v.scored.select("id", "p_a", "p_b"), ["id"], "metric", "value")


CAPS_TEXT_SQL = CAPS_SQL.replace("html", "first_customer_text")


@query("caps_lift", with_views("labeled", f""", c AS (SELECT escalated, {CAPS_TEXT_SQL} AS caps FROM labeled)
    SELECT count(*) FILTER (caps) AS n_with, round(avg(CAST(caps AS DOUBLE)), 6) AS share_with,
    round(avg(escalated) FILTER (caps), 6) AS rate_with, round(avg(escalated) FILTER (NOT caps), 6) AS rate_without,
    round(avg(escalated) FILTER (caps) - avg(escalated) FILTER (NOT caps), 6) AS lift FROM c"""))
def caps_lift(v):
    return profile.conditional_rate(v.labeled, tx.has_all_caps(F.col("first_customer_text")) == 1)


@query("effect_size", FEATURED + """, m AS (SELECT count(*) FILTER (escalated = 0) AS n0,
    count(*) FILTER (escalated = 1) AS n1, avg(char_len) FILTER (escalated = 0) AS m0,
    avg(char_len) FILTER (escalated = 1) AS m1, var_samp(char_len) FILTER (escalated = 0) AS v0,
    var_samp(char_len) FILTER (escalated = 1) AS v1 FROM featured)
    SELECT n0 AS n_0, n1 AS n_1, round(m0, 6) AS mean_0, round(m1, 6) AS mean_1, round(m1 - m0, 6) AS mean_diff,
    round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 6) AS cohens_d FROM m""")
def effect_size(v):
    return profile.effect_size(featured(v), "char_len")


def histogram_sql(column: str, by: str, lo_hi: str, bins: str, index: str, width: str) -> str:
    return f""", x AS (SELECT {by}, CAST({column} AS DOUBLE) AS x FROM featured), r AS (SELECT *, {lo_hi} FROM x),
    b AS (SELECT {by}, CAST(least({index}, {bins} - 1) AS INTEGER) AS bin, count(*) AS n, min(lo) AS lo,
    min({width}) AS w FROM r GROUP BY 1, 2)
    SELECT {by}, bin, round(lo + bin * w, 6) AS "left", n,
    round(n / (sum(n) OVER (PARTITION BY {by}) * w), 6) AS density FROM b"""


@query("histogram_density", FEATURED + histogram_sql(
    "char_len", "escalated", "min(x) OVER () AS lo, max(x) OVER () AS hi", "15",
    "floor((x - lo) / (hi - lo) * 15)", "(hi - lo) / 15"))
def histogram_density(v):
    return profile.histogram(featured(v), "char_len", "escalated", bins=15)


@query("histogram_width", FEATURED + histogram_sql(
    "word_len", "escalated", "min(x) OVER () AS lo, max(x) OVER () AS hi", "greatest(ceil((hi - lo) / 50), 1)",
    "floor((x - lo) / 50)", "CAST(50 AS DOUBLE)"))
def histogram_width(v):
    return profile.histogram(featured(v), "word_len", "escalated", width=50)


@query("box_stats", FEATURED + """, q AS (SELECT category, escalated, count(*) AS n, quantile_cont(word_len, 0.25) AS q1,
    quantile_cont(word_len, 0.5) AS median, quantile_cont(word_len, 0.75) AS q3 FROM featured GROUP BY 1, 2)
    SELECT category, escalated, q.n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
    min(word_len) FILTER (word_len BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
    max(word_len) FILTER (word_len BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
    count(*) FILTER (word_len NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
    FROM featured JOIN q USING (category, escalated) GROUP BY category, escalated, q.n, q1, median, q3""")
def box_stats(v):
    return profile.box_stats(featured(v), "word_len", ["category", "escalated"])


@query("slot_count_by_class", SLOTTED + r""", c AS (SELECT CAST(intent IN ('src1', 'src3', 'src5', 'src7') AS INTEGER)
    AS escalated, CAST(len(regexp_extract_all(body || CASE WHEN category = 'en' THEN ' {{extra}}' ELSE '' END,
    '\{\{[^}]+\}\}')) AS INTEGER) AS slot_count FROM slotted)
    SELECT slot_count, escalated, count(*) AS n FROM c GROUP BY slot_count, escalated""")
def slot_count_by_class(v):
    rows = features.map_target(slotted(v), TARGETS)
    body = F.concat("body", F.when(F.col("category") == "en", F.lit(" {{extra}}")).otherwise(F.lit("")))
    return profile.slot_count_by_class(rows.withColumn("slot_count", tx.slot_count(body)))


@query("first_exemplar", with_views("labeled", """SELECT escalated, thread_id, category, first_customer_text FROM labeled
    QUALIFY row_number() OVER (PARTITION BY escalated ORDER BY thread_id) = 1"""))
def first_exemplar(v):
    rows = v.labeled.select("thread_id", "escalated", "category", "first_customer_text")
    return profile.first_exemplar(rows, "escalated", "thread_id")


@query("rollup_report", with_views("labeled", """SELECT source, escalated, count(*) AS n,
    CAST(grouping(source, escalated) AS INTEGER) AS level FROM labeled GROUP BY ROLLUP (source, escalated)"""))
def rollup_report(v):
    return profile.rollup_report(v.labeled, "source", "escalated")


# --- splits --------------------------------------------------------------------------------------------------

def split_sql(source: str, fraction: float, salt: str, row_id: str = "thread_id", extra: str = "") -> str:
    """Common tables ranking every row in its class and giving each class its quota; ends in table ``part``."""
    return f"""r{extra} AS (SELECT *, row_number() OVER (PARTITION BY escalated
        ORDER BY md5('{salt}|' || CAST({row_id} AS VARCHAR)), {row_id}) AS rk,
        count(*) OVER (PARTITION BY escalated) AS nc, count(*) OVER () AS n FROM {source}),
    q{extra} AS (SELECT DISTINCT escalated, CAST(ceil(round({fraction} * n, 9)) AS BIGINT) AS part, nc, n FROM r{extra}),
    w{extra} AS (SELECT *, part * nc // n AS whole, part * nc % n AS rest FROM q{extra}),
    p{extra} AS (SELECT *, whole + CAST(row_number() OVER (ORDER BY rest DESC, escalated)
        <= part - sum(whole) OVER () AS INTEGER) AS quota FROM w{extra}),
    part{extra} AS (SELECT r{extra}.* EXCLUDE (rk, nc, n), rk <= quota AS taken FROM r{extra}
        JOIN p{extra} USING (escalated))"""


THREE_WAY = with_views("labeled", ", base AS (SELECT thread_id, escalated FROM labeled), "
                       + split_sql("base", 0.2, "42") + ", tr AS (SELECT thread_id, escalated FROM part WHERE NOT taken), "
                       + split_sql("tr", 0.1, "42-val", extra="2")
                       + """, three AS (SELECT thread_id, escalated, CASE WHEN taken THEN 'val' ELSE 'train' END AS split
                       FROM part2 UNION ALL SELECT thread_id, escalated, 'test' FROM part WHERE taken) """)


@query("stratified_split", with_views("labeled", ", base AS (SELECT thread_id, escalated FROM labeled), "
                                      + split_sql("base", 0.2, "42")
                                      + " SELECT thread_id, escalated, CASE WHEN taken THEN 'test' ELSE 'train' END AS split FROM part"))
def stratified_split(v):
    return split.stratified_split(v.labeled.select("thread_id", "escalated"), "escalated", "thread_id")


@query("three_way_split", THREE_WAY + "SELECT * FROM three")
def three_way_split(v):
    return split.three_way_split(v.labeled.select("thread_id", "escalated"), "escalated", "thread_id")


@query("split_rates", THREE_WAY + """SELECT split, count(*) AS n, round(avg(escalated), 6) AS positive_rate FROM three
    GROUP BY split""")
def split_rates(v):
    return split.split_rates(three_way_split(v), "escalated")


@query("split_parity", THREE_WAY + """SELECT (SELECT count(*) FROM part WHERE taken) AS expected_rows,
    (SELECT count(*) FROM three WHERE split = 'test') AS actual_rows, CAST(0 AS BIGINT) AS only_expected,
    CAST(0 AS BIGINT) AS only_actual, CAST(1 AS INTEGER) AS same_checksum, CAST(1 AS INTEGER) AS parity""")
def split_parity(v):
    two = stratified_split(v).filter("split = 'test'")
    three = three_way_split(v).filter("split = 'test'")
    return split.split_parity(two, three, "thread_id")


@query("split_parity_differs", with_views("labeled", ", base AS (SELECT thread_id, escalated FROM labeled), "
                                          + split_sql("base", 0.2, "42") + ", " + split_sql("base", 0.2, "7", extra="2") + """,
    e AS (SELECT thread_id FROM part WHERE taken), a AS (SELECT thread_id FROM part2 WHERE taken),
    k AS (SELECT (SELECT count(*) FROM e) AS expected_rows, (SELECT count(*) FROM a) AS actual_rows,
    (SELECT count(*) FROM e WHERE thread_id NOT IN (SELECT thread_id FROM a)) AS only_expected,
    (SELECT count(*) FROM a WHERE thread_id NOT IN (SELECT thread_id FROM e)) AS only_actual)
    SELECT *, CAST(only_expected + only_actual = 0 AS INTEGER) AS same_checksum,
    CAST(only_expected + only_actual = 0 AND expected_rows = actual_rows AS INTEGER) AS parity FROM k"""))
def split_parity_differs(v):
    """Two splits of different seeds."""
    rows = v.labeled.select("thread_id", "escalated")
    sides = [split.stratified_split(rows, "escalated", "thread_id", seed=s).filter("split = 'test'") for s in (42, 7)]
    return split.split_parity(*sides, "thread_id")


CURVE = {"quarter": 0.25, "half": 0.5, "most": 0.9}


@query("learning_curve_subsets", with_views("labeled", ", base AS (SELECT thread_id, escalated FROM labeled), " + ", ".join(
    split_sql("base", f, "42", extra=f"_{n}") for n, f in CURVE.items()) + " " + " UNION ALL ".join(
    f"SELECT thread_id, escalated, '{n}' AS size_name FROM part_{n} WHERE taken" for n in CURVE)))
def learning_curve_subsets(v):
    return split.nested_train_sizes(v.labeled.select("thread_id", "escalated"), "escalated", "thread_id", CURVE)


@query("kfold_assign", with_views("requests", """SELECT row_id,
    CAST(CAST('0x' || substr(md5('42|' || CAST(row_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold
    FROM requests"""))
def kfold_assign(v):
    return split.kfold(v.requests, "row_id", 5).select("row_id", "fold")
