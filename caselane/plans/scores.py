"""Queries on scored rows: matrices, metrics, curves, cut-offs, comparisons of experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselane.functions.taxonomy import COARSE_GRID, FINE_GRID
from caselane.operators import compare, curves, evaluate, split
from caselane.plans import registry
from caselane.plans.registry import query
from caselane.sources.runs import metric_record, read_runs, round4, union_runs, write_runs
from caselane.plans.tables import split_sql
from caselane.session import scratch_path
from caselane.sources.views import with_views

MODELS = {"a": "p_a", "b": "p_b"}

LONG = with_views("scored", """, long AS (SELECT id, y_true, category, 'a' AS model, p_a AS y_prob FROM scored
    UNION ALL SELECT id, y_true, category, 'b', p_b FROM scored),
    pred AS (SELECT *, CAST(y_prob >= 0.5 AS INTEGER) AS y_pred FROM long) """)


def long(v):
    return evaluate.long_scores(v.scored, MODELS, ["id", "y_true", "category"])


def pred(v):
    return evaluate.with_pred(long(v))


def cells(by: str, source: str = "pred", y_pred: str = "y_pred", y_true: str = "y_true") -> str:
    return f"""SELECT {by}, count(*) FILTER ({y_true} = 0 AND {y_pred} = 0) AS tn,
        count(*) FILTER ({y_true} = 0 AND {y_pred} = 1) AS fp, count(*) FILTER ({y_true} = 1 AND {y_pred} = 0) AS fn,
        count(*) FILTER ({y_true} = 1 AND {y_pred} = 1) AS tp FROM {source} GROUP BY {by}"""


def ratio(top: str, bottom: str) -> str:
    return f"coalesce(({top}) / nullif(CAST({bottom} AS DOUBLE), 0), 0)"


P0, R0, F0 = ratio("tn", "tn + fn"), ratio("tn", "tn + fp"), ratio("2 * tn", "2 * tn + fn + fp")
P1, R1, F1 = ratio("tp", "tp + fp"), ratio("tp", "tp + fn"), ratio("2 * tp", "2 * tp + fn + fp")

METRICS = f"""round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, round(({P0} + {P1}) / 2, 6) AS precision_macro,
    round(({R0} + {R1}) / 2, 6) AS recall_macro, round(({F0} + {F1}) / 2, 6) AS f1_macro,
    round({P1}, 6) AS precision_escalated, round({R1}, 6) AS recall_escalated, round({F1}, 6) AS f1_escalated"""


def auc_sql(by: str, source: str) -> str:
    """Exact AUC by mid-ranks: a different formula from the one under test."""
    return f"""SELECT {by}, (sum(rk) FILTER (y_true = 1) - count(*) FILTER (y_true = 1)
        * (count(*) FILTER (y_true = 1) + 1) / 2) / (count(*) FILTER (y_true = 1) * count(*) FILTER (y_true = 0))
        AS roc_auc FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY y_prob)
        + (count(*) OVER (PARTITION BY {by}, y_prob) - 1) / 2 AS rk FROM {source}) GROUP BY {by}"""


BINARY = LONG + f""", c AS ({cells('model')}), u AS ({auc_sql('model', 'pred')})
    SELECT model, {METRICS}, round(roc_auc, 6) AS roc_auc, tn, fp, fn, tp FROM c JOIN u USING (model)"""


@query("confusion", LONG + cells("model"))
def confusion(v):
    return evaluate.confusion(pred(v), ("model",))


@query("binary_metrics", BINARY)
def binary_metrics(v):
    return evaluate.binary_metrics(pred(v), ("model",))


def four(expr: str) -> str:
    return f"round(({expr}) * 10000) / 10000"


@query("metric_record", LONG + f""", c AS ({cells('model')}), u AS ({auc_sql('model', 'pred')})
    SELECT 'two scores' AS model_name, model, {four('(tn + tp) / (tn + fp + fn + tp)')} AS accuracy,
    {four(f'({P0} + {P1}) / 2')} AS precision_macro, {four(f'({R0} + {R1}) / 2')} AS recall_macro,
    {four(f'({F0} + {F1}) / 2')} AS f1_macro, {four(P1)} AS precision_escalated, {four(R1)} AS recall_escalated,
    {four(F1)} AS f1_escalated, {four('roc_auc')} AS roc_auc, tn, fp, fn, tp FROM c JOIN u USING (model)""")
def record(v):
    nested = metric_record(binary_metrics(v), ["model"], "two scores")
    return nested.select("model_name", "model", "metrics.*", "confusion_matrix.*")


@query("runs_round_trip", registry.CHECKS["metric_record"])
def runs_round_trip(v):
    """The same records written as JSON and read back."""
    nested = metric_record(binary_metrics(v), ["model"], "two scores")
    path = write_runs(nested, scratch_path(v.spark, "runs"))
    return read_runs(v.spark, path, schema=nested.schema).select("model_name", "model", "metrics.*", "confusion_matrix.*")


@query("metric_parity", with_views("scored", """, r AS (SELECT category, count(*) AS n,
    sum(CAST((p_b >= 0.5) = (y_true = 1) AS INTEGER)) AS a, sum(CAST((p_b >= 0.52) = (y_true = 1) AS INTEGER)) AS b
    FROM scored GROUP BY category), k AS (SELECT category, 'same' AS run, a / n AS recorded, a / n AS recomputed FROM r
    UNION ALL SELECT category, 'other', a / n, b / n FROM r)
    SELECT category, run, round(round(recorded * 10000) / 10000, 6) AS recorded, round(recomputed, 6) AS recomputed,
    CAST(abs(round(recorded * 10000) / 10000 - recomputed) < 0.0005 AS INTEGER) AS parity FROM k"""))
def metric_parity(v):
    """Recorded accuracies against the same rows decided again, and against another cut-off."""
    def accuracy(run, cut):
        right = ((F.col("p_b") >= cut) == (F.col("y_true") == 1)).cast("int")
        return v.scored.groupBy("category").agg(F.avg(right).alias("accuracy")).withColumn("run", F.lit(run))

    recorded = accuracy("same", 0.5).unionByName(accuracy("other", 0.5)).withColumn("accuracy", round4(F.col("accuracy")))
    recomputed = accuracy("same", 0.5).unionByName(accuracy("other", 0.52))
    return split.metric_parity(recorded, recomputed, ["category", "run"], "accuracy")


@query("classification_report", LONG + f""", c AS ({cells('model')}), v AS (SELECT model, {P0} AS p0, {R0} AS r0,
    {F0} AS f0, {P1} AS p1, {R1} AS r1, {F1} AS f1, tn + fp AS s0, fn + tp AS s1 FROM c)
    SELECT model, '0' AS label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM v
    UNION ALL SELECT model, '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM v
    UNION ALL SELECT model, 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), s0 + s1 FROM v
    UNION ALL SELECT model, 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 6),
    round((r0 * s0 + r1 * s1) / (s0 + s1), 6), round((f0 * s0 + f1 * s1) / (s0 + s1), 6), s0 + s1 FROM v""")
def classification_report(v):
    return evaluate.classification_report(pred(v), ("model",))


@query("specificity", LONG + """SELECT model, round(avg(1 - y_pred) FILTER (y_true = 0), 6) AS specificity FROM pred
    GROUP BY model""")
def specificity(v):
    return evaluate.specificity(pred(v), ("model",))


@query("roc_auc", LONG + f", u AS ({auc_sql('model', 'pred')}) SELECT model, round(roc_auc, 6) AS roc_auc FROM u")
def roc_auc(v):
    return curves.roc_auc(long(v), ("model",))


RUNNING = LONG + """, g AS (SELECT model, y_prob, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg
    FROM long GROUP BY model, y_prob), s AS (SELECT model, y_prob, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n FROM g
    WINDOW w AS (PARTITION BY model ORDER BY y_prob DESC)) """


@query("roc_curve", RUNNING + """SELECT model, round(y_prob, 6) AS threshold, round(fp / n, 6) AS fpr,
    round(tp / p, 6) AS tpr FROM s""")
def roc_curve(v):
    return curves.roc_curve(long(v), ("model",))


@query("pr_curve", RUNNING + """SELECT model, round(y_prob, 6) AS threshold, round(tp / (tp + fp), 6) AS precision,
    round(tp / p, 6) AS recall FROM s""")
def pr_curve(v):
    return curves.pr_curve(long(v), ("model",))


def sweep_sql(grid: str) -> str:
    """Every cut-off against every row: the brute-force form."""
    return LONG + f""", grid AS ({grid}), tried AS (SELECT model, threshold, y_true,
        CAST(y_prob >= threshold AS INTEGER) AS y_pred FROM long, grid), c AS ({cells('model, threshold', 'tried')}),
        sweep AS (SELECT model, threshold, ({F0} + {F1}) / 2 AS macro_f1, {R1} AS recall_escalated,
        {P1} AS precision_escalated, fn AS missed_escalations, fp AS false_alarms,
        (tp + fp) * 100.0 / (tn + fp + fn + tp) AS pct_routed_to_agent FROM c) """


COARSE_SQL = sweep_sql("SELECT CAST(k AS DOUBLE) / 100 AS threshold FROM range(20, 81, 5) g(k)")
FINE_SQL = sweep_sql("SELECT CAST(k AS DOUBLE) / 1000 AS threshold FROM range(10, 991, 5) g(k)")
BEST = """, best AS (SELECT model, threshold, macro_f1 FROM sweep QUALIFY row_number() OVER (PARTITION BY model
    ORDER BY round(macro_f1, 12) DESC, threshold) = 1) """


@query("threshold_sweep", COARSE_SQL + """SELECT model, round(threshold, 6) AS threshold, round(macro_f1, 6) AS macro_f1,
    round(recall_escalated, 6) AS recall_escalated, round(precision_escalated, 6) AS precision_escalated,
    missed_escalations, false_alarms, round(pct_routed_to_agent, 6) AS pct_routed_to_agent FROM sweep""")
def threshold_sweep(v):
    return curves.threshold_sweep(long(v), COARSE_GRID, ("model",))


@query("best_threshold", FINE_SQL + BEST + """SELECT model, round(threshold, 6) AS best_threshold,
    round(macro_f1, 6) AS best_macro_f1 FROM best""")
def best_threshold(v):
    return curves.best_threshold(long(v), FINE_GRID, ("model",))


@query("calibration_table", FINE_SQL + BEST + f""", d AS ({cells('model')}), u AS ({auc_sql('model', 'pred')}),
    z AS (SELECT model, ({F0} + {F1}) / 2 AS f FROM d)
    SELECT model, round(f, 6) AS f1_at_default, round(threshold, 6) AS best_threshold, round(macro_f1, 6) AS f1_at_best,
    round(roc_auc, 6) AS roc_auc, round(macro_f1 - f, 6) AS gain FROM z JOIN best USING (model) JOIN u USING (model)""")
def calibration_table(v):
    return evaluate.calibration_table(long(v), "model")


@query("recall_by_category", LONG + """SELECT model, category, count(*) AS threads, round(avg(y_pred), 6) AS recall
    FROM pred WHERE y_true = 1 GROUP BY model, category""")
def recall_by_category(v):
    return evaluate.recall_by_category(pred(v))


@query("recall_delta", with_views("scored", """SELECT category, count(*) AS threads,
    round(avg(CAST(p_a >= 0.5 AS INTEGER)), 6) AS base_recall, round(avg(CAST(p_b >= 0.5 AS INTEGER)), 6) AS other_recall,
    round(avg(CAST(p_b >= 0.5 AS INTEGER)) - avg(CAST(p_a >= 0.5 AS INTEGER)), 6) AS delta
    FROM scored WHERE y_true = 1 GROUP BY category"""))
def recall_delta(v):
    both = v.scored.withColumns({"pred_a": (F.col("p_a") >= 0.5).cast("int"), "pred_b": (F.col("p_b") >= 0.5).cast("int")})
    return evaluate.recall_delta(both, "pred_a", "pred_b")


PREDICTED = with_views("predictions", """, p AS (SELECT *, CAST(y_prob >= 0.5 AS INTEGER) AS y_pred FROM predictions) """)


def predicted(v):
    return evaluate.with_pred(v.predictions)


@query("recall_gain", PREDICTED + """, i AS (SELECT category, count(*) AS threads, avg(y_pred) AS r FROM p
    WHERE y_true = 1 AND model = 'b' GROUP BY category), x AS (SELECT category, avg(y_pred) AS r FROM p
    WHERE y_true = 1 AND model = 'a' AND setting <> 'target_in' GROUP BY category)
    SELECT category, i.threads, round(i.r, 6) AS in_domain_recall, round(x.r, 6) AS cross_domain_recall,
    round(i.r - x.r, 6) AS gain FROM i LEFT JOIN x USING (category)""")
def recall_gain(v):
    inside = evaluate.recall_by_category(predicted(v).filter("model = 'b'"), ())
    across = evaluate.recall_by_category(predicted(v).filter("model = 'a' AND setting <> 'target_in'"), ())
    return evaluate.recall_gain(inside, across)


@query("error_counts", LONG + f""", c AS ({cells('model')}) SELECT model, fn AS missed, fp AS false_alarms,
    fn + tp AS escalations, round(fn / (fn + tp), 6) AS missed_share FROM c""")
def error_counts(v):
    return evaluate.error_counts(pred(v), ("model",))


@query("score_distribution", with_views("scored", """, r AS (SELECT y_true, p_a AS x, min(p_a) OVER (PARTITION BY y_true)
    AS lo, max(p_a) OVER (PARTITION BY y_true) AS hi FROM scored), b AS (SELECT y_true,
    CAST(least(floor((x - lo) / (hi - lo) * 40), 39) AS INTEGER) AS bin, count(*) AS n, min(lo) AS lo,
    min((hi - lo) / 40) AS w FROM r GROUP BY 1, 2) SELECT y_true, bin, round(lo + bin * w, 6) AS "left", n,
    round(n / (sum(n) OVER (PARTITION BY y_true) * w), 6) AS density FROM b"""))
def score_distribution(v):
    return evaluate.score_distribution(v.scored.select("y_true", F.col("p_a").alias("y_prob")))


VALIDATION_SQL = sweep_sql("SELECT CAST(k AS DOUBLE) / 100 AS threshold FROM range(20, 81, 5) g(k)").replace(
    LONG, with_views("scored", ", base AS (SELECT id AS thread_id, y_true AS escalated FROM scored), " + split_sql("base", 0.2, "42")
                     + ", tr AS (SELECT thread_id, escalated FROM part WHERE NOT taken), " + split_sql("tr", 0.1, "42-val", extra="2")
                     + """, val AS (SELECT scored.* FROM scored JOIN part2 ON id = thread_id WHERE taken),
    long AS (SELECT id, y_true, 'a' AS model, p_a AS y_prob FROM val UNION ALL SELECT id, y_true, 'b', p_b FROM val) """), 1)


@query("operating_point", VALIDATION_SQL + """, k AS (SELECT *, missed_escalations * 5.0 + false_alarms * 1.0 AS cost
    FROM sweep) SELECT model, round(threshold, 6) AS threshold, round(CAST(cost AS DOUBLE), 6) AS cost,
    missed_escalations, false_alarms FROM k
    QUALIFY row_number() OVER (PARTITION BY model ORDER BY cost, threshold) = 1""")
def operating_point(v):
    """Chosen on validation rows; test rows have no say in it."""
    parts = split.three_way_split(v.scored.select("id", "y_true"), "y_true", "id")
    chosen = long(v).join(parts.filter("split = 'val'").select("id"), "id")
    return curves.operating_point(curves.threshold_sweep(chosen, COARSE_GRID, ("model",)), 5, 1, ("model",))


@query("uncertainty_routing", with_views("scored", """, r AS (SELECT CASE WHEN p_b >= 0.4 AND p_b < 0.6 THEN 'hand_off'
    ELSE 'local' END AS route, CAST((p_b >= 0.5) <> (y_true = 1) AS INTEGER) AS wrong FROM scored)
    SELECT route, count(*) AS n, CAST(sum(wrong) AS BIGINT) AS errors, round(avg(wrong), 6) AS error_rate,
    round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY route"""))
def uncertainty_routing(v):
    return evaluate.uncertainty_routing(v.scored.withColumnRenamed("p_b", "y_prob"), 0.4, 0.6)


@query("cascade_route", """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)of (?:the|and) ') THEN 'human_by_rule'
    WHEN n_chars / (n_chars + 1000.0) >= 0.4 AND n_chars / (n_chars + 1000.0) < 0.6 THEN 'hand_off'
    WHEN n_chars / (n_chars + 1000.0) >= 0.6 THEN 'human_by_model' ELSE 'self_service' END AS final_route
    FROM documents""")
def cascade_route(v):
    rows = v.table("documents").withColumn("y_prob", F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0)))
    routed = evaluate.cascade_route(rows, "text", 0.4, 0.6, ("(?i)of (?:the|and) ",))
    return routed.select("doc_id", "final_route")


@query("label_collision", LONG + """SELECT model, category, count(*) AS threads,
    CAST(sum(1 - y_pred) AS BIGINT) AS missed, round(avg(1 - y_pred), 6) AS missed_share FROM pred WHERE y_true = 1
    GROUP BY model, category""")
def label_collision(v):
    return evaluate.label_collisions(pred(v), ("model", "category"))


@query("join_predictions", with_views("labeled", """SELECT thread_id, category,
    round(CAST(n_chars AS DOUBLE) / (n_chars + 1000), 6) AS y_prob FROM labeled
    JOIN documents ON doc_id = thread_id"""))
def join_predictions(v):
    size = F.col("n_chars").cast("double")
    scores = v.table("documents").select(F.col("doc_id").alias("thread_id"), (size / (size + 1000)).alias("y_prob"))
    return evaluate.join_predictions(v.labeled.select("thread_id", "category"), scores, "thread_id")


# --- experiments ---------------------------------------------------------------------------------------------

@query("seed_summary", with_views("runs", """SELECT encoder, count(*) AS n_seeds, round(avg(macro_f1), 6) AS mean,
    round(stddev_samp(macro_f1), 6) AS std FROM runs GROUP BY encoder"""))
def seed_summary(v):
    return compare.seed_summary(v.runs)


@query("noise_floor", with_views("runs", """, s AS (SELECT encoder, count(*) AS n_seeds, avg(macro_f1) AS mean,
    stddev_samp(macro_f1) AS std FROM runs GROUP BY encoder), b AS (SELECT * FROM s WHERE encoder = 'uncased')
    SELECT s.encoder, s.n_seeds, round(s.mean, 6) AS mean, round(s.std, 6) AS std, round(s.mean - b.mean, 6) AS delta,
    round(2 * b.std, 6) AS two_sigma, CASE WHEN abs(s.mean - b.mean) > 2 * b.std THEN 'exceeds_noise'
    ELSE 'within_noise' END AS verdict FROM s, b"""))
def noise_floor(v):
    return compare.noise_floor(v.runs, "uncased")


SETTINGS = ["source_in", "cross", "target_in"]

CELLS_SQL = PREDICTED + f""", c AS ({cells('model, setting', 'p')}), run AS (SELECT model, setting,
    ({F0} + {F1}) / 2 AS f1_macro, (tn + tp) / (tn + fp + fn + tp) AS accuracy, ({P0} + {P1}) / 2 AS precision_macro,
    ({R0} + {R1}) / 2 AS recall_macro, {R1} AS recall_escalated FROM c) """

MATRIX_SQL = """, m AS (SELECT model, max(f1_macro) FILTER (setting = 'source_in') AS source_in,
    max(f1_macro) FILTER (setting = 'cross') AS "cross", max(f1_macro) FILTER (setting = 'target_in') AS target_in
    FROM run GROUP BY model) """


def run_cells(v, by=("model", "setting")):
    return compare.run_table(predicted(v), by)


@query("run_table", PREDICTED + f""", c AS ({cells('model, setting, seed', 'p')}) SELECT model, setting,
    CAST(seed AS INTEGER) AS seed, round(({F0} + {F1}) / 2, 6) AS f1_macro,
    round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, round(({P0} + {P1}) / 2, 6) AS precision_macro,
    round(({R0} + {R1}) / 2, 6) AS recall_macro, round({R1}, 6) AS recall_escalated FROM c""")
def run_table(v):
    return run_cells(v, ("model", "setting", "seed"))


@query("metric_comparison", CELLS_SQL + """, l AS (UNPIVOT run ON f1_macro, accuracy, precision_macro, recall_macro,
    recall_escalated INTO NAME metric VALUE value), w AS (SELECT model, metric,
    max(value) FILTER (setting = 'source_in') AS a, max(value) FILTER (setting = 'cross') AS b,
    max(value) FILTER (setting = 'target_in') AS c FROM l GROUP BY model, metric)
    SELECT model, metric, round(a, 6) AS source_in, round(b, 6) AS "cross", round(c, 6) AS target_in,
    round(a - b, 6) AS "drop" FROM w""")
def metric_comparison(v):
    return compare.metric_comparison(run_cells(v), SETTINGS, "source_in", "cross")


@query("design_matrix", CELLS_SQL + MATRIX_SQL + """SELECT model, round(source_in, 6) AS source_in,
    round("cross", 6) AS "cross", round(target_in, 6) AS target_in, round(target_in - "cross", 6) AS recovered FROM m""")
def design_matrix(v):
    return compare.design_matrix(run_cells(v), SETTINGS, "target_in", "cross")


@query("gap_decomposition", CELLS_SQL + MATRIX_SQL + """, x AS (SELECT * FROM m WHERE model = 'a'),
    y AS (SELECT * FROM m WHERE model = 'b') SELECT round(y.target_in - x.target_in, 6) AS model_gap_in,
    round(y."cross" - x."cross", 6) AS model_gap_cross, round(x.target_in - x."cross", 6) AS label_gap_base,
    round(y.target_in - y."cross", 6) AS label_gap_other, round(greatest(x.target_in, y.target_in), 6)
    AS best_in_domain, round(x.source_in - greatest(x.target_in, y.target_in), 6) AS remainder FROM x, y""")
def gap_decomposition(v):
    return compare.gap_decomposition(design_matrix(v), "a", "b", "source_in", "cross", "target_in")


@query("sweep_summary", PREDICTED + f""", c AS ({cells('model, setting, seed', 'p')}), s AS (SELECT seed,
    max(({F0} + {F1}) / 2) AS best, count(*) AS runs FROM c GROUP BY seed)
    SELECT CAST(seed AS INTEGER) AS seed, round(best, 6) AS best, runs,
    CAST(row_number() OVER (ORDER BY best DESC, seed) = 1 AS INTEGER) AS selected FROM s""")
def sweep_summary(v):
    return compare.sweep_summary(run_table(v), "seed", "f1_macro")


@query("union_runs", PREDICTED + f""", c AS ({cells('model, setting', 'p')}) SELECT model, setting,
    CAST(NULL AS VARCHAR) AS encoder, round(({F0} + {F1}) / 2, 6) AS f1_macro, CAST(NULL AS DOUBLE) AS mean FROM c
    UNION ALL SELECT NULL, NULL, CASE s_nationkey % 2 WHEN 0 THEN 'uncased' ELSE 'cased' END, NULL,
    round(avg(s_acctbal), 6) FROM supplier GROUP BY ALL""")
def merged_runs(v):
    return union_runs(run_cells(v).select("model", "setting", "f1_macro"),
                      compare.seed_summary(v.runs).select("encoder", "mean"))


@query("category_rank_agreement", PREDICTED + """, r AS (SELECT model, category, avg(y_pred) AS recall FROM p
    WHERE y_true = 1 GROUP BY model, category), k AS (SELECT model, category, rank() OVER (PARTITION BY model
    ORDER BY recall) + (count(*) OVER (PARTITION BY model, recall) - 1) / 2 AS rk FROM r)
    SELECT count(*) AS categories, round(corr(x.rk, y.rk), 6) AS spearman FROM k x JOIN k y USING (category)
    WHERE x.model = 'a' AND y.model = 'b'""")
def category_rank_agreement(v):
    return compare.category_rank_agreement(evaluate.recall_by_category(predicted(v)), "a", "b")
