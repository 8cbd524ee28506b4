"""Headline timings: one JSON line. Reads $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from caselane.operators import classify  # noqa: E402
from caselane.plans import registry  # noqa: E402
from caselane.plans.language import training  # noqa: E402
from caselane.session import build_session  # noqa: E402
from caselane.sources.views import Views  # noqa: E402

HEADLINE = (
    "binary_metrics", "roc_curve", "threshold_sweep", "calibration_table", "recall_by_category", "dedup_first",
    "describe_lengths", "token_profile", "noise_profile", "stratified_split", "three_way_split", "thread_roots",
    "tree_roots", "turn_order", "thread_stats", "assemble_threads", "audit_upsert", "corrected_labels", "run_table",
    "vocabulary", "tfidf_weights", "linear_score",
)


def consume(df) -> None:
    """Compute every row and column without sending them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), {"spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    views = Views(spark, folder)
    consume(views.scored.groupBy("category").count())  # start the workers before the clock

    seconds = {name: timed(lambda n=name: consume(registry.runner(registry.BUILDS[n])(spark, folder))) for name in HEADLINE}

    rows, state = training(views), {}
    seconds["fit"] = timed(lambda: state.update(model=classify.fit(rows, "thread_id", "text", "escalated")))
    everything = views.table("documents").select(F.col("doc_id").alias("thread_id"), "text")
    consume(classify.score(state["model"], everything, spread_by="thread_id"))
    seconds["score"] = timed(lambda: consume(classify.score(state["model"], everything, spread_by="thread_id")))
    n = everything.count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "score_rows": n, "score_rows_per_sec": round(n / seconds["score"], 1),
    }))


if __name__ == "__main__":
    main()
