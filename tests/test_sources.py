import pytest
from pyspark.sql import functions as F

from caselane.functions.taxonomy import intent_dimension
from caselane.sources import readers, runs

TWEETS = '''tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id
1,105834,True,Wed Oct 11 06:55:44 +0000 2017,"@Care two
lines, ""quoted"" 😡","2,3",
2,Care,False,Wed Oct 11 07:00:00 +0000 2017,@105834 sorry,,1
3,Care,False,Thu Oct 12 07:00:00 +0000 2017,,,1
'''


def test_messages(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(TWEETS, encoding="utf-8")
    rows = readers.read_messages(spark, str(path)).orderBy("message_id").select(
        "*", F.unix_seconds("created_at").alias("s")).collect()
    assert len(rows) == 3
    assert rows[0].text == '@Care two\nlines, "quoted" 😡' and rows[0].response_ids == [2, 3] and rows[0].inbound
    assert rows[0].s == 1507704944 and rows[0].parent_id is None
    assert rows[1].response_ids == [] and rows[1].parent_id == 1 and not rows[1].inbound


def test_requests_and_bronze(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('flags,instruction,category,intent,response\nB,"a\nb",ORDER,cancel_order,ok\n,x,ORDER,track_order,ok\n')
    df = readers.read_requests(spark, str(path))
    assert df.count() == 2
    kept = readers.bronze(df, str(tmp_path / "bronze"), "instruction", 2)
    assert kept.filter("instruction = 'a\nb'").count() == 1 and kept.columns == df.columns


def test_labeled_and_audit(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text("thread_id,turn_count,escalated,category,reason,labeler,first_customer_text\n7,2,0,self_service,faq,m,\n")
    assert readers.read_labeled(spark, str(path)).first().first_customer_text == ""
    path = tmp_path / "a.csv"
    path.write_text("thread_id,llm_escalated,llm_category,llm_reason,human_escalated,human_category,human_notes,auditor,"
                    "audit_timestamp\n7,0,self_service,faq,1,complaint,,me,2026-01-02T03:04:05+00:00\n")
    row = readers.read_audit(spark, str(path)).first()
    assert row.human_notes == "" and row.audit_timestamp is not None


def test_records_round_trip(spark, tmp_path):
    record = {"model_name": "m", "setting": "in", "train_samples": 10, "test_samples": 5,
              "metrics": {"accuracy": 0.5, "precision_macro": 0.5, "recall_macro": 0.5, "f1_macro": 0.5, "roc_auc": None},
              "confusion_matrix": {"tn": 1, "fp": 2, "fn": 3, "tp": 4},
              "category_recall": {"complaint": {"threads": 9, "base_recall": 0.3, "model_recall": 0.2}}}
    df = spark.createDataFrame([record], runs.RECORD)
    back = runs.read_runs(spark, runs.write_runs(df, str(tmp_path / "runs")))
    assert back.collect() == df.collect()
    flat = runs.explode_category_recall(back, ["model_name"]).first()
    assert flat[:] == ("m", "complaint", 9, 0.3, 0.2)
    parquet = runs.read_runs(spark, runs.write_runs(df, str(tmp_path / "p"), "parquet"), "parquet")
    assert parquet.collect() == df.collect()


def test_dimension(spark):
    dim = intent_dimension(spark)
    assert dim.count() == 27 and dim.select("category").distinct().count() == 11
    assert dim.filter("escalated = 1").count() == 7


PUBLISHED = """{
  "model_name": "m",
  "train_samples": 3600,
  "hyperparameters": {"epochs": 4, "learning_rate": 3e-05},
  "training_history": [
    {"epoch": 1, "train_loss": 0.5, "val_macro_f1": 0.7},
    {"epoch": 2, "train_loss": 0.3, "val_macro_f1": 0.8}
  ],
  "in_domain": {
    "accuracy": 0.825, "f1_macro": 0.7842, "recall_escalated": 0.6373, "roc_auc": 0.883,
    "confusion_matrix": {"tn": 630, "fp": 64, "fn": 111, "tp": 195}
  },
  "in_domain_reference": {
    "accuracy": 0.764, "f1_macro": 0.7327, "roc_auc": 0.8258, "confusion_matrix": {"tn": 553, "fp": 141, "fn": 95, "tp": 211}
  },
  "per_category_recall": {
    "get_refund": {"threads": 18, "base": 0.833},
    "complaint": {"threads": 153, "base": 0.667, "tuned": 0.699}
  }
}
"""


def test_records_as_published(spark, tmp_path):
    path = tmp_path / "record.json"
    path.write_text(PUBLISHED)
    record = runs.read_runs(spark, str(path), schema=None, pretty=True)
    assert record.count() == 1 and record.first().train_samples == 3600
    blocks = {r.block: r for r in runs.metric_blocks(record, ["model_name"]).collect()}
    assert (blocks["in_domain"].tp, blocks["in_domain"].recall_escalated) == (195, 0.6373)
    assert (blocks["in_domain_reference"].fp, blocks["in_domain_reference"].recall_escalated) == (141, None)
    history = runs.explode_rows(record, ["model_name"], "training_history").orderBy("place").collect()
    assert [(r.place, r.epoch, r.val_macro_f1) for r in history] == [(0, 1, 0.7), (1, 2, 0.8)]
    recall = {r.name: (r.threads, r.base, r.tuned) for r in runs.explode_struct(record, [], "per_category_recall").collect()}
    assert recall == {"get_refund": (18, 0.833, None), "complaint": (153, 0.667, 0.699)}


def test_what_is_no_record_is_an_error(spark, tmp_path):
    path = tmp_path / "record.json"
    path.write_text(PUBLISHED)
    with pytest.raises(Exception, match="(?i)malformed"):
        runs.read_runs(spark, str(path)).collect()


def test_metric_record_has_four_digits(spark):
    row = spark.createDataFrame([("a", 0.123456, 0.99999, 1, 2, 3, 4)], "setting string, accuracy double, f1_macro double, tn long, fp long, fn long, tp long")
    out = runs.metric_record(row, ["setting"], "m").first()
    assert (out.metrics.accuracy, out.metrics.f1_macro, out.confusion_matrix.tp) == (0.1235, 1.0, 4)
