from caselane.operators import audit

LABELS = "thread_id long, escalated int, category string"
REVIEWS = "thread_id long, human_escalated int, human_category string, human_notes string, version int"


def tables(spark):
    labels = spark.createDataFrame([(1, 0, "self_service"), (2, 1, "complaint"), (3, 0, "self_service")], LABELS)
    log = spark.createDataFrame(
        [(1, 1, "complaint", "missed", 1), (1, 0, "self_service", "no", 2), (2, 1, "get_refund", "", 1),
         (99, 1, "complaint", "unknown thread", 1)], REVIEWS)
    return labels, log


def test_progress_ignores_unknown_threads(spark):
    labels, log = tables(spark)
    row = audit.audit_progress(labels, log).first()
    assert (row.total, row.audited, row.pending) == (3, 2, 1)


def test_queue_and_ends(spark):
    labels, log = tables(spark)
    assert [r.thread_id for r in audit.audit_queue(labels, log, "pending").collect()] == [3]
    assert sorted(r.thread_id for r in audit.audit_queue(labels, log, "audited").collect()) == [1, 2]
    ends = sorted(tuple(r) for r in audit.audit_neighbors(audit.audit_queue(labels, log, "all")).collect())
    assert ends == [(1, 1, 2), (2, 1, 3), (3, 2, 3)]


def test_submit_replaces_and_confirm_does_not(spark):
    labels, log = tables(spark)
    new = spark.createDataFrame([(1, 1, "payment_issue", "third look", 3), (3, 0, "self_service", "fine", 1)], REVIEWS)
    got = {r.thread_id: r.human_category for r in audit.submit(log, new).collect()}
    assert got == {1: "payment_issue", 2: "get_refund", 3: "self_service", 99: "complaint"}
    kept = {r.thread_id: r.human_notes for r in audit.confirm(audit.latest(log), labels).collect()}
    assert kept == {1: "no", 2: "", 3: "confirmed", 99: "unknown thread"}


def test_changed_and_corrected(spark):
    labels, log = tables(spark)
    latest = audit.latest(log)
    assert [r.thread_id for r in audit.changed(labels, latest).collect()] == [2]
    got = {r.thread_id: r.category for r in audit.corrected_labels(labels, latest).collect()}
    assert got == {1: "self_service", 2: "get_refund", 3: "self_service"}
    defaults = {r.thread_id: r.default_notes for r in audit.audit_defaults(labels, latest).collect()}
    assert defaults == {1: "no", 2: "", 3: ""}
