"""The named inputs of the registered queries, as plain projections of the given tables.

Each view exists twice, as a DataFrame and as SQL text, so that a query and its check read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SQL = {
    "requests": "SELECT doc_id AS row_id, text AS instruction, lang AS category, source AS intent FROM documents",
    "flagged": """SELECT o_orderkey AS row_id, o_orderpriority AS intent, o_orderstatus AS category,
        o_orderstatus || substr(o_orderpriority, 3, 1) AS flags FROM orders""",
    "messages": """SELECT conv_id * 1000 + turn AS message_id, role = 'user' AS inbound, text,
        CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id, turn AS seq,
        conv_id * 1000 + turn + 1 AS next_id, conv_id * 1000 AS thread_id FROM conversations""",
    "tree": """SELECT p_partkey AS node_id, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 2 END AS parent_id
        FROM part""",
    "labeled": """SELECT labels.doc_id AS thread_id, toxic AS escalated,
        CASE WHEN toxic = 1 THEN source ELSE 'self_service' END AS category, source, lang,
        text AS first_customer_text, quality FROM labels JOIN documents ON labels.doc_id = documents.doc_id""",
    "scored": """SELECT event_id AS id, CAST(event_type IN ('error', 'purchase') AS INTEGER) AS y_true,
        event_type AS category, value / (1 + value) AS p_a,
        CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS p_b FROM events""",
    "predictions": """SELECT e.event_id AS id, CAST(event_type IN ('error', 'purchase') AS INTEGER) AS y_true,
        'h' || CAST(hour(ts) AS VARCHAR) AS category,
        CASE hour(ts) // 8 WHEN 0 THEN 'source_in' WHEN 1 THEN 'cross' ELSE 'target_in' END AS setting,
        CASE user_id % 3 WHEN 0 THEN 42 WHEN 1 THEN 1337 ELSE 2024 END AS seed,
        m.model, CASE WHEN m.model = 'a' THEN value / (1 + value)
        ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 END AS y_prob
        FROM events e CROSS JOIN (VALUES ('a'), ('b')) m(model)""",
    "audit_log": """SELECT thread_id,
        CASE WHEN lang = 'de' OR version = 2 THEN 1 - escalated ELSE escalated END AS human_escalated,
        CASE WHEN (lang = 'de' OR version = 2) = (escalated = 0) THEN source ELSE 'self_service' END
        AS human_category, 'v' || CAST(version AS VARCHAR) AS human_notes, version
        FROM (SELECT *, unnest([1, 2]) AS version FROM labeled WHERE quality = 1)
        WHERE version = 1 OR lang = 'fr'""",
    "reviews": """SELECT thread_id, human_escalated, human_category, human_notes, version
        FROM audit_log QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY version DESC) = 1""",
    "runs": """SELECT CASE s_nationkey % 2 WHEN 0 THEN 'uncased' ELSE 'cased' END AS encoder,
        s_suppkey AS seed, s_acctbal AS macro_f1 FROM supplier""",
}

# Views that are built on other views.
NEEDS = {"audit_log": ["labeled"], "reviews": ["labeled", "audit_log"]}


def with_views(names: str, body: str) -> str:
    """SQL text: the named views (with those they need) followed by ``body``.

    A ``body`` that begins with a comma adds its own common tables.
    """
    order: list[str] = []
    for name in names.split():
        for need in [*NEEDS.get(name, []), name]:
            if need not in order:
                order.append(need)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " " + body


class Views:
    """Lazily built DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def requests(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("row_id"), F.col("text").alias("instruction"),
            F.col("lang").alias("category"), F.col("source").alias("intent"))

    @property
    def flagged(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("intent"),
            F.col("o_orderstatus").alias("category"),
            F.concat("o_orderstatus", F.substring("o_orderpriority", 3, 1)).alias("flags"))

    @property
    def messages(self) -> DataFrame:
        """Conversation turns with both link columns; the last turn's listed response does not exist."""
        ident = F.col("conv_id") * 1000 + F.col("turn")
        return self.table("conversations").select(
            ident.alias("message_id"), (F.col("role") == "user").alias("inbound"), "text",
            F.when(F.col("turn") > 0, ident - 1).alias("parent_id"), F.col("turn").alias("seq"),
            F.array(ident + 1).alias("response_ids"), (F.col("conv_id") * 1000).alias("thread_id"))

    @property
    def tree(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("node_id"),
            F.when(F.col("p_partkey") > 0, F.expr("(p_partkey - 1) DIV 2")).alias("parent_id"))

    @property
    def labeled(self) -> DataFrame:
        return self.table("labels").join(self.table("documents"), "doc_id").select(
            F.col("doc_id").alias("thread_id"), F.col("toxic").alias("escalated"),
            F.when(F.col("toxic") == 1, F.col("source")).otherwise("self_service").alias("category"),
            "source", "lang", F.col("text").alias("first_customer_text"), "quality")

    @property
    def scored(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("double")
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("event_type").isin("error", "purchase").cast("int").alias("y_true"),
            F.col("event_type").alias("category"),
            (F.col("value") / (1 + F.col("value"))).alias("p_a"), (k / 100).alias("p_b"))

    @property
    def predictions(self) -> DataFrame:
        """One row per event and model, with the experiment cell it belongs to."""
        k = F.get_json_object("props", "$.k").cast("double")
        part = F.floor(F.hour("ts") / 8)
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("event_type").isin("error", "purchase").cast("int").alias("y_true"),
            F.concat(F.lit("h"), F.hour("ts").cast("string")).alias("category"),
            F.when(part == 0, "source_in").when(part == 1, "cross").otherwise("target_in").alias("setting"),
            F.when(F.col("user_id") % 3 == 0, 42).when(F.col("user_id") % 3 == 1, 1337).otherwise(2024).alias("seed"),
            F.inline(F.array(
                F.struct(F.lit("a").alias("model"), (F.col("value") / (1 + F.col("value"))).alias("y_prob")),
                F.struct(F.lit("b").alias("model"), (k / 100).alias("y_prob")),
            )))

    @property
    def audit_log(self) -> DataFrame:
        """Reviews of the good-quality threads: German labels are reversed, French ones reversed on second look."""
        twice = self.labeled.filter("quality = 1").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
        rows = twice.filter("version = 1 OR lang = 'fr'")
        flipped = (F.col("lang") == "de") | (F.col("version") == 2)
        human = F.when(flipped, 1 - F.col("escalated")).otherwise(F.col("escalated"))
        return rows.select(
            "thread_id", human.alias("human_escalated"),
            F.when(human == 1, F.col("source")).otherwise("self_service").alias("human_category"),
            F.concat(F.lit("v"), F.col("version").cast("string")).alias("human_notes"), "version")

    @property
    def runs(self) -> DataFrame:
        return self.table("supplier").select(
            F.when(F.col("s_nationkey") % 2 == 0, "uncased").otherwise("cased").alias("encoder"),
            F.col("s_suppkey").alias("seed"), F.col("s_acctbal").alias("macro_f1"))

    @property
    def message_events(self) -> DataFrame:
        """The events as a stream of files."""
        from caselane.streaming.live import message_stream

        schema = self.table("events").schema
        stream = message_stream(self.spark, f"{self.folder}/events.parquet", schema)
        return stream.withColumn("ts", F.col("ts").cast("timestamp"))
