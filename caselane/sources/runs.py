"""Metric records: nested JSON written per experiment, and Parquet for the table of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

CONFUSION = T.StructType([T.StructField(n, T.LongType()) for n in ("tn", "fp", "fn", "tp")])

METRICS = T.StructType([
    T.StructField(n, T.DoubleType())
    for n in ("accuracy", "precision_macro", "recall_macro", "f1_macro", "roc_auc")
])

CATEGORY_RECALL = T.MapType(T.StringType(), T.StructType([
    T.StructField("threads", T.LongType()),
    T.StructField("base_recall", T.DoubleType()),
    T.StructField("model_recall", T.DoubleType()),
]))

RECORD = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("setting", T.StringType()),
    T.StructField("train_samples", T.LongType()),
    T.StructField("test_samples", T.LongType()),
    T.StructField("metrics", METRICS),
    T.StructField("confusion_matrix", CONFUSION),
    T.StructField("category_recall", CATEGORY_RECALL),
])


# The fields that make a struct of a record a block of metrics.
BLOCK = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_escalated", "recall_escalated",
         "f1_escalated", "roc_auc")
CELLS = ("tn", "fp", "fn", "tp")
DIGITS = 4


def round4(value: Column) -> Column:
    """Four digits, as records keep their metrics."""
    return F.round(value * 10**DIGITS) / 10**DIGITS


def metric_record(metrics: DataFrame, keys: list[str], model_name: str) -> DataFrame:
    """Rows of ``binary_metrics`` as records: rounded metrics and the matrix, nested."""
    return metrics.select(
        F.lit(model_name).alias("model_name"), *keys,
        F.struct(*[round4(F.col(c)).alias(c) for c in BLOCK if c in metrics.columns]).alias("metrics"),
        F.struct(*CELLS).alias("confusion_matrix"))


def write_runs(records: DataFrame, path: str, fmt: str = "json") -> str:
    records.write.mode("overwrite").format(fmt).save(path)
    return path


def read_runs(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType | None = RECORD,
              pretty: bool = False) -> DataFrame:
    """Records as JSON lines or, with ``pretty``, as files of one indented record each.

    A text that is no record of the schema is an error, not a row of NULLs. Without a schema the fields are those that
    the files have, whichever blocks, histories and sweeps a kind of experiment records.
    """
    reader = spark.read.format(fmt)
    if fmt != "json":
        return reader.load(path)
    reader = reader.option("multiLine", pretty).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).load(path)


def metric_blocks(records: DataFrame, keys: list[str]) -> DataFrame:
    """One row per record and block of metrics, with the block's name; a metric that it lacks is NULL."""
    parts = []
    for field in records.schema.fields:
        if not isinstance(field.dataType, T.StructType) or "f1_macro" not in field.dataType.names:
            continue
        names, at = field.dataType.names, F.col(field.name)
        own = "confusion_matrix" in names
        matrix = at["confusion_matrix"] if own else F.col("confusion_matrix") if "confusion_matrix" in records.columns else None
        parts.append(records.filter(at.isNotNull()).select(
            *keys, F.lit(field.name).alias("block"),
            *[(at[c] if c in names else F.lit(None)).cast("double").alias(c) for c in BLOCK],
            *[(matrix[c] if matrix is not None else F.lit(None)).cast("long").alias(c) for c in CELLS]))
    return reduce(DataFrame.unionByName, parts)


def explode_rows(records: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A list of structs (training history, sweep, seeds) as one row per entry, with its place."""
    return records.select(*keys, F.posexplode(column).alias("place", "_v")).select(*keys, "place", "_v.*")


def explode_struct(records: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A struct whose fields are structs (figures per category) as one row per field."""
    fields = records.schema[column].dataType.names
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.to_json(F.col(column)[n]).alias("entry")) for n in fields])
    shape = records.schema[column].dataType
    merged = T.StructType(list({f.name: f for n in fields for f in shape[n].dataType.fields}.values()))
    rows = records.select(*keys, F.explode(entries).alias("_e")).filter("_e.entry IS NOT NULL")
    return rows.select(*keys, "_e.name", F.from_json("_e.entry", merged).alias("_v")).select(*keys, "name", "_v.*")


def explode_category_recall(records: DataFrame, keys: list[str], column: str = "category_recall") -> DataFrame:
    """One row per record and category."""
    return records.select(*keys, F.explode(column).alias("category", "_v")).select(*keys, "category", "_v.*")


def explode_json_map(df: DataFrame, keys: list[str], column: str, value_type: str = "double") -> DataFrame:
    """The same flattening for a map that is still JSON text."""
    parsed = F.from_json(F.col(column), f"map<string,{value_type}>")
    return df.select(*keys, F.explode(parsed).alias("name", "value"))


def union_runs(*parts: DataFrame) -> DataFrame:
    """Stack run tables whose columns differ; a column one of them lacks is NULL there."""
    first, *others = parts
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
