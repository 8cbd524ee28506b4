"""The registered queries: each operator over its whole table, and the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caselane.llm import (
    exactdup, filteraudit, langid, merkle, mixing, nndescent, packing, secrets, sharding, simhash, styletree, variants, warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def over(*tables_and_report) -> Query:
    """A query that gives the named tables to the operator."""
    *tables, report = tables_and_report
    return lambda spark, folder: report(*[spark.read.parquet(f"{folder.rstrip('/')}/{t}.parquet") for t in tables])


QUERIES: dict[str, Query] = {
    "op1_mixing": over("documents", mixing.report),
    "op2_exact_dedup": over("documents", exactdup.decide),
    "op3_style_tree": over("pages", styletree.report),
    "op4_warc": over("pages", warc.report),
    "op5_language": over("documents", langid.report),
    "op6_secrets": over("documents", secrets.report),
    "op7_packing": over("documents", packing.pack),
    "op8_sharding": over("documents", sharding.report),
    "op9_merkle": over("documents", merkle.report),
    "op10_simhash": over("documents", simhash.report),
    "op11_variants": over("documents", variants.report),
    "op12_filter_audit": over("documents", "labels", filteraudit.report),
    "op13_nn_descent": over("embeddings", nndescent.report),
}

SQL: dict[str, str] = {"op1_mixing": mixing.SQL, "op2_exact_dedup": exactdup.SQL, "op4_warc": warc.SQL,
                       "op9_merkle": merkle.SQL, "op12_filter_audit": filteraudit.SQL, "op13_nn_descent": nndescent.SQL}
