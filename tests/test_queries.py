"""Every registered query against its SQL on the smallest tables, and the shape of a few plans."""

import duckdb
import pytest

import __spark_entry__ as contract
from caselane.plans import registry
from tools.check_queries import TABLES

RUNS = {name: run for name, run in contract.queries().items() if name in registry.BUILDS}
CHECKS = {name: sql for name, sql in contract.oracle_sql().items() if name in registry.BUILDS}


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, duck, folder, name):
    df = RUNS[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    rel = duck.sql(CHECKS[name])
    assert sorted(rel.columns) == cols
    pick = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(r[i] for i in pick)) for r in rel.fetchall())


def test_every_check_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and len(RUNS) == len(registry.BUILDS)


def test_entry(spark):
    assert contract.entry(spark).count() == 2


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_plans(spark, folder):
    dedup = plan(RUNS["dedup_first"](spark, folder))
    assert "Window" not in dedup and dedup.count("Exchange hashpartitioning") == 1
    unrepeated = dedup.split("Union")[1].split("SortAggregate")[0]  # rows whose text is unique stay where they are
    assert "LeftAnti" in unrepeated and "Exchange hashpartitioning" not in unrepeated
    balance = plan(RUNS["class_category_sizes"](spark, folder))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in balance
    confusion = plan(RUNS["confusion"](spark, folder))
    assert confusion.count("Exchange") == 1 and "event_id" not in confusion.split("ReadSchema")[1]
    assert "CartesianProduct" not in dedup + balance + confusion
    top = plan(RUNS["top_k_longest"](spark, folder))
    assert "TakeOrderedAndProject" in top
