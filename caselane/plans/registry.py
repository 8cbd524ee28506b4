"""A name → (query, checking SQL) table filled by the modules beside it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from caselane.sources.views import Views

Build = Callable[[Views], DataFrame]

BUILDS: dict[str, Build] = {}
CHECKS: dict[str, str] = {}

MODULES = ("tables", "conversations", "scores", "review", "language", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        if name in BUILDS:
            raise ValueError(f"query {name} is registered twice")
        BUILDS[name] = build
        if sql:
            CHECKS[name] = sql
        return build

    return add


def six_digits(df: DataFrame) -> DataFrame:
    """Round floating results: the order of addition decides what comes after the sixth digit.

    Scaled, rounded and scaled back in floating point, as the checking engine does it: rounding the decimal text of
    a number instead gives another last digit where the number lies between two.
    """
    return df.select(*[
        (F.round(F.col(f.name) * 1e6) / 1e6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def load() -> None:
    for module in MODULES:
        import_module(f"caselane.plans.{module}")


def runner(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: six_digits(build(Views(spark, folder)))
