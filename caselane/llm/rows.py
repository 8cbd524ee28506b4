"""Taking whole rows back by the keys that an operator decided on."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

KEY_ID, KEY_MARK = "_key_id", "_key_mark"


ROWS_AT_A_TIME = 512


def objects(column: pa.Array) -> Iterator:
    """The values of an Arrow column, of which only some are Python objects at any time."""
    for at in range(0, len(column), ROWS_AT_A_TIME):
        yield from column.slice(at, ROWS_AT_A_TIME).to_pylist()


def take_rows(docs: DataFrame, row_id: str, mark: Column, kept: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (id, mark) is in ``kept``, one for each key, with the columns of ``docs``.

    ``kept`` and ``repeated`` have the columns KEY_ID and KEY_MARK; ``repeated`` lists the kept keys that several rows
    share, of which the largest row stays. Both are written tables, so a small one is broadcast by Spark's own limit and a
    large one is joined by shuffle. Rows travel as one struct, so no column of theirs can clash with a key.
    """
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col(row_id).alias("id"), mark.alias("mark"))
    same = F.col("id").eqNullSafe(F.col(KEY_ID)) & (F.col("mark") == F.col(KEY_MARK))
    found = marked.join(kept, same, "left_semi")
    single = found.join(repeated, same, "left_anti").select("row")
    several = found.join(repeated, same, "left_semi").groupBy("id", "mark").agg(F.max("row").alias("row")).select("row")
    return single.unionByName(several).select("row.*")
