"""Quoted CSV read by many tasks, whatever line breaks its fields hold.

Spark cannot split a CSV file whose fields hold line breaks: a task that starts in the middle does not know whether it
starts within quotes. Whether it does follows from the quotes before it. The lines of a file are read split by split, as any text
file, and put together to pieces of some size with their number of quotes; running sums of these numbers tell for every piece
whether it begins within a field. Then each piece cuts its own records, and only what crosses the end of a piece moves: the open
end of one and the beginnings of those that follow. A record is parsed by Spark's own CSV functions.

What is asked of a file is what the usual writers give: fields that hold a quote, a separator or a break are quoted, and
quotes within them doubled. Files are read as UTF-8.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from caselane.operators.ordered import running_sums
from caselane.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 1 << 14  # characters of a piece, above which it is closed at the next line; a task gets thousands of them at a time
HELD = 1 << 22  # characters of records that a task gathers before it hands them on
OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
BREAK = "\n"


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch one after the other, so that its texts are not all held twice."""
    for k in range(len(batch)):
        yield tuple(column[k].as_py() for column in batch.columns)


def pieces(spark: SparkSession, path: str | list[str], size: int = PIECE) -> DataFrame:
    """file, start (of the split), piece (number within it), body and quotes, written down.

    The split that a line comes from is known to Spark, and its lines come in order. Whatever the splits are, they are
    used in this one job only.
    """
    lines = spark.read.option("lineSep", BREAK).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, held, length = None, 0, [], 0

        def row() -> pa.RecordBatch:
            body = BREAK.join(held) + BREAK
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([number], pa.int64()), pa.array([body]),
                 pa.array([body.count('"')], pa.int64())], ["file", "start", "piece", "body", "quotes"])

        for batch in batches:
            for file, start, line in rows_of(batch):
                if (file, start) != key:
                    if held:
                        yield row()
                    key, number, held, length = (file, start), 0, [], 0
                held.append(line)
                length += len(line) + 1
                if length >= size:
                    yield row()
                    number, held, length = number + 1, [], 0
        if held:
            yield row()

    return written(lines.mapInArrow(gather, "file string, start long, piece long, body string, quotes long"), "pieces")


def record_ends(body: str, within: bool) -> list[int]:
    """Where records end in a piece: after each line break outside quotes."""
    ends, at = [], 0
    for part in body.split('"'):
        if not within:
            cut = part.find(BREAK)
            while cut >= 0:
                ends.append(at + cut + 1)
                cut = part.find(BREAK, cut + 1)
        at += len(part) + 1
        within = not within
    return ends


def records(spark: SparkSession, path: str | list[str], header: bool = True, size: int = PIECE) -> DataFrame:
    """record: the text of every record of the files, without the header's."""
    found = pieces(spark, path, size)
    sums = running_sums(found.select("file", "start", "piece", "quotes"), ["file"], ["start", "piece"], {"upto": F.col("quotes")})
    within = sums.select("file", "start", "piece", ((F.col("upto") - F.col("quotes")) % 2 == 1).alias("within"))
    marked = found.join(within, ["file", "start", "piece"]).select("file", "start", "piece", "within", "body")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            columns = list(zip(*held)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "start", "piece", "kind", "body", "first"])

        held, length = [], 0  # kind 0: whole records, 1: end or middle of an open one, 2: beginning of one
        for batch in batches:
            for file, start, piece, inside, body in rows_of(batch):
                ends = record_ends(body, inside)
                top = header and start == 0 and piece == 0
                begin = 0
                if inside:
                    begin = ends.pop(0) if ends else len(body)
                    held.append((file, start, piece, 1, body[:begin], False))
                for end in ends:
                    if not (top and begin == 0):
                        held.append((file, start, piece, 0, body[begin:end], False))
                    begin = end
                if begin < len(body):
                    held.append((file, start, piece, 2, body[begin:], top and begin == 0))
                length += len(body)
                if length >= HELD:
                    yield out()
                    held, length = [], 0
        yield out()

    parts = written(marked.mapInArrow(cut, "file string, start long, piece long, kind int, body string, first boolean"), "parts")
    crossing = parts.filter("kind > 0")
    numbered = running_sums(crossing.select("file", "start", "piece", "kind"), ["file"], ["start", "piece", "kind"],
                            {"opened": F.when(F.col("kind") == 2, 1).otherwise(0)})
    placed = crossing.join(numbered, ["file", "start", "piece", "kind"])
    whole = placed.groupBy("file", "opened").agg(
        F.bool_or("first").alias("first"), F.sort_array(F.collect_list(F.struct("start", "piece", "kind", "body"))).alias("run"))
    joined = whole.filter("NOT first").select(F.array_join("run.body", "").alias("record"))
    every = parts.filter("kind = 0").select(F.col("body").alias("record")).unionByName(joined)
    return every.select(F.regexp_replace("record", r"\r?\n\z", "").alias("record")).filter("record <> ''")


def schema_ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def read_split_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, header: bool = True, size: int = PIECE) -> DataFrame:
    """The rows of quoted CSV files, equal to Spark's own multi-line reading of them by one task a file."""
    return records(spark, path, header, size).select(F.from_csv("record", schema_ddl(schema), OPTIONS).alias("row")).select("row.*")
