"""Quoted CSV read in splits against Spark's multi-line reading of whole files."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from caselane.sources import quoted, readers

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("c", T.StringType())])


def write(path, rows, terminator="\n", quoting=csv.QUOTE_MINIMAL, end=True):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=terminator, quoting=quoting)
    writer.writerow(["a", "b", "c"])
    writer.writerows(rows)
    text = out.getvalue() if end else out.getvalue().removesuffix(terminator)
    path.write_bytes(text.encode())
    return str(path)


def odd_rows(seed, n):
    rng = random.Random(seed)
    parts = ['"', '""', "\n", "\n\n", ",", "x", "é😀", " ", "", '"\n"', "end", ',"\n', "'", "\\"]
    return [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))), rng.choice(["", "z", '"q"', "a\nb"])) for k in range(n)]


def same(spark, path, size=quoted.PIECE):
    whole = spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    got = quoted.read_split_csv(spark, path, SCHEMA, size=size)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))
    return got


@pytest.fixture()
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield use
    for n, value in before.items():
        spark.conf.set(n, value)


@pytest.mark.parametrize("split", [7, 11, 64, 301])
def test_cut_anywhere(spark, tmp_path, small_splits, split):
    """Splits of a few bytes: nearly every field is cut, some over several splits."""
    path = write(tmp_path / "f.csv", odd_rows(split, 40))
    small_splits(split)
    assert spark.read.text(path).rdd.getNumPartitions() > 2
    same(spark, path, size=1)


@pytest.mark.parametrize("terminator, quoting, end", [("\r\n", csv.QUOTE_MINIMAL, True), ("\n", csv.QUOTE_ALL, False), ("\n", csv.QUOTE_NONNUMERIC, True)])
def test_ways_of_writing(spark, tmp_path, small_splits, terminator, quoting, end):
    path = write(tmp_path / "f.csv", odd_rows(5, 60), terminator, quoting, end)
    small_splits(97)
    same(spark, path, size=30)


def test_several_files_and_empty_ones(spark, tmp_path, small_splits):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        write(folder / f"{k}.csv", odd_rows(k, 15 * k))
    (folder / "none.csv").write_text("")
    small_splits(50)
    assert same(spark, str(folder), size=20).count() == 45


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    rows = [(k, f"line {k}\n\"{'x' * (k % 50)}\"\n", "z") for k in range(5000)]
    path = write(tmp_path / "f.csv", rows)
    small_splits(20_000)
    found = quoted.pieces(spark, path, 4_000)
    assert found.select("file", "start").distinct().count() > 8
    assert same(spark, path, 4_000).count() == 5000


def test_long_field_over_many_pieces(spark, tmp_path, small_splits):
    path = write(tmp_path / "f.csv", [(1, "a\n" * 20_000 + '"', "x"), (2, "b", "y"), (3, "\n" * 500, "z")])
    small_splits(5_000)
    rows = same(spark, path, 1_000).orderBy("a").collect()
    assert len(rows[0].b) == 40_001 and rows[2].b == "\n" * 500


def test_header_with_breaks(spark, tmp_path, small_splits):
    path = tmp_path / "f.csv"
    path.write_text('a,"b\nb","c\n\n"\n1,x,"y\nz"\n')
    small_splits(3)
    assert [tuple(r) for r in same(spark, str(path), 1).collect()] == [(1, "x", "y\nz")]


def test_named_readers_use_it(spark, tmp_path, small_splits):
    rows = [(f"f{k}", f'say ""{k}""\nplease', "c", "i", "r") for k in range(30)]
    frame = spark.createDataFrame(rows, readers.REQUESTS)
    path = readers.write_quoted_csv(frame, str(tmp_path / "r"))
    small_splits(40)
    assert sorted(map(tuple, readers.read_requests(spark, path).collect())) == sorted(rows)
