"""What a task of the CSV reader holds at a time."""

from pyspark.sql import functions as F

from caselane.sources import quoted

ARROW_ROWS = 10_000  # rows that Spark hands to a Python task at a time


def test_pieces_of_a_batch_are_bounded(spark, tmp_path, monkeypatch):
    assert quoted.PIECE * ARROW_ROWS <= 1 << 28
    path = str(tmp_path / "t.csv")
    rows = [(k, f'line {k}\nsays "{"x" * (k % 50)}", so' * (k % 9)) for k in range(400)]
    with open(path, "w", newline="") as file:
        file.write("id,t\n" + "".join('{},"{}"\n'.format(k, t.replace('"', '""')) for k, t in rows))
    longest = quoted.pieces(spark, path).agg(F.max(F.length("body"))).first()[0]
    assert longest < quoted.PIECE + 1000
    monkeypatch.setattr(quoted, "HELD", 1)
    got = quoted.records(spark, path).select(F.from_csv("record", "id long, t string", quoted.OPTIONS).alias("r")).select("r.*")
    assert sorted((r.id, r.t or "") for r in got.collect()) == rows
