"""Exact deduplication by deterministic block naming.

A text is cut into fixed-size blocks. Distinct blocks are sorted within partitions and numbered, which gives every block
an integer name; then adjacent names are paired and the distinct pairs named in the same way, level by level, until each
document is left with one integer. Equal texts, and only they, end at the same (level, name).

The content of a block moves through one shuffle, in which repeats have already been folded by the map tasks. Everything
else moves integers: occurrences find the name of their block by a 128-bit key, and that no two different blocks share a
key is checked against the contents (a shared key means a new seed and a new start), so names are collision-free.
Every table that is joined has been written to the shared folder, so a lost executor costs a re-read, and adaptive
execution can split the rows of a hot name.

Defined cases: a null text counts as the empty text, which is one empty block. Only A-Z are lower-cased. Of equal texts
the row with the largest doc_id stays; null ids are smaller than all others, and of rows that share text and id one
stays. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from caselane.llm.rows import KEY_ID, KEY_MARK, take_rows
from caselane.session import written

BLOCK = 1024  # characters
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; the general lower() does just that where all is ASCII."""
    body = F.coalesce(text, F.lit(""))
    plain = F.octet_length(body) == F.char_length(body)
    return F.when(plain, F.lower(body)).otherwise(F.translate(body, UPPER, LOWER))


def blocks(text: Column, size: int = BLOCK) -> Column:
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def block_key(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(block, F.lit(seed)).alias("k1"), F.xxhash64(F.lit(seed + 1), block).alias("k2"))


def numbered(distinct: DataFrame, order: list[str], name: str) -> DataFrame:
    """Integers for the rows of a table of distinct things, in sorted order within each partition."""
    return distinct.sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


def block_names(texts: DataFrame, seed: int, size: int) -> DataFrame:
    """k1, k2, name: one row per distinct block."""
    found = (texts.select(F.explode(blocks(F.col("body"), size)).alias("block"))
             .withColumn("key", block_key(F.col("block"), seed)).select("key.k1", "key.k2", "block").distinct())
    return written(numbered(found, ["block"], "name").drop("block"), "block-names")


def identities(docs: DataFrame, row_id: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """row, doc_id, text_sha256, level, name for every row; (level, name) is the identity of its normalised text."""
    texts = docs.select(F.col(row_id).alias("doc_id"), lower_ascii(F.col(text)).alias("body"))
    seed = 0
    while True:
        names = block_names(texts, seed, size)
        if names.groupBy("k1", "k2").count().filter("count > 1").isEmpty():
            break
        seed += 2
    heads = written(texts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"),
        F.transform(blocks(F.col("body"), size), lambda b: block_key(b, seed)).alias("keys")), "block-keys")
    spread = written(heads.select("row", F.size("keys").alias("left"), F.posexplode("keys").alias("pos", "key"))
                     .select("row", "left", "pos", "key.k1", "key.k2"), "block-places")
    nodes = written(spread.join(names, ["k1", "k2"]).select("row", "left", "pos", "name"), "names-0")
    longest = heads.agg(F.max(F.size("keys"))).first()[0] or 1
    level, done = 0, [ended(nodes, 0)]
    while 2**level < longest:
        level += 1
        half = F.expr("pos DIV 2")
        pairs = written(
            nodes.filter("left > 1").groupBy("row", half.alias("pos"), F.expr("(left + 1) DIV 2").alias("left"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                 F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")), f"pairs-{level}")
        names = written(numbered(pairs.select("a", "b").distinct(), ["a", "b"], "name"), f"pair-names-{level}")
        nodes = written(pairs.join(names, ["a", "b"]).select("row", "left", "pos", "name"), f"names-{level}")
        done.append(ended(nodes, level))
    found = reduce(DataFrame.unionByName, done)
    return heads.drop("keys").join(found, "row")


def ended(nodes: DataFrame, level: int) -> DataFrame:
    return nodes.filter("left = 1").select("row", F.lit(level).alias("level"), "name")


def decide(docs: DataFrame, row_id: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    named = written(identities(docs, row_id, text, size), "identities")
    groups = written(named.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")), "groups")
    return named.join(groups, ["level", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256")


def dedup(docs: DataFrame, row_id: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """The rows that stay, with the input's columns.

    Rows that agree in id and text are told apart by their other columns; the largest of them stays.
    """
    rows = written(decide(docs, row_id, text, size), "decisions")
    keys = [F.col("doc_id").alias(KEY_ID), F.col("text_sha256").alias(KEY_MARK)]
    kept = written(rows.filter("kept").select(*keys), "kept")
    repeated = written(rows.groupBy(*keys).count().filter("count > 1").drop("count"), "repeated")
    return take_rows(docs, row_id, F.sha2(lower_ascii(F.col(text)).cast("binary"), 256), kept, repeated)


SQL = """
WITH texts AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM texts WINDOW same AS (PARTITION BY text_sha256)
"""
