"""Mixing sources to target weights.

Words are counted per source, targets follow from weights, and each document is emitted ``floor(rate)`` times plus one
hash-seeded Bernoulli copy whose probability is the fraction of the rate. Only one row per source leaves the map tasks;
texts are never shuffled unless the source table is too large for Spark's own broadcast limit, in which case adaptive
execution splits the rows of a hot source.

Defined cases: a null text has no words; a null source is a source of its own, last in the order; an empty table gives
an empty result; a source without words gets target 0 and none of its documents. Rows that share a doc_id share the
draw, and a null doc_id is drawn as the empty string. Input columns pass through; columns named ``mix_*`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caselane.operators.ordered import running_sums
from caselane.session import durable

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)  # by place of the source in code point order, repeating
SHARE = 1.5  # of all words, to be taken in total
MOST = 2.0  # times its words a source may be taken
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(row_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(row_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """One row per source of ``sizes`` (mix_source, mix_size): mix_source, mix_source_size, mix_target.

    The level (words per unit of weight) starts at all words over all weight. Sources that it would take above their
    limit stop there and the rest is dealt out again, until no further source stops. A round is one aggregate over the
    source table, and only sums reach the driver.
    """
    per_source = (sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("mix_source_size"))
                  .withColumn("last", F.col("mix_source").isNull()))
    ranked = durable(running_sums(per_source, [], ["last", "mix_source"], {"place": F.lit(1)}))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = ranked.withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    top = F.lit(most) * F.col("mix_source_size")
    total, weight = table.agg(F.sum("mix_source_size"), F.sum("weight")).first()
    goal = share * (total or 0)
    level, stopped = goal / weight if weight else 0.0, -1
    while True:
        full = top <= F.lit(level) * F.col("weight")
        count, used, free = table.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, top)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if count == stopped or not free:
            break
        level, stopped = (goal - used) / free, count
    full = top <= F.lit(level) * F.col("weight")
    return table.select("mix_source", "mix_source_size",
                        F.when(full, top).otherwise(F.lit(level) * F.col("weight")).alias("mix_target"))


def decide(docs: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id",
           weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
           seed: str = SEED) -> DataFrame:
    """Every row with mix_size, mix_source_size, mix_target and mix_copies."""
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    sized = docs.withColumn("mix_size", word_count(F.col(text)))
    goals = durable(targets(sized.select(F.col(source).alias("mix_source"), "mix_size"), weights, share, most))
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (draw(F.col(row_id), seed) < rate - whole).cast("long")
    return (sized.join(goals, sized[source].eqNullSafe(goals["mix_source"]), "left").drop("mix_source")
            .withColumn("mix_copies", whole + extra))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: each document as many times as its source's rate asks for, with the input's columns."""
    return (decide(docs, **settings).withColumn("mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("mix_copies").cast("int"))))
            .select(*[c for c in docs.columns if not c.startswith("mix_")]))


def report(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, copies and the words taken, for every document."""
    return decide(docs, **settings).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_copies").alias("copies"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM sized GROUP BY source),
weighed AS (
  SELECT source, n, 2.0 * CAST(n AS DOUBLE) AS top,
    CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w
  FROM sources),
steps AS (
  SELECT top / w AS upto, sum(top) OVER (ORDER BY top / w) AS used,
    (SELECT sum(w) FROM weighed) - sum(w) OVER (ORDER BY top / w) AS free FROM weighed
  UNION ALL SELECT -1, 0, (SELECT sum(w) FROM weighed)),
levels AS (
  SELECT upto, (1.5 * CAST((SELECT sum(n) FROM sources) AS DOUBLE) - used) / free AS level,
    lead(upto) OVER (ORDER BY upto) AS next FROM (SELECT DISTINCT * FROM steps) WHERE free > 0),
chosen AS (SELECT level FROM levels WHERE next IS NULL OR level < next ORDER BY upto LIMIT 1),
goals AS (
  SELECT source, n, CASE WHEN top <= level * w THEN top ELSE level * w END AS target FROM weighed, chosen),
rated AS (
  SELECT doc_id, size, n AS source_size, target, CASE WHEN n > 0 THEN target / n ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / CAST(16**13 AS DOUBLE) AS draw
  FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM (
  SELECT *, CAST(floor(rate) AS BIGINT) + CAST(draw < rate - floor(rate) AS BIGINT) AS copies FROM rated)
"""
