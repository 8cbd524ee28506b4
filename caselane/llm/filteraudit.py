"""Audit of filters that overlap: what each removes in every order, and its Shapley share of all that goes.

Five filters make 32 sets of filters. A document is known to the audit by the set of filters that it fails, so the table of
documents shrinks, in every map task, to at most 32 counts a part; from these come the removals v(S) of each set S of
filters (``coalitions``). A step of an order of filters is a difference of two of them.

The Shapley values are the coefficients phi of the additive model that comes nearest to v: the least squares over all sets S
of w(|S|) (v(S) - sum of phi in S)^2 with the kernel w(s) = (n - 1) / (C(n, s) s (n - s)), under the constraint that the
phi add up to v of all filters. Their normal equations with the multiplier of the constraint do not depend on the counts,
so ``shapley_weights`` solves them once, in rationals, for a unit removal of each set; every part's values are then whole
sums of its 32 removals. Multiplied by the number of orders they are integers.

Defined cases: a null text is empty, and so equal to an empty one; without words a text fails the first filter and passes the
second. A null doc_id is not smaller than any, nor is any smaller than it. Rows that repeat the smallest doc_id of a text do not
fail the last filter, as no smaller one has it. A null source is the part of the empty source. Documents without labels are
neither good nor toxic; of several labels of a doc_id one is enough. An empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, functions as F

from caselane.operators.ordered import lookup_join
from caselane.session import written

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5  # words, per cent of words, per cent of code points
SYMBOLS = r"[#$%&*|]"
COUNTED = ("n", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides, by the name of the filter; ``text`` is not null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    return {
        "A": counts["all"] < LEAST_WORDS,
        "B": 100 * counts["distinct"] < LEAST_DISTINCT * counts["all"],
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def text_key(text: Column) -> Column:
    """What equal texts share and no others."""
    return F.unhex(F.sha2(text, 256))


def repeats(rows: DataFrame, key: str, row_id: str) -> DataFrame:
    """Add ``repeat``: whether a smaller id has the same key. Only keys of several ids are looked up; hot ones are broadcast."""
    first = rows.groupBy(key).agg(F.min(row_id).alias("first"), F.max(row_id).alias("last")).filter("first < last").drop("last")
    found = lookup_join(rows, written(first, "repeated"), key, rows.count())
    return found.withColumn("repeat", F.coalesce(F.col(row_id) > F.col("first"), F.lit(False))).drop("first")


def labelled(rows: DataFrame, labels: DataFrame, row_id: str) -> DataFrame:
    """Add ``good`` and ``toxic``, 0 or 1."""
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(row_id)).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    found = lookup_join(rows, written(marks, "marks"), row_id, rows.count())
    return found.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (a bit for each filter that the document fails), good and toxic of every document."""
    text = F.coalesce("text", F.lit(""))
    alone = text_filters(text)
    bits = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(alone.values())), F.lit(0))
    rows = written(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), bits.alias("failed"), text_key(text).alias("same")), "failures")
    rows = written(repeats(rows, "same", "doc_id").select(
        "doc_id", "part", (F.col("failed") + F.when(F.col("repeat"), 1 << len(alone)).otherwise(0)).alias("failed")), "failures")
    return labelled(rows, labels, "doc_id")


def coalitions(failed: DataFrame, filters: int) -> DataFrame:
    """part, n (documents) and removed: for each set of filters (its bits are the place) the counts of what it removes."""
    kinds = failed.groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    def removed(bits: int) -> Column:
        hit = F.col("failed").bitwiseAND(F.lit(bits)) != 0
        return F.struct(*[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in COUNTED])

    return kinds.groupBy("part").agg(F.sum("n").alias("n"), F.array(*[removed(s) for s in range(1 << filters)]).alias("removed"))


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """The solutions of a regular system for several right-hand sides, by elimination in rationals."""
    rows = [a + b for a, b in zip(matrix, right)]
    size = len(matrix)
    for k in range(size):
        pivot = next(r for r in range(k, size) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(size):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k])]
    return [row[size:] for row in rows]


def shapley_weights(filters: int) -> list[list[int]]:
    """Per filter what a removal of each set counts in its Shapley value times the number of orders."""
    sets = range(1 << filters)
    everything = sets[-1]

    def kernel(s: int) -> Fraction:
        size = s.bit_count()
        return Fraction(filters - 1, comb(filters, size) * size * (filters - size)) if 0 < size < filters else Fraction(0)

    def holds(s: int, k: int) -> int:
        return s >> k & 1

    # Stationarity: for each filter k  sum over S of w(S) [k in S] (sum of phi in S) + multiplier = sum over S of w(S) [k in S] v(S)
    matrix = [[sum((kernel(s) * holds(s, k) * holds(s, j) for s in sets), Fraction(0)) for j in range(filters)] + [Fraction(1)] for k in range(filters)]
    matrix.append([Fraction(1)] * filters + [Fraction(0)])
    right = [[kernel(s) * holds(s, k) for s in sets] for k in range(filters)]
    right.append([Fraction(int(s == everything)) for s in sets])
    found = [[x * factorial(filters) for x in row] for row in solve(matrix, right)[:filters]]
    if any(x.denominator != 1 for row in found for x in row):
        raise ArithmeticError("Shapley weights of the sets are not whole")
    return [[int(x) for x in row] for row in found]


def audit(failed: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters (one letter each) and step."""
    filters = len(names)
    everything = (1 << filters) - 1
    v = lambda bits, count: F.get(F.col("removed"), bits)[count]
    weights = shapley_weights(filters)
    shares = F.array(*[sum((F.col("removed")[s]["n"] * w for s, w in enumerate(row) if w), F.lit(0)) for row in weights])
    known = coalitions(failed, filters).withColumn("shares", shares)
    orders = known.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(names)])))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(filters))))
    place = {k: F.instr("filter_order", name) for k, name in enumerate(names)}
    upto = steps.withColumns({
        "before": sum((F.when(at < F.col("step"), 1 << k).otherwise(0) for k, at in place.items()), F.lit(0)),
        "own": sum((F.when(at == F.col("step"), 1 << k).otherwise(0) for k, at in place.items()), F.lit(0)),
        "number": sum((F.when(at == F.col("step"), k).otherwise(0) for k, at in place.items()), F.lit(0)),
    })
    after = F.col("before") + F.col("own")
    gone = {c: v(after, c) - v(F.col("before"), c) for c in COUNTED}
    return upto.select(
        "part", "filter_order", "step", (F.col("n") - v(after, "n")).alias("kept"), gone["n"].alias("removed"),
        (v(F.col("own"), "n") - gone["n"]).alias("redundant"),
        (v(F.lit(everything), "n") - v(F.lit(everything) - F.col("own"), "n")).alias("unique_fails"),
        gone["good"].alias("good_lost"), gone["toxic"].alias("toxic_lost"), F.get("shares", F.col("number")).alias("shapley"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(failures(docs, labels), "ABCDE")


SQL = r"""WITH RECURSIVE marks AS (SELECT doc_id, CAST(max(coalesce(quality = 1, false)) AS INTEGER) AS good,
    CAST(max(coalesce(toxic = 1, false)) AS INTEGER) AS toxic FROM labels GROUP BY doc_id),
    d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
    f AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN len(words) < 50
        WHEN 'B' THEN 100 * len(list_distinct(words)) < 65 * len(words)
        WHEN 'C' THEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text)
        WHEN 'D' THEN regexp_matches(text, '[#$%&*|]') ELSE coalesce(doc_id > first, false) END) AS fails,
        coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN marks USING (doc_id)),
    kinds AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
    orders(o) AS (SELECT '' UNION ALL SELECT o || l FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) x(l) WHERE NOT contains(o, l)),
    steps AS (SELECT o AS filter_order, step, o[step] AS own, string_split(o[:step - 1], '') AS earlier
        FROM orders, range(1, 6) r(step) WHERE length(o) = 5),
    cells AS (SELECT part, filter_order, step, own, n, good, toxic, list_contains(fails, own) AS hit,
        len(list_intersect(fails, earlier)) > 0 AS gone, len(fails) = 1 AS alone FROM kinds, steps),
    counted AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN hit AND alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost FROM cells GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
        CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
        CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted"""
