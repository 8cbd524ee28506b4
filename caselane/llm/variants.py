"""Spelling variants by a dictionary of pairs of trie nodes.

Words are sorted, and one pass over each sorted range numbers the nodes of their trie: a word shares the nodes of as many
leading characters as it shares with the word before it and gets new numbers for the rest. The trie of the reversed words
is numbered alike. What one range shares with the end of the range before it is a prefix of its first word, so a table with
one row per range (``carried``) makes the numbers agree across ranges.

A word of length L has the node P(i) of its first i characters and the node S(i) of those from i on. Two words differ by a
replaced character exactly if they share (P(i), S(i + 1)) for some i, and a word has one character more than another exactly if
its (P(i), S(i + 1)) is the other's (P(i), S(i)). So every word is entered under its pairs with position i skipped and under
its pairs with nothing skipped, and equal pairs of two integers are exact neighbours. The words that a pair skips a
character of differ in that character alone, so there are at most as many as there are letters (90), and one word at most
has the pair with nothing skipped: the group of a pair is bounded by the alphabet, however large the vocabulary is.
Two words meet by replacement under one pair only. Skipping any of several equal neighbouring letters gives the same word, so only the
last of them counts as a deletion, and no neighbour is counted twice. A group counts its members and keeps its two best; pairs of
words are never listed.

Defined cases: a null text has no words, a null doc_id counts as no text before the colon of the hashed string. Repeated rows count as
often as they occur. A run may be as long as its text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from caselane.session import written

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3  # code points of a word, occurrences
ONE_IN = 97  # runs of which one loses a code point
TIMES = 2  # a form occurs at least so many times as often as its variant
RANGE_BITS = 40  # of a node number, below those of its range
PLACE_BITS = 33  # of a word number, below those of its range
CHUNK = 1 << 10  # words that are Python objects at a time


def ascii_lower(run: Column) -> Column:
    """A-Z in lower case and no other letter; the general way only where a letter is not ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, upper, upper.lower()))


def thinned(row_id: Column, run: Column) -> Column:
    """The run, or where its hash says so the run without one code point."""
    key = F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), run)
    hashed = F.crc32(key.cast("binary"))
    at = F.pmod(hashed, F.length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(hashed % ONE_IN == 0, less).otherwise(run)


def count_words(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words long and frequent enough, written down."""
    runs = docs.select(F.col(row_id).alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    long = runs.filter(F.length("run") >= LEAST_LENGTH).select("doc_id", ascii_lower(F.col("run")).alias("run"))
    words = long.select(thinned(F.col("doc_id"), F.col("run")).alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return written(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT), "words")


def shared(a: str, b: str) -> int:
    """How many leading characters two words share."""
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def number_nodes(words: DataFrame, key: str) -> DataFrame:
    """word, key, range, place (both of the sorted order of ``key``) and nodes (one per character of ``key``), written down.

    Node numbers hold for the range alone; :func:`agreed` makes them agree.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        last, path, fresh, place = "", [], number << RANGE_BITS, 0
        for batch in batches:
            keys = batch.column(1)
            for at in range(0, len(keys), CHUNK):
                slots, found = keys.slice(at, CHUNK).to_pylist(), []
                for word in slots:
                    same = shared(last, word)
                    path = path[:same] + list(range(fresh + 1, fresh + 1 + len(word) - same))
                    fresh += len(word) - same
                    last = word
                    found.append(path)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, CHUNK), keys.slice(at, CHUNK), pa.array([number] * len(slots), pa.int64()),
                     pa.array(range(place, place + len(slots)), pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                    ["word", "key", "range", "place", "nodes"])
                place += len(slots)

    ordered = words.select("word", F.col(key).alias("key")).repartitionByRange("key").sortWithinPartitions("key")
    return written(ordered.mapInArrow(scan, "word string, key string, range long, place long, nodes array<long>"), "nodes")


def carried(numbered: DataFrame) -> DataFrame:
    """range, path: the nodes that the first word of a range shares with the last word of the range before it.

    Two words of each range reach the driver, so as many as there are shuffle partitions. The path of a range's last word may
    begin with what that range itself takes over, so the ranges are gone through in order.
    """
    spark = numbered.sparkSession
    word = F.struct("key", "nodes")
    ends = numbered.groupBy("range").agg(F.min_by(word, "place").alias("first"), F.max_by(word, "place").alias("last")).orderBy("range")
    last, path, rows = "", [], []
    for row in ends.collect():  # two words for each shuffle partition
        taken = path[:shared(last, row.first["key"])]
        if taken:
            rows.append((row["range"], taken))
        own = row.last["nodes"]
        inner = shared(row.first["key"], row.last["key"])
        last, path = row.last["key"], taken[:inner] + own[min(len(taken), inner):]
    return written(spark.createDataFrame(rows, "range long, path array<long>"), "carried")


def agreed(numbered: DataFrame) -> DataFrame:
    """word, place_id (in the order of the keys) and nodes that agree across ranges."""
    first = F.col("range") * (1 << RANGE_BITS)
    # the first word of a range has the numbers 1, 2, ... of its range, so a node's number tells whether it is on that word's path
    node = F.transform("nodes", lambda x, k: F.when((k < F.size("path")) & (x == first + k + 1), F.get("path", k)).otherwise(x))
    return numbered.join(carried(numbered), "range", "left").select(
        "word", F.shiftleft("range", PLACE_BITS).bitwiseOR(F.col("place")).alias("id"),
        F.when(F.col("path").isNull(), F.col("nodes")).otherwise(node).alias("nodes"))


def entries(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, word, n of every word, and p, s, id, n, skips and last: every word under its pairs of nodes.

    ``id`` follows the order of the words. ``last`` tells of a skipped character that the next one is another.
    """
    forward = agreed(number_nodes(words, "word")).select("word", "id", F.col("nodes").alias("ahead"))
    backward = agreed(number_nodes(words.withColumn("reversed", F.reverse("word")), "reversed")).select(
        F.col("word").alias("_word"), F.reverse("nodes").alias("behind"))
    both = written(words.join(forward, "word").join(backward, F.col("word") == F.col("_word")).drop("_word"), "paths")
    root = F.array(F.lit(0).cast("long"))
    size = F.length("word")
    letters = F.split("word", "")
    p, s = F.concat(root, "ahead"), F.concat("behind", root)  # p[i]: the first i characters; s[i]: those from i on
    last = F.transform(letters, lambda c, k: (k == size - 1) | (F.get(letters, k + 1) != c))
    taken = both.select("id", "n", size.alias("size"), p.alias("p"), s.alias("s"), last.alias("last"))
    skips = F.transform(F.slice("p", F.lit(1), F.col("size")), lambda x, k: F.struct(
        x.alias("p"), F.get("s", k + 1).alias("s"), F.lit(True).alias("skips"), F.get("last", k).alias("last")))
    whole = F.transform("p", lambda x, k: F.struct(x.alias("p"), F.get("s", k).alias("s"), F.lit(False).alias("skips"), F.lit(False).alias("last")))
    return both.select("id", "word", "n"), taken.select("id", "n", F.inline(F.concat(skips, whole)))


def neighbors(under: DataFrame) -> DataFrame:
    """id, n_near and best (n, minus id of the near word of largest n) of every word that has a near one."""
    member = F.struct("n", (-F.col("id")).alias("minus"), "skips", "last")  # the largest comes first when sorted downwards
    groups = (under.groupBy("p", "s").agg(F.sort_array(F.collect_list(member), asc=False).alias("members"))  # 91 at most
              .filter(F.size("members") > 1))
    skipping = F.filter("members", lambda m: m["skips"])
    deleted = F.filter("members", lambda m: m["skips"] & m["last"])
    whole = F.filter("members", lambda m: ~m["skips"])
    parts = groups.select("members", skipping.alias("skipping"), deleted.alias("deleted"), whole.alias("whole"))

    def seen(m: Column) -> Column:
        """What a member meets: those that skip the same place, and the word that has one character less or more."""
        others = F.when(F.get("skipping", F.lit(0))["minus"] == m["minus"], F.get("skipping", F.lit(1))).otherwise(F.get("skipping", F.lit(0)))
        shorter = F.when(m["last"], F.get("whole", F.lit(0)))
        return F.when(m["skips"], F.struct(
            m["minus"].alias("minus"), (F.size("skipping") - 1 + F.when(m["last"], F.size("whole")).otherwise(0)).cast("long").alias("met"),
            F.array_max(F.array(rank(others), rank(shorter))).alias("best"))
        ).otherwise(F.struct(m["minus"].alias("minus"), F.size("deleted").cast("long").alias("met"), rank(F.get("deleted", F.lit(0))).alias("best")))

    met = parts.select(F.inline(F.transform("members", seen))).filter("met > 0")
    return met.groupBy((-F.col("minus")).alias("id")).agg(F.sum("met").alias("n_near"), F.max("best").alias("best"))


def rank(m: Column) -> Column:
    return F.when(m.isNotNull(), F.struct(m["n"].alias("n"), m["minus"].alias("minus")))


def roots(forms: DataFrame) -> DataFrame:
    """id, root: the end of each word's chain of forms. Counts at least double along a chain, so a few jumps reach it."""
    reached = written(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        above = reached.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        jumped = written(reached.join(above, F.col("root") == F.col("_id"), "left")
                         .select("id", F.coalesce("_root", "root").alias("root"), F.col("_id").isNotNull().alias("moved")), "roots")
        reached = jumped.select("id", "root")
        if jumped.filter("moved").isEmpty():
            return reached


def group(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of a (word, n) table."""
    named, under = entries(words)
    found = written(neighbors(under), "neighbors")
    known = written(named.join(found, "id", "left"), "known")
    forms = written(known.filter(F.col("best.n") >= TIMES * F.col("n"))
                    .select("id", (-F.col("best.minus")).alias("form"), F.col("best.n").alias("form_n")), "forms")
    chains = forms.join(roots(forms), "id")
    names = named.select(F.col("id").alias("_id"), F.col("word").alias("_word"))
    spelled = (chains.join(names, F.col("form") == F.col("_id")).select("id", F.col("_word").alias("form"), "form_n", "root")
               .join(names, F.col("root") == F.col("_id")).select("id", "form", "form_n", F.col("_word").alias("root")))
    return known.join(spelled, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def report(docs: DataFrame) -> DataFrame:
    return group(count_words(docs))
