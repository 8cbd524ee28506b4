"""Secret scan: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The patterns give the base spans. Two first-order Markov chains over characters are then trained from labelled samples,
random strings and identifiers. What lies outside the base spans is cut at every character that keys are glued on with
(``= / . -`` and all others that are no letter, digit, ``+`` or ``_``); each part of ``SHORTEST`` or more characters is scored by its
log-likelihood ratio and is a secret too if the mean per transition reaches a threshold and the sum reaches the evidence
that ``SURE`` characters at the threshold would give, so a short part needs a higher mean. Digits alone are a number. The models become one table of
ratios per character pair (bounded by the alphabet), which is a literal of the scan. All of it is built-in expressions over
whole texts; nothing is shuffled but pair counts. Positions are running sums in two levels, so their cost grows with the matches
of a text, not with their square.

Defined cases: a null text is empty and has no spans. Positions are code points, ends exclusive. A span runs over the
whole match of its pattern. A secret that holds ``/`` is found by those of its parts that are long enough. Without a
labelled example of both kinds nothing is added to the base spans. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, functions as F

# The base kinds in their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

SHORTEST = 12  # characters of a part that is scored
CANDIDATE = rf"[A-Za-z0-9+_]{{{SHORTEST},}}"
# names and numbers as people write them; a random key, which has digits among letters or both cases mixed, is no example
IDENTIFIER = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]{6})(?:[A-Za-z][a-z]+(?:_[a-z]+)*|[A-Z]+(?:_[A-Z]+)*|[0-9]+)(?![A-Za-z0-9_])"
FIRST, WIDTH = ord("+"), ord("z") - ord("+") + 1  # the characters of a candidate lie in this range
SMOOTHING, BACK_OFF = 0.5, 5.0  # added to each character's count; weight of single characters against pairs
THRESHOLD = 0.7  # mean log-likelihood ratio per transition
SURE = 20  # characters for which the mean alone decides
BLOCK = 512  # matches whose positions are summed up together
SAMPLE_DOCUMENTS = 5000  # from which identifiers are learned at most


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, pattern: str, kind: str, good: Callable[[Column], Column] | None = None, values: Column | None = None) -> Column:
    """start, rank, end of the leftmost non-overlapping matches that are ``good`` (judged by ``values`` where given)."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")

    def measured(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        sizes = F.zip_with(between, found, lambda b, m: F.struct(F.char_length(b).alias("gap"), F.char_length(m).alias("size")))
        if good is None:
            return F.transform(sizes, lambda m: F.struct(m["gap"].alias("gap"), m["size"].alias("size"), F.lit(True).alias("good")))
        return F.zip_with(sizes, found if values is None else values, lambda m, v: F.struct(
            m["gap"].alias("gap"), m["size"].alias("size"), good(v).alias("good")))

    def located(block: Column, at: Column) -> Column:
        return F.aggregate(
            block, F.struct(at.alias("at"), none.alias("out")),
            lambda acc, m: F.struct(
                (acc["at"] + m["gap"] + m["size"]).alias("at"),
                F.when(m["good"], F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + m["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (acc["at"] + m["gap"] + m["size"]).alias("end")))))
                .otherwise(acc["out"]).alias("out")),
            lambda acc: acc["out"])

    def in_blocks(matches: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")),
                             lambda k: F.slice(matches, k * BLOCK + 1, F.lit(BLOCK)))
        return bound(blocks, lambda parts: F.flatten(F.zip_with(parts, offsets(parts), located)))

    def offsets(parts: Column) -> Column:
        """Where each block starts: one number a block."""
        lengths = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda acc, m: acc + m["gap"] + m["size"]))
        return F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
                           lambda acc: F.slice(acc, F.lit(1), F.size(acc) - 1))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    walked = bound(bound(found, measured), lambda m: F.when(F.size(m) <= BLOCK, located(m, F.lit(0))).otherwise(in_blocks(m)))
    return F.when(text.rlike(pattern), walked).otherwise(none)


def long_runs(pattern: str, least: int) -> str:
    """A run that is too short is used up whole, so only runs that are long enough need to be looked for."""
    prefix = pattern[: pattern.index("[")]
    return f"{prefix}{pattern[len(prefix):-1]}{{{least - len(prefix)},}}"


def base_spans(text: Column) -> dict[str, Column]:
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return {"assign": spans(text, ASSIGN, "assign", lambda v: F.char_length(v) >= LEAST["assign"], value),
            "access": spans(text, long_runs(ACCESS, LEAST["access"]), "access"),
            "hex": spans(text, long_runs(HEX, LEAST["hex"]), "hex")}


def base_values(text: Column) -> Column:
    """The strings that the base patterns find: labelled examples of random strings."""
    none = F.array().cast("array<string>")
    assigned = F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= LEAST["assign"])
    found = [F.when(text.rlike(ASSIGN), assigned).otherwise(none)]
    found += [F.when(text.rlike(p), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none)
              for p in (long_runs(ACCESS, LEAST["access"]), long_runs(HEX, LEAST["hex"]))]
    return F.concat(*found)


def letters(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit("."), F.lit(0)), lambda c: F.ascii(c) - FIRST)


def train(samples: DataFrame) -> list[float] | None:
    """Log ratios, random over ordinary, per character pair, from (value string, random boolean); None without both kinds.

    The result has at most WIDTH² numbers, whatever the number of samples.
    """
    codes = letters(F.regexp_replace("value", r"[^A-Za-z0-9+/_.=-]", "_"))
    pairs = F.when(F.size("codes") > 1, F.zip_with(
        F.slice("codes", F.lit(1), F.size("codes") - 1), F.slice("codes", F.lit(2), F.size("codes") - 1), lambda a, b: a * WIDTH + b))
    counted = (samples.select("random", codes.alias("codes")).select("random", F.explode(pairs).alias("pair"))
               .groupBy("random", "pair").count().collect())
    seen = {True: {}, False: {}}
    for row in counted:
        seen[row["random"]][row["pair"]] = row["count"]
    if not seen[True] or not seen[False]:
        return None
    single = {kind: [SMOOTHING] * WIDTH for kind in seen}  # how often a character follows any other
    before = {kind: [0] * WIDTH for kind in seen}
    for kind, counts in seen.items():
        for pair, n in counts.items():
            before[kind][pair // WIDTH] += n
            single[kind][pair % WIDTH] += n
    total = {kind: sum(counts) for kind, counts in single.items()}

    def chance(kind: bool, pair: int) -> float:
        first, second = divmod(pair, WIDTH)
        return (seen[kind].get(pair, 0) + BACK_OFF * single[kind][second] / total[kind]) / (before[kind][first] + BACK_OFF)

    return [round(log(chance(True, p)) - log(chance(False, p)), 4) for p in range(WIDTH * WIDTH)]


def labelled(docs: DataFrame, text: str = "text", most: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Random strings: what the base patterns find in all documents. Identifiers: the words, outside of these, of at most
    ``most`` different documents, those first in hash order, joined by underscores, in capitals and in camel case, as names are
    spelled; words with digits or mixed case are left out, so that unlabelled keys are not learned as ordinary. The order is
    found on hashes alone, so that no text is moved but those taken."""
    body = F.coalesce(F.col(text), F.lit(""))
    secrets = docs.select(F.explode(base_values(body)).alias("value"), F.lit(True).alias("random"))
    hashed = docs.select(F.xxhash64(body).alias("h"), body.alias("body"))
    last = hashed.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    taken = hashed.filter(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("body").alias("body"))
    rest = F.regexp_replace(F.regexp_replace("body", ASSIGN, " "), long_runs(HEX, LEAST["hex"]), " ")
    words = taken.select(F.explode(F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0))).alias("word"))
    joined = F.concat_ws("_", "word", "word")
    spelled = words.select(F.explode(F.array(joined, F.upper(joined), F.repeat(F.initcap("word"), F.lit(2)))).alias("value"), F.lit(False).alias("random"))
    return secrets.unionByName(spelled)


def masked(text: Column) -> Column:
    """The text with blanks in place of what the base patterns take, position by position."""
    taken = "|".join((ASSIGN[:-2] + f"{{{LEAST['assign']},}})", long_runs(ACCESS, LEAST["access"]), long_runs(HEX, LEAST["hex"])))
    blanks = F.transform(F.regexp_extract_all(text, F.lit(taken), F.lit(0)), lambda m: F.repeat(F.lit(" "), F.char_length(m)))
    pieces = F.zip_with(F.split(text, taken, -1), blanks, lambda b, gap: F.concat(b, F.coalesce(gap, F.lit(""))))
    return F.when(text.rlike(taken), F.array_join(pieces, "")).otherwise(text)


def markov_spans(text: Column, ratios: list[float] | None, threshold: float = THRESHOLD) -> Column:
    """Spans of the parts whose log ratio reaches the threshold on average and the evidence that it takes in sum."""
    if ratios is None:
        return F.array().cast("array<struct<start:int,rank:int,end:int>>")
    table = F.expr("array(" + ",".join(f"{r}D" for r in ratios) + ")")

    def secret(value: Column) -> Column:
        def evidence(codes: Column) -> Column:
            return F.aggregate(
                codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
                lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, F.lit(0.0)).otherwise(
                    F.get(table, acc["last"] * WIDTH + c))).alias("sum")),
                lambda acc: acc["sum"])

        return value.rlike("[A-Za-z]") & (bound(letters(value), evidence) >= threshold * (F.greatest(F.char_length(value), F.lit(SURE)) - 1))

    return spans(text, CANDIDATE, "markov", secret)


def scan(docs: DataFrame, ratios: list[float] | None, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base spans of each kind and all spans, as arrays of (start, rank of the kind, end)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(row_id).alias("doc_id"), body.alias("body"))
    based = rows.select("doc_id", masked(F.col("body")).alias("rest"), *[c.alias(k) for k, c in base_spans(F.col("body")).items()])
    added = based.select("doc_id", "assign", "access", "hex", F.concat("assign", "access", "hex").alias("base"),
                         markov_spans(F.col("rest"), ratios).alias("markov"))
    fresh = F.filter("markov", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return added.select("doc_id", "assign", "access", "hex", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", fresh)).alias("spans"))


def listed(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs, train(labelled(docs)))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
