"""Targets, flags and text features, each a projection or one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caselane.functions import text as tx
from caselane.functions.scores import share
from caselane.functions.taxonomy import ESCALATION_INTENTS, FLAG_NAMES
from caselane.operators.ordered import broadcast_if_small
from caselane.operators.quantiles import EVERYTHING, exact_quantiles, join_groups
from caselane.session import written


def map_target(df: DataFrame, intents: tuple[str, ...] = ESCALATION_INTENTS, intent: str = "intent") -> DataFrame:
    return df.withColumn("escalated", F.coalesce(F.col(intent).isin(*intents), F.lit(False)).cast("int"))


def taxonomy_join(df: DataFrame, dimension: DataFrame, on: str = "intent") -> DataFrame:
    """Attach what the intent table says about each row; counted small, the table goes to the rows."""
    return df.join(broadcast_if_small(dimension), on)


def decompose_flags(df: DataFrame, names: dict[str, str] = FLAG_NAMES, flags: str = "flags") -> DataFrame:
    """One 0/1 column per tag letter."""
    text = F.coalesce(F.col(flags), F.lit(""))
    return df.select("*", *[F.contains(text, F.lit(k)).cast("int").alias(f"flag_{v}") for k, v in names.items()])


def unknown_flags(df: DataFrame, names: dict[str, str] = FLAG_NAMES, flags: str = "flags") -> DataFrame:
    """Letters outside the table of tags, with the rows that carry them."""
    letters = F.array_distinct(F.filter(F.split(F.coalesce(F.col(flags), F.lit("")), ""), lambda c: c != ""))
    return (
        df.select(F.explode(letters).alias("letter"))
        .filter(~F.col("letter").isin(*names))
        .groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    )


def text_lengths(df: DataFrame, text: str, suffix: str = "") -> DataFrame:
    c = F.col(text)
    return df.withColumns({f"char_len{suffix}": tx.char_len(c), f"word_len{suffix}": tx.word_len(c)})


def request_features(df: DataFrame, text: str = "instruction") -> DataFrame:
    """Everything the request table gains: target, twelve flags, two lengths and the slot count."""
    sized = text_lengths(decompose_flags(map_target(df)), text, f"_{text}")
    return sized.withColumn(f"entity_count_{text}", tx.slot_count(F.col(text)))


def slot_table(df: DataFrame, by: str, text: str) -> DataFrame:
    """How often each slot name occurs under each value of ``by``."""
    return (
        df.select(by, F.explode(tx.slot_names(F.col(text))).alias("slot"))
        .groupBy(by, "slot").agg(F.count(F.lit(1)).alias("n"))
    )


def token_profile(df: DataFrame, text: str, cap: int, tokenize=tx.pieces, by: tuple[str, ...] = ()) -> DataFrame:
    """Tokens per text, and the share of texts longer than ``cap``."""
    sizes = written(df.groupBy(*by, F.size(tokenize(F.col(text))).alias("_n")).agg(F.count(F.lit(1)).alias("_rows")), "sizes")
    of = lambda value: F.sum(value * F.col("_rows")) / F.sum("_rows")
    base = sizes.groupBy(*by).agg(
        F.sum("_rows").alias("n_texts"), of(F.col("_n")).alias("mean"), F.max("_n").alias("max"),
        of((F.col("_n") > cap).cast("double")).alias("share_over_cap")).withColumn(EVERYTHING, F.lit(0))
    q = exact_quantiles(sizes, by, "_n", (0.5, 0.99), "_rows", True).withColumn(EVERYTHING, F.lit(0))
    return join_groups(base, q, [*by, EVERYTHING]).select(
        *by, "n_texts", "mean", F.get("quantiles", F.lit(0)).alias("median"), F.get("quantiles", F.lit(1)).alias("p99"), "max", "share_over_cap")


def token_counts(df: DataFrame, text: str, tokenize=tx.pieces) -> DataFrame:
    return (
        df.select(F.explode(tokenize(F.col(text))).alias("token"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )


def oov_rate(df: DataFrame, vocabulary: DataFrame, text: str, tokenize=tx.pieces) -> DataFrame:
    """Tokens outside the vocabulary, per thousand.

    Tokens are counted before the join, so a word that makes up much of the text is one row.
    """
    counts = token_counts(df, text, tokenize)
    known = vocabulary.select("token", F.lit(True).alias("_known"))
    return counts.join(known, "token", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0)).alias("n_unknown"),
    ).withColumn("unknown_per_1k", share(F.col("n_unknown") * 1000, F.col("n_tokens")))


def truncate_tokens(df: DataFrame, text: str, n: int, tokenize=tx.pieces) -> DataFrame:
    """Keep the first ``n`` tokens of a text: the length budget of a scorer."""
    return df.withColumn("truncated", F.array_join(F.slice(tokenize(F.col(text)), 1, n), " "))


def noise_profile(df: DataFrame, text: str) -> DataFrame:
    """Counts of the marks that informal text carries."""
    c = F.col(text)
    return df.withColumns({
        "handles": tx.count_matches(c, tx.HANDLE),
        "urls": tx.count_matches(c, tx.URL),
        "emoji": tx.count_matches(c, tx.EMOJI),
        "entities": tx.count_matches(c, tx.HTML_ENTITY),
        "hashtags": tx.count_matches(c, tx.HASHTAG),
    })


def normalize_handles_urls(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("normalized", tx.normalize(F.col(text)))


def keyword_rule(df: DataFrame, text: str, patterns=tx.HUMAN_REQUEST) -> DataFrame:
    """Explicit requests for a person, decided ahead of any model."""
    return df.withColumn("rule_hit", tx.matches_any(F.col(text), patterns).cast("int"))


def case_folding_delta(df: DataFrame, text: str) -> DataFrame:
    """Vocabulary and tokens with case kept and with case folded."""
    cased = token_counts(df, text, lambda c: tx.pieces(c, lower=False))
    stats = cased.groupBy(F.lower("token").alias("_folded")).agg(
        F.count(F.lit(1)).alias("_forms"), F.sum("n").alias("_n")
    )
    return stats.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum("_forms"), F.lit(0)).alias("vocab_cased"),
        F.count(F.lit(1)).alias("vocab_folded"),
    ).withColumn("merged", F.col("vocab_cased") - F.col("vocab_folded"))
