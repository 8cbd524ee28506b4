"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Document frequencies cover every training row. The classifier is fitted on a bounded sample, at most ``PER_LANGUAGE``
rows of each language in hash order (rows equal in id and text are one), by follow-the-regularised-leader with an elastic-net penalty; a fifth of the sample
is kept back to find the temperature that makes the probabilities honest. Prediction is one Arrow-batched pass over whole
texts; only the model (one row per n-gram bucket) is sent to the tasks.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if there is nothing to
learn from. With one language its score is 1. Rows with a null label are not learned from; a null doc_id counts as the
empty string in the held-out rule. An empty table gives an empty result. Columns named lang_pred and score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from caselane.llm.rows import objects
from caselane.operators.ordered import take_by_hash
from caselane.session import durable

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1000  # rows of each language that the classifier is fitted on at most
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.001, 0.0001  # learning rate and elastic-net penalties
UND = "und"


def letters() -> np.ndarray:
    """Which code points are letters."""
    known = letters.__dict__.get("table")
    if known is None:
        known = letters.table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return known


def grams(text: str | None, table: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and counts of the n-grams of letters, words apart by one space; None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = table[codes]
    if not is_letter.any():
        return None
    spaced = np.where(is_letter, codes, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one space after each word
    padded = np.concatenate(([np.uint32(32)], spaced[keep], [np.uint32(32)])).astype(np.uint32)
    found, rolling = [], np.zeros(len(padded), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        rolling = rolling[: len(padded) - order + 1] * np.uint32(0x01000193) + padded[order - 1:] + np.uint32(order)
        if order in ORDERS:
            found.append((rolling * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    where = np.flatnonzero(counts)
    return where, counts[where]


def weighed(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and unit-length TF-IDF values, with the constant feature last."""
    where, counts = found
    values = (1 + np.log(counts)) * idf[where]
    return np.append(where, BUCKETS), np.append(values / np.sqrt((values**2).sum()), 1.0)


def held_out(row_id: Column) -> Column:
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each bucket, and documents, over all rows of a one-column table."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, table = np.zeros(BUCKETS + 1, np.int64), letters()
        for batch in batches:
            for text in objects(batch.column(0)):
                if found := grams(text, table):
                    seen[found[0]] += 1
                    seen[BUCKETS] += 1
        where = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(seen[where])], ["bucket", "docs"])

    rows = texts.mapInArrow(count, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs")).collect()  # BUCKETS + 1 rows at most
    out = np.zeros(BUCKETS + 1, np.int64)
    for bucket, docs in rows:
        out[bucket] = docs
    return out[:BUCKETS], int(out[BUCKETS])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int,
                epochs: int = EPOCHS) -> np.ndarray:
    """Follow the regularised leader, proximal form, with per-coordinate rates and lazily solved weights."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def solved(z, n):
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            where, values = rows[k]
            zk, nk = z[where], n[where]
            w = solved(zk, nk)
            gap = softmax(values @ w)
            gap[labels[k]] -= 1
            g = values[:, None] * gap
            more = nk + g * g
            z[where] = zk + g - (np.sqrt(more) - np.sqrt(nk)) / ALPHA * w
            n[where] = more
    return solved(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search on its logarithm.

    As with Platt's targets the true class counts (n + 1) / (n + 2), so that a sample without errors gives no certainty.
    """
    rows, classes = logits.shape
    target = np.full((rows, classes), 1 / (rows + 2) / max(classes - 1, 1))
    target[np.arange(rows), labels] = (rows + 1) / (rows + 2)

    def loss(t):
        return -(target * np.log(softmax(logits / np.exp(t)) + 1e-300)).sum(axis=1).mean()

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, row_id: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = PER_LANGUAGE) -> dict | None:
    """The model: languages, idf, weights and temperature. Uses every row that ``docs`` has, so leave out held-out ones."""
    table = letters()
    rows = docs.select(F.col(row_id).alias("id"), F.col(text).alias("body"), F.col(lang).alias("label"))
    # an id that many rows share must not bring all of them: rows are drawn by id and text, and copies of both are one
    labelled = rows.filter("label IS NOT NULL AND body IS NOT NULL").select(F.xxhash64("id", "body").alias("id"), "body", "label")
    counts, total = document_frequencies(labelled.select("body"))
    if not total:
        return None
    idf = np.log((1 + total) / (1 + counts)) + 1
    quotas = durable(labelled.groupBy("label").agg(F.least(F.count(F.lit(1)), F.lit(per_language)).alias("quota")))
    sample = take_by_hash(labelled, ["label"], "id", "lang", quotas, "_taken").filter("_taken = 1").dropDuplicates(["label", "id"])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ident, body, label in zip(*(objects(batch.column(c)) for c in range(3))):
                if found := grams(body, table):
                    where, values = weighed(found, idf)
                    rows.append({"id": ident, "label": label, "buckets": where.astype("i4").tobytes(), "weights": values.astype("f4").tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("label", pa.string()), ("buckets", pa.binary()), ("weights", pa.binary())]))

    found = (sample.select("id", "body", "label")
             .mapInArrow(featured, "id long, label string, buckets binary, weights binary").orderBy("id", "buckets").collect())
    languages = sorted({r.label for r in found})
    place = {name: k for k, name in enumerate(languages)}
    rows = [(np.frombuffer(r.buckets, "i4"), np.frombuffer(r.weights, "f4").astype(float)) for r in found]
    labels = np.array([place[r.label] for r in found])
    back = np.random.default_rng(0).random(len(rows)) < 0.2
    weights = fit_weights([r for r, b in zip(rows, back) if not b], labels[~back], len(languages))
    heat = 1.0
    if back.any():
        heat = temperature(np.array([v @ weights[w] for (w, v), b in zip(rows, back) if b]), labels[back])
    return {"languages": languages, "idf": idf, "weights": weights.astype("f4"), "temperature": heat}


def predict_text(text: str | None, model: dict | None, table: np.ndarray) -> tuple[str, float]:
    found = grams(text, table) if model else None
    if found is None:
        return UND, 0.0
    where, values = weighed(found, model["idf"])
    chances = softmax(values @ model["weights"][where] / model["temperature"])
    best = int(chances.argmax())
    return model["languages"][best], float(chances[best])


def identify(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """Every row with lang_pred and score."""
    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = letters()
        for batch in batches:
            found = [predict_text(t, model, table) for t in objects(batch)]
            yield pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                                             names=["lang_pred", "score"])

    plain = F.struct(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    return docs.select(plain.alias("row"), predict(F.col(text)).alias("lang")).select("row.*", "lang.lang_pred", "lang.score")


def accept(docs: DataFrame, model: dict | None, least: float, text: str = "text") -> DataFrame:
    """The rows whose language is known with a score of ``least`` or more, with the input's columns."""
    lang = identify(docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("body")), model, "body")
    return lang.filter((F.col("lang_pred") != UND) & (F.col("score") >= least)).select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the rows that are not held out."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
