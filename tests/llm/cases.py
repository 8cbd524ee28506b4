"""Small tables with the awkward rows, and helpers to compare."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use themselves
    T.StructField("size", T.StringType()), T.StructField("mark", T.StringType()), T.StructField("row", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("key", T.StringType()), T.StructField("code", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("score", T.StringType()), T.StructField("_mark", T.StringType()),
    T.StructField("_lang", T.StringType()), T.StructField("_row", T.StringType()), T.StructField("_key_id", T.StringType())])
EXTRA = ("s", "m", "r", "n", "k", "c", "b", "x", "_m", "_l", "_r", "_k")
LONG = " ".join(f"word{i % 977} of{i}" for i in range(30_000))
ENGLISH = "The quick brown fox jumps over the lazy dog and the cat sits there with that other thing."
GERMAN = "Der schnelle braune Fuchs springt über den faulen Hund und die Katze sitzt auch nicht weit davon."

ROWS = [
    (1, ENGLISH, "en", "a"), (2, ENGLISH.upper(), "en", "a"), (2, ENGLISH.upper(), "en", "a"), (3, None, None, None), (4, "", "en", "b"),
    (5, "   \n\t ", None, "b"), (6, GERMAN, "de", "é"), (7, GERMAN + " Ende.", "de", "a"), (8, LONG, "en", None),
    (9, LONG + "x", "en", "b"), (10, "12345 !!!", "de", "a"), (None, "no id here", "en", "b"), (11, "no id here", None, "b"),
    (12, "a", "en", "c"), (13, "token = \"0123456789abcdef0123456789abcdef\" 😀 end", "en", "c"), (13, "other text, same id", "en", "c")]


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in rows], DOCS)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, digest string")


def listing(df, *columns):
    return sorted((repr(tuple(r[c] for c in columns or df.columns)) for r in df.collect()))
