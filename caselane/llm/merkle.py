"""Document fingerprints as Merkle trees over sections, paragraphs and pieces.

A text is a sequence of sections (runs of at most eight lines, or up to a blank line), a section one of paragraphs (lines),
a paragraph one of pieces (at most eight words). A leaf is the SHA-256 of a piece, a node the SHA-256 of its children, so
equal texts have equal roots, and where roots differ the branches that differ show where. The cuts cover every character.

The fingerprint string is the root followed by the first eight digits of each leaf, commas between pieces, semicolons
between paragraphs and bars between sections: all upper nodes follow from the leaves, so it is enough to compare two
documents. Likeness is 1 for equal roots, else twice the shared distinct leaves over all distinct leaves.

The neighbour of a document in id order comes from a range-partitioned table of ids, of which one row crosses each border.
A document's text is then shuffled by its own id and, of the next document, as many characters as the edit takes.

Defined cases: a null text is an empty one; an empty text has no leaf, and two of them are alike. Nulls come first in id
order. Rows that repeat id and text count as one document and get the same values; rows of one id with different texts
follow each other in the order of a hash of the text. A table of one document is its own next. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caselane.operators.ordered import neighbors
from caselane.session import written

SPACE = r"\x20\x09-\x0D"
SECTION = r"(?:[^\n]++\n?+){1,8}+\n*+|\n++"
PARAGRAPH = r"[^\n]*+\n++|[^\n]++"
PIECE = rf"(?:[^{SPACE}]++[\x20\x09\x0B-\x0D]*+){{1,8}}+\n*+|[{SPACE}]++"
TAG = 8  # digits of a leaf in the fingerprint


def cut(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tree(text: Column) -> Column:
    """Sections of paragraphs of leaf hashes."""
    return F.transform(cut(text, SECTION), lambda s: F.transform(
        cut(s, PARAGRAPH), lambda p: F.transform(cut(p, PIECE), lambda x: F.sha2(x.cast("binary"), 256))))


def node(children: Column) -> Column:
    return F.sha2(F.array_join(children, ",").cast("binary"), 256)


def fingerprint(hashes: Column) -> Column:
    root = node(F.transform(hashes, lambda s: node(F.transform(s, node))))
    tags = F.array_join(F.transform(hashes, lambda s: F.array_join(F.transform(s, lambda p: F.array_join(
        F.transform(p, lambda x: F.substring(x, 1, TAG)), ",")), ";")), "|")
    return F.concat(root, F.lit(":"), tags)


def leaves(print_: Column) -> Column:
    return F.array_distinct(F.split(F.substring_index(print_, ":", -1), "[,;|]"))


def likeness(a: Column, b: Column) -> Column:
    """From two fingerprints, 0 to 1."""
    x, y = leaves(a), leaves(b)
    shared = 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).otherwise(shared)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Every row with its fingerprint; a column of that name is replaced."""
    plain = [c for c in docs.columns if c not in (name, "_tree")]
    made = docs.select(*plain, tree(F.coalesce(F.col(text), F.lit(""))).alias("_tree"))
    return made.select(*plain, fingerprint(F.col("_tree")).alias(name))


def differing(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the paragraphs of fingerprint ``a`` that are not in ``b``: where an edit is."""
    def paragraphs(p):
        return F.split(F.substring_index(p, ":", -1), "[;|]")

    here, there = paragraphs(a), paragraphs(b)
    return F.filter(F.sequence(F.lit(0), F.size(here) - 1), lambda k: ~F.array_contains(there, here[k]))


def edited_pairs(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its fingerprint, its edited text's hash and fingerprint, and its likeness to both."""
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(row_id).alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("body"))
    narrow = texts.select("doc_id", "mark", F.char_length("body").alias("n")).distinct()
    linked = neighbors(narrow, [], ["doc_id", "mark"], ["doc_id", "mark", "n"])
    linked = written(linked.select("doc_id", "mark", "prev_doc_id", "prev_mark", "prev_n",
                                   F.col("prev_n").isNull().alias("is_first")), "neighbours")
    last = linked.join(linked.select(F.col("prev_doc_id").alias("d"), F.col("prev_mark").alias("m")),
                       F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left_anti")
    end = narrow.join(last.select(F.col("doc_id").alias("d"), F.col("mark").alias("m")),
                      F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left_semi").first()  # one row
    if end is not None:
        wrapped = {"prev_doc_id": F.lit(end.doc_id).cast("long"), "prev_mark": F.lit(end.mark), "prev_n": F.lit(end.n)}
        linked = linked.withColumns({c: F.when(F.col("is_first"), v).otherwise(F.col(c)) for c, v in wrapped.items()})

    def key(ident: str, mark: str) -> Column:  # ids may be null, so that the join key is one that never is
        return F.struct(F.col(ident).isNull().alias("nil"), F.coalesce(F.col(ident), F.lit(0)).alias("id"), F.col(mark).alias("mark"))

    keyed = texts.select(key("doc_id", "mark").alias("key"), "body")  # shuffled once; both joins read the same exchange
    before = linked.select(key("doc_id", "mark").alias("key"), key("prev_doc_id", "prev_mark").alias("before"), F.col("prev_n"))
    printed = fingerprints(keyed.join(before, "key").select(
        "before", F.expr("left(body, CAST(prev_n DIV 4 AS INT))").alias("head"), "body"), "body", "next_print")
    heads = (printed.groupBy("before").agg(F.first(F.struct("head", "next_print")).alias("next"))  # repeated rows count once
             .select(F.col("before").alias("key"), "next.head", "next.next_print"))
    joined = fingerprints(keyed.join(heads, "key").select(
        F.when(~F.col("key.nil"), F.col("key.id")).alias("doc_id"), F.char_length("body").cast("long").alias("n_chars"), "body", "next_print",
        F.concat(F.expr("left(body, CAST(char_length(body) - char_length(body) DIV 4 AS INT))"),
                 F.expr("left(head, CAST(char_length(body) DIV 4 AS INT))")).alias("edited")), "body")
    both = fingerprints(joined, "edited", "edited_fingerprint")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"))


def report(docs: DataFrame) -> DataFrame:
    return edited_pairs(docs)


def tree_sql(text: str) -> str:
    plain = [p.replace("++", "+").replace("?+", "?").replace("*+", "*").replace("}+", "}") for p in (SECTION, PARAGRAPH, PIECE)]
    section, paragraph, piece = plain  # the checking engine has no possessive repeats; these cuts never need to go back
    return f"""list_transform(regexp_extract_all({text}, '{section}'), lambda s: list_transform(regexp_extract_all(s, '{paragraph}'),
        lambda p: list_transform(regexp_extract_all(p, '{piece}'), lambda x: sha256(x))))"""


def print_sql(tree: str) -> str:
    return f"""sha256(array_to_string(list_transform({tree}, lambda s: sha256(array_to_string(list_transform(s,
        lambda p: sha256(array_to_string(p, ','))), ','))), ',')) || ':' || array_to_string(list_transform({tree}, lambda s:
        array_to_string(list_transform(s, lambda p: array_to_string(list_transform(p, lambda x: substr(x, 1, {TAG})), ',')), ';')), '|')"""


def likeness_sql(a: str, b: str) -> str:
    x, y = (f"list_distinct(string_split_regex(split_part({p}, ':', 2), '[,;|]'))" for p in (a, b))
    return f"""CASE WHEN split_part({a}, ':', 1) = split_part({b}, ':', 1) THEN 1.0
        ELSE 2 * len(list_intersect({x}, {y})) / CAST(len({x}) + len({y}) AS DOUBLE) END"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS u FROM d),
e AS (SELECT *, left(t, length(t) - length(t) // 4) || left(u, length(t) // 4) AS v FROM n),
trees AS (SELECT *, {tree_sql('t')} AS a, {tree_sql('u')} AS b, {tree_sql('v')} AS c FROM e),
prints AS (SELECT *, {print_sql('a')} AS p, {print_sql('b')} AS q, {print_sql('c')} AS r FROM trees)
SELECT doc_id, length(t) AS n_chars, sha256(v) AS edited_sha256, p AS fingerprint, r AS edited_fingerprint,
  CAST({likeness_sql('p', 'r')} AS DOUBLE) AS near_edited, CAST({likeness_sql('p', 'q')} AS DOUBLE) AS near_next FROM prints
"""
