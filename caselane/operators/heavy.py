"""The most frequent items of a corpus, exactly, without shuffling all that occur.

Each task keeps counts of a bounded number of items (``KEPT``). When it has met too many, the least of those beyond the bound is taken
off all counts and what is left of nothing is forgotten; the task's counts are then too low by no more than what it has taken
off in all. Summaries add up, and so do their errors, so an item can only be one of the ``size`` most frequent if its summed
count and error reach the ``size``-th largest sum. These candidates, and no others, are counted in a second pass. Where no task
forgot anything, the summaries are the counts. Where the error is too large to tell (a tail as heavy as its head), all items are counted
as they are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from caselane.operators.ordered import broadcast_if_small
from caselane.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEPT = 1 << 20  # items that a task keeps
LOOSE = 16  # candidates for each item sought, above which the error tells too little
ITEMS = 1 << 20  # items of a batch that are folded at a time


def lengths_of(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def slices(lists: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Where the rows of a batch are cut, so that no part but one of a single row has more than ``ITEMS`` items."""
    sizes, at = np.cumsum(lengths_of(lists)), 0
    while at < len(lists):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + ITEMS, "right")))
        yield at, upto
        at = upto


def coded(lists: pa.ListArray, pairs: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and code of every item, and the items by code; with ``pairs`` neighbours in a row, joined by a space, are items too."""
    words = lists.flatten().dictionary_encode()
    row, code, names = np.repeat(np.arange(len(lists)), lengths_of(lists)), words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    if pairs and len(code):
        width, beside = len(names), row[1:] == row[:-1]
        pair, place = np.unique((code[:-1] * width + code[1:])[beside], return_inverse=True)
        joined = pc.binary_join_element_wise(names.take(pa.array(pair // width)), names.take(pa.array(pair % width)), " ")
        row, code, names = np.append(row, row[1:][beside]), np.append(code, width + place), pa.concat_arrays([names, joined])
    return row, code, names


def row_counts(lists: pa.ListArray, pairs: bool = False) -> pa.Table:
    """term, n (occurrences) and df (rows it occurs in) of some rows of terms, or of words whose pairs are terms too."""
    row, code, names = coded(lists, pairs)
    width = max(1, len(names))
    found, times = np.unique(row * width + code, return_counts=True)
    term = found % width
    n, df = np.bincount(term, times, width).astype(np.int64), np.bincount(term, minlength=width).astype(np.int64)
    return pa.table({"term": names.cast(pa.string()), "n": n[:len(names)], "df": df[:len(names)]})


def items_of(taken: DataFrame) -> tuple[str, bool]:
    """The column of items: ``_words``, whose pairs are items too, or ``_terms``."""
    return ("_words", True) if "_words" in taken.columns else ("_terms", False)


def added(tables: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(tables).group_by("term").aggregate([("n", "sum"), ("df", "sum")])
    return pa.table({"term": summed["term"], "n": summed["n_sum"], "df": summed["df_sum"]})


def pruned(counts: pa.Table, kept: int) -> tuple[pa.Table, int]:
    """At most ``kept`` items, and what was taken off each count."""
    if len(counts) <= kept:
        return counts, 0
    n = counts["n"].to_numpy()
    off = int(np.partition(n, len(n) - kept - 1)[len(n) - kept - 1])
    left = counts.filter(pa.array(n > off))
    return left.set_column(1, "n", pc.subtract(left["n"], off)), off


def summaries(taken: DataFrame, kept: int) -> DataFrame:
    """term, n, df and off: a row per item that a task kept, and one without a term with what it took off."""
    column, pairs = items_of(taken)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, off = [], 0, 0

        def fold() -> int:
            nonlocal held, waiting
            counts, less = pruned(added(held), kept)
            held, waiting = [counts], 0
            return less

        for batch in batches:
            for at, upto in slices(batch.column(0)):
                held.append(row_counts(batch.column(0).slice(at, upto - at), pairs))
                waiting += len(held[-1])
                if waiting > 2 * kept:
                    off += fold()
        if held:
            off += fold()
            counts = held[0].combine_chunks()
            yield from pa.table({"term": counts["term"], "n": counts["n"], "df": counts["df"],
                                 "off": pa.nulls(len(counts), pa.int64())}).to_batches()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), *[pa.array([0], pa.int64())] * 2, pa.array([off], pa.int64())],
                                         ["term", "n", "df", "off"])

    return written(taken.select(column).mapInArrow(gather, "term string, n long, df long, off long"), "summaries")


def partial_counts(taken: DataFrame) -> DataFrame:
    """term, n and df, summed over some rows at a time."""
    column, pairs = items_of(taken)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, upto in slices(batch.column(0)):
                yield from row_counts(batch.column(0).slice(at, upto - at), pairs).combine_chunks().to_batches()

    return taken.select(column).mapInArrow(count, "term string, n long, df long")


def all_counts(taken: DataFrame) -> DataFrame:
    """term, n and df of every item."""
    return partial_counts(taken).groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def most_frequent(taken: DataFrame, size: int, kept: int = KEPT) -> DataFrame:
    """term, n and df of the ``size`` most frequent items of the rows of ``_terms`` or ``_words``, ties in item order."""
    found = summaries(taken, kept)
    slack = found.agg(F.sum("off").alias("off")).first().off or 0
    sums = found.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    if slack:
        sums = written(sums, "sums")
        top = sums.orderBy(F.desc("n")).limit(size).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("many")).first()
        able = sums.filter(F.col("n") + slack >= (top.least or 0)).select("term")
        tight = top.many == size and top.least > slack and able.limit(LOOSE * size + 1).count() <= LOOSE * size
        if tight:
            counted = partial_counts(taken).join(broadcast_if_small(able), "term", "left_semi")
            sums = counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        else:
            sums = all_counts(taken)
    return sums.orderBy(F.desc("n"), "term").limit(size)
