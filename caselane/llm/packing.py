"""Best-fit packing of token sequences with a bounded number of open bins.

Each task tokenizes its documents and packs their pieces online: open bins are kept in a bitset keyed by free space, a
piece goes to the fullest bin that still holds it, and when all open bins are taken the fullest closes first. What a task
leaves less than nine tenths full is then dealt out again, whole bins as pieces, largest first, to as few tasks as their
number asks for; the same rule packs them together. So the loss does not grow with the number of tasks.

Tokens are found per white-space separated word, each distinct word once per Python worker while it is remembered; the
tokenizer has no token across white space, so this gives the ids of the whole text. The strings of its added tokens are
taken out first, wherever they stand.

Training data comes from ``keep_ids``: sequences are the pieces of a sequence_id put together by offset, and the copies of
a document that is packed several times differ in ``doc_row``.

Defined cases: a null or empty text is the end token alone. Repeated rows are packed as rows of their own. An empty table
gives an empty result. Only documents longer than a sequence are cut.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from caselane.llm.rows import objects
from caselane.session import written

LIMIT = 2048  # tokens of a sequence
OPEN = 1024  # bins that a task keeps open
END = 0  # id after each document
FULL = 0.9  # share from which on a bin is left as it is
UNITS = 50_000  # bins that a task of the second round takes
WORDS, PARTS = 250_000, 400_000  # words and parts of words that a worker remembers

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long"


class OpenBins:
    """Online best fit; ``place`` returns the bin of a piece and its offset there."""

    def __init__(self, limit: int, most: int, first: int):
        self.limit, self.most, self.next = limit, most, first
        self.bits, self.open, self.by_free = 0, 0, {}

    def take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        return found

    def place(self, size: int) -> tuple[int, int]:
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            found = self.take(free)
        else:
            if self.open == self.most:
                self.take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            free, found = self.limit, self.next
            self.next += 1
            self.open += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(found)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return found, self.limit - free


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit numbers, remembered up to a bound."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.added = {t.content: number for number, t in self.whole.get_added_tokens_decoder().items()}
        # the tokenizer takes these strings out of the text as it is, before anything else
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.part, self.parts, self.letters = self.whole.model.tokenize, {}, byte_letters()
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        # letters whose lower case and normal form depend on nothing else; other words go to the tokenizer as they are
        self.odd = re.compile("[^\x00-\x1b\x20-įı-ɏ]").search

    def __missing__(self, word: str) -> bytes:
        if self.odd(word):
            found = np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            low = word.lower()
            found = b"".join(map(self.of_part, [low] if low.isalpha() else self.cut(low)))
        if len(self) >= WORDS:
            self.clear()
        self[word] = found
        return found

    def of_part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            spelled = part.encode().decode("latin-1").translate(self.letters)
            found = np.array([t.id for t in self.part(spelled)], "<u4").tobytes()
            if len(self.parts) >= PARTS:
                self.parts.clear()
            self.parts[part] = found
        return found

    def ids(self, text: str | None) -> bytes:
        """The ids of a text followed by the end token."""
        text = text or ""
        if self.apart and any(t in text for t in self.added):
            found = [self.added[part].to_bytes(4, "little") if part in self.added else self.of_text(part) for part in self.apart(text)]
        else:
            found = [self.of_text(text)]
        return b"".join(found) + END.to_bytes(4, "little")

    def of_text(self, text: str) -> bytes:
        words = re.split("[ \t\n\r]+", text) if re.search("[\x1c-\x1f]", text) else text.split()
        return b"".join(map(self.__getitem__, words))


def words(path: str | None) -> Words:
    """This worker's memory of words, kept from task to task."""
    store = sys.modules.setdefault("caselane_worker_store", types.ModuleType("caselane_worker_store")).__dict__
    if path not in store:
        import public_tokenizers

        store[path] = Words(path or public_tokenizers.path("word_bpe_49k.json"))
    return store[path]


def pieces(docs: DataFrame, row_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
           limit: int = LIMIT, most: int = OPEN, keep_ids: bool = False) -> DataFrame:
    """One row per piece with its bin and place after the first round.

    With ``keep_ids`` also ``doc_row``, a number of the input row that tells rows of one id apart, and the ``ids``.
    """
    schema = PIECES + (", doc_row long, ids array<int>" if keep_ids else "")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        bins, known, row = OpenBins(limit, most, first), words(vocabulary), first - 1
        for batch in batches:
            rows, kept, numbers = [], [], []
            for ident, body in zip(batch.column(0).to_pylist(), objects(batch.column(1))):
                ids = known.ids(body)
                row += 1
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at:at + 4 * limit]
                    rows.append((ident, k, at // 4, len(part) // 4, zlib.crc32(part), *bins.place(len(part) // 4)))
                    if keep_ids:
                        kept.append(np.frombuffer(part, "<u4").astype("i4"))
                        numbers.append(row)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place"]
            if keep_ids:
                columns += [pa.array(numbers, pa.int64()), pa.array(kept, pa.list_(pa.int32()))]
                names += ["doc_row", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(row_id).cast("long"), F.col(text)).mapInArrow(pack, schema)


def together(bins: DataFrame, limit: int, most: int) -> DataFrame:
    """bin, fill -> bin, sequence_id, base: partly filled bins put together by the same rule, largest first."""
    count = bins.count()
    tasks = -(-count // UNITS) or 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = OpenBins(limit, most, (1 << 62) + (TaskContext.get().partitionId() << 32))
        for batch in batches:
            found = [to.place(size) for size in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([b for b, _ in found], pa.int64()), pa.array([o for _, o in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["bin", "sequence_id", "base"])

    dealt = bins.repartition(tasks, "bin").sortWithinPartitions(F.desc("fill"), "bin")
    return dealt.mapInArrow(pack, "bin long, sequence_id long, base long")


def pack(docs: DataFrame, row_id: str = "doc_id", text: str = "text", vocabulary: str | None = None,
         limit: int = LIMIT, most: int = OPEN, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (with ``keep_ids`` also doc_row and ids) of every piece."""
    first = written(pieces(docs, row_id, text, vocabulary, limit, most, keep_ids), "pieces")
    fills = first.groupBy("bin").agg(F.sum("length").alias("fill"))
    loose = written(fills.filter(F.col("fill") < FULL * limit), "loose")
    moved = written(together(loose, limit, most), "moved")
    out = first.join(moved, "bin", "left").withColumn("offset", F.col("place") + F.coalesce("base", F.lit(0))).withColumn(
        "sequence_id", F.coalesce("sequence_id", "bin"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["doc_row", "ids"] * keep_ids)
