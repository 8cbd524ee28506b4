"""SimHash near-duplicates by a forest of vantage-point trees.

A fingerprint holds, bit by bit, the majority of the hashes of a document's word shingles. Only distinct fingerprints are
compared. A vantage-point tree partitions them by Hamming distance to vantage points: a node sends a fingerprint to the
near side, the far side, or, where the ball of the search radius crosses the border, to both; the leaves are the shards of
a shuffle, and within a shard pairs are settled exactly.

On 64 bits the distances to any vantage point lie within a few bits of 32, so with the whole fingerprint and radius 4 about
70 % of all rows would overlap every border. Therefore each tree looks at some bits only, its mask: of six bands that part
the 64 bits, four differing bits touch four at most, so the pair agrees in some two bands, and the 15 trees over pairs of
bands need radius 0 there. The triangle bound holds on masked bits as well, nothing is missed and nothing overlaps.

``dedup``, for a similarity bound, takes candidates from the same forest over other codes, a byte of each of 96 minhashes
of the set of shingles, so that neither repeats nor short texts count more or less than their sets. A mask is four bytes
and a pair at the bound of 0.8 shares one of 24 with more than 99.999 %. A loose bound on the distance gives groups, and
within a group texts are linked by the exact similarity of their sets alone.

Trees are built from a bounded sample of distinct fingerprints (``SAMPLE``) and every distinct fingerprint is routed. A
shard reports a spanning forest of its links, never all pairs of a group; components follow from contracting the
forest, with only counts reaching the driver.

Defined cases: a null text or one without words has fingerprint zero, which is linked like any other. Null ids count as
members and are smaller than no id: a component of null ids alone has a null component_id. Repeated rows share all
values. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from caselane.llm.rows import KEY_ID, KEY_MARK, objects, take_rows
from caselane.session import written

WORDS = 4  # of a shingle
BITS = 4  # that linked fingerprints differ in at most
SEED = 42
SAMPLE = 1 << 16  # fingerprints that the trees are built from at most
PER_LEAF = 128  # sampled fingerprints of a leaf at most
RATIO = 16  # fingerprints for each sampled one, below the bound
CHUNK = 1 << 12  # shingles whose bits are counted at a time
PART = 1 << 14  # rows that the part of a leaf holds on average
BLOCK = 1 << 13  # rows above which a part is cut into blocks, each pair of which is a shard of its own

NEAR_WORDS, NEAR_SIMILARITY, NEAR_LANES, NEAR_TREES = 5, 0.8, 12, 24  # eight minhashes a lane
LOOSER = 0.2  # how far below the bound the estimated similarity of candidates may lie: over four standard deviations
NEAR_BLOCK = 1 << 20  # shingles above which a group is cut into blocks, each pair of which is a shard of its own
LEAST_SIZE = 1 << 7  # shingles that a text counts for at least


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Unsigned XXH64 of each shingle of the text with A-Z in lower case, repeats included."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six ASCII spaces count
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.fromiter((xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, ends[words - 1:].tolist())), np.uint64, len(found) - words + 1)


def majority(hashes: np.ndarray) -> bytes:
    """The fingerprint: the bits that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at:at + CHUNK, None].view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def minhash(grams: np.ndarray, lanes: int) -> bytes:
    """The lowest byte of the least mixed hash, for each of eight mixings a lane; zeros without a shingle."""
    if not len(grams):
        return bytes(8 * lanes)
    keys = np.arange(1, 8 * lanes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    least = np.full(len(keys), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), CHUNK):
        mixed = (grams[at:at + CHUNK, None] ^ keys) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, mixed.min(axis=0))
    return ((least ^ (least >> np.uint64(32))) & np.uint64(255)).astype(np.uint8).tobytes()


def coded(docs: DataFrame, row_id: str, text: str, words: int) -> DataFrame:
    """doc_id, mark (a hash of the text) and code (the fingerprint, 8 bytes) of every row, written down."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(t, words)) for t in objects(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "mark", "code"])

    narrow = docs.select(F.col(row_id).cast("long").alias("doc_id"), text_mark(text).alias("mark"), F.col(text).alias("body"))
    return written(narrow.mapInArrow(code, "doc_id long, mark long, code binary"), "fingerprints")


def text_mark(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def band_masks(lanes: int = 1, bands: int = 6, joined: int = 2) -> np.ndarray:
    """Masks over every choice of ``joined`` of ``bands`` bands of all bits: exact for bands - joined differing bits."""
    band = np.arange(64 * lanes) * bands // (64 * lanes)
    rows = [np.packbits(np.isin(band, chosen), bitorder="little").view(np.uint64) for chosen in combinations(range(bands), joined)]
    return np.array(rows, np.uint64)


def byte_masks(lanes: int, trees: int) -> np.ndarray:
    """Masks that part the bytes of a code among the trees."""
    tree = np.repeat(np.arange(64 * lanes // 8) * trees // (64 * lanes // 8), 8)
    return np.array([np.packbits(tree == t, bitorder="little").view(np.uint64) for t in range(trees)], np.uint64)


def loose_bits(similarity: float, lanes: int) -> int:
    """Differing bits of two minhash codes, four for each minhash that differs, at a similarity below the given one."""
    return int(32 * lanes * (1 - similarity + LOOSER))


def distances(codes: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ point).sum(axis=-1, dtype=np.int64)


def build_tree(sample: np.ndarray, mask: np.ndarray, per_leaf: int = PER_LEAF) -> dict[str, np.ndarray]:
    """A vantage-point tree over masked fingerprints; a node without sides is a leaf."""
    points, radii, near, far = [], [], [], []
    waiting = [(sample & mask, None, None)]
    while waiting:
        codes, parent, side = waiting.pop()
        here = len(points)
        if parent is not None:
            side[parent] = here
        points.append(codes[0] if len(codes) else mask * np.uint64(0))
        radii.append(-1)
        near.append(-1)
        far.append(-1)
        if len(codes) <= per_leaf:
            continue
        d = distances(codes, points[-1])
        radius = min(int(np.median(d)), int(d.max()) - 1)
        if radius < 0:
            continue  # all alike on these bits
        radii[here] = radius
        waiting += [(codes[d > radius], here, far), (codes[d <= radius], here, near)]
    return {"points": np.array(points), "radii": np.array(radii), "near": np.array(near), "far": np.array(far)}


def route(codes: np.ndarray, mask: np.ndarray, tree: dict[str, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and leaves: the near side where distance - radius lies within, the far side where + radius goes beyond."""
    rows, nodes, masked, out = np.arange(len(codes)), np.zeros(len(codes), np.int64), codes & mask, []
    while len(rows):
        leaf = tree["near"][nodes] < 0
        out.append((rows[leaf], nodes[leaf]))
        rows, nodes = rows[~leaf], nodes[~leaf]
        d, border = distances(masked[rows], tree["points"][nodes]), tree["radii"][nodes]
        inside, beyond = d - radius <= border, d + radius > border
        rows, nodes = (np.concatenate((rows[inside], rows[beyond])),
                       np.concatenate((tree["near"][nodes[inside]], tree["far"][nodes[beyond]])))
    return np.concatenate([r for r, _ in out] or [rows]), np.concatenate([n for _, n in out] or [nodes])


def mask_key(codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A number that equal masked fingerprints share."""
    mixer = np.arange(1, codes.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    key = ((codes & mask) * mixer).sum(axis=1, dtype=np.uint64)
    return (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def shard_links(ids: np.ndarray, codes: np.ndarray, mask: np.ndarray, radius: int, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a shard within ``bits``. With radius 0 only rows equal on the mask can be a pair."""
    key = mask_key(codes, mask) if radius == 0 else np.zeros(len(ids), np.uint64)
    order = np.lexsort((ids, key))
    ids, codes, key = ids[order], codes[order], key[order]
    parent, links = np.arange(len(ids)), []

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    left, gap = np.arange(len(ids)), 1
    while len(left := left[left + gap < len(ids)]):
        left = left[key[left] == key[left + gap]]
        close = left[parent[left] != parent[left + gap]]
        close = close[distances(codes[close], codes[close + gap]) <= bits]
        for k in close.tolist():
            a, b = root(k), root(k + gap)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(ids[k]), int(ids[k + gap])))
        if len(close):
            while not np.array_equal(above := parent[parent], parent):
                parent = above
        gap += 1
    return links


def code_array(column: pa.Array, lanes: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.uint64).reshape(-1, lanes)


def block_pairs(own: Column, first: Column, last: Column) -> Column:
    """The pairs of a row's block with each block from ``first`` to ``last``, the smaller number first."""
    return F.transform(F.sequence(first, last), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))


def crowd_links(rows: DataFrame, place: list[str], node: str, weight: Column, block: int, link) -> DataFrame:
    """u, v: links that connect all pairs of the crowded places of ``rows`` (a written table with their ``blocks``).

    First the rows of block 0 stand for their place: they are compared with every other block. Mostly that makes a place
    one component, and then nothing is left. What else is left are pairs with a row outside its place's largest component:
    such rows are compared, in blocks, with each other and with the largest. So a group of copies costs as much as it has
    rows, and only rows that link with few others are compared with all.
    """
    own = F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
    last = F.col("blocks") - 1
    heads = F.when(own == 0, block_pairs(own, F.lit(1), last)).otherwise(F.array(F.struct(F.lit(0).alias("i"), own.alias("j"))))
    firsts = rows.select("*", F.explode(heads).alias("pair")).groupBy(*place, "pair").applyInArrow(link, "u long, v long").distinct()
    firsts = written(firsts, "first-links")
    roots = components(firsts).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    waiting = (rows.filter(own > 0).join(roots, F.col(node) == F.col("_node"), "left")
               .withColumn("_root", F.coalesce("_root", node)).select(*place, node, "_root", weight.alias("_weight")))
    waiting = written(waiting, "waiting")
    largest = (waiting.groupBy(*place, "_root").agg(F.sum("_weight").alias("_weight")).groupBy(*place)
               .agg(F.max(F.struct("_weight", "_root"))["_root"].alias("_largest"), F.count(F.lit(1)).alias("_roots"))
               .filter("_roots > 1").select(*place, "_largest"))
    outside = F.col("_root") != F.col("_largest")
    sides = written(waiting.join(written(largest, "largest"), place).select(*place, F.col(node).alias("_node"), outside.alias("_outside"), "_weight"), "sides")
    if sides.isEmpty():
        return firsts
    needed = [(F.sum(F.when(side, F.col("_weight")).otherwise(0)) / block).cast("int").alias(name)
              for name, side in (("_outer", F.col("_outside")), ("_inner", ~F.col("_outside")))]
    counts = written(sides.groupBy(*place).agg(*needed), "sides-blocks")
    split = sides.drop("_weight").join(counts, place)
    outer = F.pmod(F.xxhash64("_node"), F.col("_outer") + 1).cast("int")
    inner = F.pmod(F.xxhash64("_node"), F.col("_inner") + 1).cast("int")
    behind = F.transform(F.sequence(F.lit(0), F.col("_inner")), lambda k: F.struct(outer.alias("i"), (k + F.col("_outer") + 1).alias("j")))
    before = F.transform(F.sequence(F.lit(0), F.col("_outer")), lambda k: F.struct(k.alias("i"), (inner + F.col("_outer") + 1).alias("j")))
    pairs = F.when(F.col("_outside"), F.concat(block_pairs(outer, F.lit(0), F.col("_outer")), behind)).otherwise(before)
    dealt = written(split.select(*[F.col(c).alias(f"_{c}") for c in place], "_node", pairs.alias("_pairs")), "dealt")
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in place], F.col(node) == F.col("_node"))
    shards = rows.join(dealt, same).select(*rows.columns, F.explode("_pairs").alias("pair"))
    return firsts.unionByName(shards.groupBy(*place, "pair").applyInArrow(link, "u long, v long")).distinct()


def find_links(prints: DataFrame, masks: np.ndarray, lanes: int, bits: int, radius: int = 0,
               most: int = SAMPLE, ratio: int = RATIO, per_leaf: int = PER_LEAF, block: int = BLOCK) -> DataFrame:
    """u, v: links between fingerprints (node, code) that connect all pairs which the forest finds within ``bits``.

    A leaf's share of all rows is fixed by the sample, so with radius 0 leaves are parted further by the masked bits, which
    no pair crosses. A part that is still too large for a task is cut into blocks, see :func:`crowd_links`, so that no task
    holds more than two blocks however many fingerprints crowd together.
    """
    count = prints.count()
    rows = prints.select("code").orderBy(F.xxhash64("code"), "code").limit(min(most, count // ratio + 1)).collect()  # bounded
    sample = np.frombuffer(b"".join(bytes(r.code) for r in rows), np.uint64).reshape(-1, lanes)
    trees = [build_tree(sample, m, per_leaf) for m in masks]
    parts = max(1, count // PART * per_leaf // max(1, len(sample))) if radius == 0 else 1

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = code_array(batch.column(1), lanes)
            for number, (mask, tree) in enumerate(zip(masks, trees)):
                at, leaf = route(codes, mask, tree, radius)
                taken, part = pa.array(at), (mask_key(codes[at], mask) >> np.uint64(33)) % np.uint64(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), number), pa.int32()), pa.array(leaf, pa.int32()), pa.array(part.astype("i8")),
                     batch.column(0).take(taken), batch.column(1).take(taken)], ["tree", "leaf", "part", "node", "code"])

    def link(shard: pa.Table) -> pa.Table:
        codes = code_array(shard.column("code").combine_chunks(), lanes)
        found = shard_links(shard.column("node").to_numpy(), codes, masks[shard.column("tree")[0].as_py()], radius, bits)
        return pa.table({"u": pa.array([min(p) for p in found], pa.int64()), "v": pa.array([max(p) for p in found], pa.int64())})

    leaves = prints.select("node", "code").mapInArrow(to_leaves, "tree int, leaf int, part long, node long, code binary")
    place = ["tree", "leaf", "part"]
    crowded = written(leaves.groupBy(*place).count().filter(F.col("count") > block)
                      .select(*place, F.expr(f"CAST((count - 1) DIV {block} + 1 AS INT)").alias("blocks")), "crowded")
    links = leaves.join(crowded, place, "left_anti").groupBy(*place).applyInArrow(link, "u long, v long").distinct()
    if crowded.isEmpty():
        return links
    crowds = written(leaves.join(crowded, place), "crowds")
    return links.unionByName(crowd_links(crowds, place, "node", F.lit(1), block, link)).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that links lead to, for every linked node.

    Every node takes its smallest neighbour, if smaller than itself, as parent; following parents gives trees, the trees
    become nodes and their links links, until none is left. Each step is a join or an aggregate.
    """
    edges = written(links.filter("u <> v"), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "parents")
        while True:
            above = parents.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
            jumped = written(parents.join(above, F.col("p") == F.col("_u"))
                             .select("u", F.col("_p").alias("p"), (F.col("_p") != F.col("p")).alias("moved")), "parents")
            parents = jumped.select("u", "p")
            if jumped.filter("moved").isEmpty():
                break
        if roots is None:
            roots = parents.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            roots = written(roots.join(parents, F.col("root") == F.col("u"), "left")
                            .select("node", F.coalesce("p", "root").alias("root")), "roots")
        to = parents.select(F.col("u").alias("_u"), F.col("p").alias("_p"))
        first = edges.join(to, F.col("u") == F.col("_u")).select(F.col("_p").alias("u"), "v")
        second = first.join(to, F.col("v") == F.col("_u")).select("u", F.col("_p").alias("v"))
        edges = written(second.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    return roots if roots is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(codes: DataFrame, masks: np.ndarray, lanes: int, bits: int, radius: int = 0, **trees) -> DataFrame:
    """doc_id, mark, code, root for every row of ``codes``: rows of one root are linked, directly or by others."""
    prints = written(codes.groupBy("code").agg(F.count(F.lit(1)).alias("rows"))
                     .withColumn("node", F.monotonically_increasing_id()), "prints")
    roots = components(find_links(prints, masks, lanes, bits, radius, **trees))
    rooted = written(prints.join(roots, "node", "left").select("code", F.coalesce("root", "node").alias("root")), "rooted")
    return codes.join(rooted, "code")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id with shingles of four words and links within four bits."""
    codes = coded(docs, "doc_id", "text", WORDS)
    rows = written(classes(codes, band_masks(), 1, BITS), "classes")
    first = written(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "firsts")
    highest_first = F.concat(*[F.substring("code", 8 - k, 1) for k in range(8)])
    return rows.join(first, "root").select("doc_id", F.lower(F.hex(highest_first)).alias("fingerprint"), "component_id")


def sketched(docs: DataFrame, row_id: str, text: str, words: int, lanes: int) -> DataFrame:
    """doc_id, mark, code (minhashes), grams (a hash of the set of shingles) and size (of the set) of every row, written down."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            found = []
            for t in objects(batch.column(2)):
                grams = np.unique(shingle_hashes(t, words))
                found.append((minhash(grams, lanes), xxh64_intdigest(grams.tobytes(), SEED) - (1 << 63), len(grams)))
            code, mark, size = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(code, pa.binary()), pa.array(mark, pa.int64()), pa.array(size, pa.int64())],
                ["doc_id", "mark", "code", "grams", "size"])

    narrow = docs.select(F.col(row_id).cast("long").alias("doc_id"), text_mark(text).alias("mark"), F.col(text).alias("body"))
    return written(narrow.mapInArrow(sketch, "doc_id long, mark long, code binary, grams long, size long"), "sketches")


def set_links(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets (sorted arrays) whose Jaccard similarity is at least the given one.

    One set after the other is compared with all, from the smallest component; what has been compared is settled, and when
    the others are all of one component no pair is left that could tell anything.
    """
    bound = Fraction(str(similarity))
    sizes = np.array([len(s) for s in sets], np.int64)
    grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    label, waiting, links = np.arange(len(sets)), np.ones(len(sets), bool), []
    while True:
        counts = np.bincount(label[waiting], minlength=len(sets))
        if np.count_nonzero(counts) < 2:
            return links
        smallest = np.argmin(np.where(counts > 0, counts, len(sets) + 1))
        at = np.flatnonzero(waiting & (label == smallest))[0]
        first, last = np.searchsorted(grams, sets[at], "left"), np.searchsorted(grams, sets[at], "right")
        many = last - first
        places = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        shared = np.bincount(owner[places], minlength=len(sets))
        alike = shared * bound.denominator >= bound.numerator * (sizes[at] + sizes - shared)
        for k in np.flatnonzero(alike).tolist():
            if label[k] != label[at]:
                links.append((int(nodes[at]), int(nodes[k])))
                label[label == label[k]] = label[at]
        waiting[at] = False


def verified(docs: DataFrame, row_id: str, text: str, rows: DataFrame, words: int, similarity: float, block: int) -> DataFrame:
    """u, v: links between the sets of shingles (their hashes) of a root that connect all pairs of at least this similarity.

    Each set is taken from one text. The sets of a root are one shard; a root with too many shingles for a task is cut
    into blocks, see :func:`crowd_links`.
    """
    sets = rows.groupBy("root", "grams").agg(F.max(F.greatest("size", F.lit(LEAST_SIZE))).alias("size"),
                                             F.min(F.struct("doc_id", "mark")).alias("least"))
    sets = written(sets.select("root", "grams", "size", F.col("least.doc_id").alias(KEY_ID), F.col("least.mark").alias(KEY_MARK)), "sets")
    crowds = written(sets.groupBy("root").agg(F.count(F.lit(1)).alias("many"), F.sum("size").alias("size")).filter("many > 1")
                     .select("root", F.expr(f"CAST((size - 1) DIV {block} + 1 AS INT)").alias("blocks")), "crowds")
    wanted = written(sets.select("root", "grams", "size", KEY_ID, KEY_MARK).join(crowds, "root"), "wanted")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t, words)).tobytes() for t in objects(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(found, pa.binary())], ["root", "grams", "blocks", "size", "members"])

    def link(shard: pa.Table) -> pa.Table:
        nodes, at = np.unique(shard.column("grams").to_numpy(), return_index=True)
        members = shard.column("members")
        found = set_links(nodes, [np.frombuffer(members[k].as_py(), np.uint64) for k in at.tolist()], similarity)
        return pa.table({"u": pa.array([min(p) for p in found], pa.int64()), "v": pa.array([max(p) for p in found], pa.int64())})

    narrow = docs.select(F.col(row_id).cast("long").alias("_id"), text_mark(text).alias("_mark"), F.col(text).alias("_body"))
    texts = narrow.join(wanted, F.col("_id").eqNullSafe(F.col(KEY_ID)) & (F.col("_mark") == F.col(KEY_MARK)))
    def members_of(found: DataFrame) -> DataFrame:
        return found.select("root", "grams", "blocks", "_body", "size").mapInArrow(to_sets, "root long, grams long, blocks int, size long, members binary")

    links = members_of(texts.filter("blocks = 1")).groupBy("root").applyInArrow(link, "u long, v long").distinct()
    if wanted.filter("blocks > 1").isEmpty():
        return links
    crowded = written(members_of(texts.filter("blocks > 1")), "crowded")
    return links.unionByName(crowd_links(crowded, ["root"], "grams", F.col("size"), block, link)).distinct()


def dedup(docs: DataFrame, row_id: str = "doc_id", text: str = "text", words: int = NEAR_WORDS,
          similarity: float = NEAR_SIMILARITY, lanes: int = NEAR_LANES, block: int = NEAR_BLOCK) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id, with the input's columns.

    Documents are linked if the Jaccard similarity of their sets of shingles is at least the given one; a group is what
    links connect, directly or by others. Texts without words are alike. Rows that agree in id and text are told apart by
    the others.
    """
    codes = sketched(docs, row_id, text, words, lanes)
    rows = written(classes(codes, byte_masks(lanes, NEAR_TREES), lanes, loose_bits(similarity, lanes)).drop("code"), "classes")
    near = components(verified(docs, row_id, text, rows, words, similarity, block)).select(F.col("node").alias("grams"), F.col("root").alias("_near"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("mark"))
    kept = written(rows.join(near, "grams", "left").groupBy(F.coalesce("_near", "grams").alias("group")).agg(F.min(order).alias("least"))
                   .select(F.col("least.doc_id").alias(KEY_ID), F.col("least.mark").alias(KEY_MARK)), "kept")
    repeated = written(codes.groupBy(F.col("doc_id").alias(KEY_ID), F.col("mark").alias(KEY_MARK)).count()
                       .filter("count > 1").drop("count"), "repeated")
    return take_rows(docs, row_id, text_mark(text), kept, repeated)
