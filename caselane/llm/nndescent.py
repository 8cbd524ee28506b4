"""Near-duplicate embeddings by NN-descent.

Vectors of one label and length are a class of their own; exact copies are folded first. Every distinct vector keeps a list of its
nearest neighbours. The first lists come from sorted windows: rows are sorted by the signs of random projections, and
each run of some rows of the sorted order is compared as one block, so that no block grows with the data. Then
neighbours of neighbours refine the lists: around every vector, those it lists and those that list it are compared with each
other, if one of the two is new there, and each keeps its best. What a hub is listed by is dealt out in blocks, and each block
meets the hub's own list, so no group grows with the data either. Rounds end when one brings no new link.

A list whose last entry still lies above the threshold is saturated: there may be more links than the list has places. Such
a list is enlarged to the whole component that the links found so far connect, and components are settled exactly, in
blocks sorted by the angle to one member. Triangle bounds on those angles tell of two blocks that they hold
no link or nothing but links; only the others are compared, and blocks report counts, never pairs.

Then the recall is measured: a fixed number of vectors (``AUDITED``), chosen by hash, are compared with all others. Below
``LEAST_RECALL`` the lists and windows are doubled and the descent goes on. At the size of the largest class this ends in
comparing all with all.

The lists hold unit vectors in half precision, whose cosines are off by less than ``SLACK``; every link that counts is one of
the exact phase, in double precision.

Defined cases: a vector that is null, empty or zero, or holds null or non-finite components, and one without a label links
with nothing, nor do vectors of different length; such a row is its own component. Repeated rows are vectors of their own; rows that
share a vec_id count as different vectors. A component of null ids has a null component_id and is not kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from caselane.llm.simhash import components
from caselane.operators.ordered import running_sums
from caselane.session import written

THRESHOLD = 0.93
SLACK = 2e-3  # of a cosine of unit vectors in half precision
PLACES = 8  # of a list
TREES, BITS = 8, 48  # sorted orders for the first lists, signs that each goes by
WINDOW = 16  # rows that are compared as one block, for each place of a list
HUB = 64  # entries that a block holds of those that list a vector, on average
BLOCK = 1 << 10  # members of a component that are compared as one block, on average
AUDITED = 1 << 9  # vectors that are compared with all others
LEAST_RECALL = 0.95
SEED = 42
ROUNDING = 1e-9  # more than angles are off by


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, plain) & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first to a largest component of one, so that no square overflows."""
    large = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return large / np.linalg.norm(large, axis=1, keepdims=True)


def matrix(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The rows of a binary column of equal lengths as one matrix of doubles."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)


def folded(rows: DataFrame) -> DataFrame:
    """node, label, size, copies, exact (unit vector, doubles) and half (the same in half precision) of every distinct vector."""
    same = rows.groupBy("label", "vector").agg(F.count(F.lit(1)).alias("copies"))
    narrow = same.select("label", F.size("vector").alias("size"), "copies", "vector", F.monotonically_increasing_id().alias("node"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, exact, half = batch.column(3), [], []
            for at in range(len(batch)):  # lengths may differ within a batch
                row = unit(np.asarray(vectors[at].values, np.float64)[None])
                exact.append(row.tobytes())
                half.append(row.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(4), *batch.columns[:4], pa.array(exact, pa.binary()), pa.array(half, pa.binary())],
                                             ["node", "label", "size", "copies", "vector", "exact", "half"])

    kind = same.schema["label"].dataType.simpleString()
    return written(narrow.mapInArrow(
        encode, f"node long, label {kind}, size int, copies long, vector array<double>, exact binary, half binary"), "vectors")


def best_of(nodes: np.ndarray, cosines: np.ndarray, allowed: np.ndarray, places: int, floors: np.ndarray | None = None):
    """For each row of a block its best allowed columns, above the row's floor: arrays u, v, cosine."""
    worth = np.where(allowed, cosines, -np.inf)
    np.fill_diagonal(worth, -np.inf)
    if floors is not None:
        worth[worth <= floors[:, None]] = -np.inf
    k = min(places, len(nodes) - 1)
    if k < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    at = np.argpartition(-worth, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(worth, at, axis=1)
    row, place = np.nonzero(value > -np.inf)
    return nodes[row], nodes[at[row, place]], value[row, place]


def edge_batch(u: np.ndarray, v: np.ndarray, cosine: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(cosine, pa.float32())], ["u", "v", "cosine"])


EDGE = "u long, v long, cosine float"


def dealt(vectors: DataFrame, trees: list[int]) -> DataFrame:
    """tree, node, label, size, half: the rows that each sorted order takes. Of a root that holds several vectors it is one.

    Members of a component would fill the windows and hide from each other what lies beyond them.
    """
    rows = vectors.withColumn("tree", F.explode(F.array(*[F.lit(t) for t in trees])))
    alone = rows.filter(~F.col("grown"))
    chosen = rows.filter("grown").groupBy("tree", "root").agg(
        F.min_by(F.struct("node", "label", "size", "half"), F.xxhash64("tree", "node")).alias("row"))
    return alone.select("tree", "node", "label", "size", "half").unionByName(chosen.select("tree", "row.*"))


def windows(rows: DataFrame, places: int) -> DataFrame:
    """Edges between rows that lie in one window of a sorted order, the best of each row."""
    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for batch in batches:
            tree, size = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for key in sorted(set(zip(tree.tolist(), size.tolist()))):
                some = batch.filter(pa.array((tree == key[0]) & (size == key[1])))
                if key not in planes:
                    planes[key] = np.random.default_rng((SEED, *key)).standard_normal((key[1], BITS))
                code = (matrix(some.column(4), np.float16) @ planes[key] > 0) @ (1 << np.arange(BITS - 1, -1, -1))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(code, pa.int64())], ["tree", "node", "label", "size", "half", "code"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                nodes = np.array([n for n, _ in held])
                units = np.frombuffer(b"".join(h for _, h in held), np.float16).reshape(len(held), -1).astype(np.float32)
                yield edge_batch(*best_of(nodes, units @ units.T, np.ones((len(nodes), len(nodes)), bool), places))
            held.clear()

        for batch in batches:
            for *here, node, half in zip(*[batch.column(c).to_pylist() for c in ("tree", "label", "size", "node", "half")]):
                if here != key or len(held) == WINDOW * places:
                    yield from done()
                    key = here
                held.append((node, half))
        yield from done()

    kind = rows.schema["label"].dataType.simpleString()
    sorted_by = ["tree", "label", "size", "code", "node"]
    coded = rows.select("tree", "node", "label", "size", "half").mapInArrow(signs, f"tree int, node long, label {kind}, size int, half binary, code long")
    return coded.repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by).mapInArrow(compare, EDGE)


def best_lists(edges: DataFrame, places: int) -> DataFrame:
    """u, v, cosine, inner, fresh: the best entries of each list, within the root of u (``inner``) and beyond, written down.

    An entry that has been there before is not fresh. Spark takes the first rows of each list in the map tasks already, so
    that a hub's candidates are not moved whole.
    """
    once = edges.groupBy("u", "v", "inner").agg(F.max("cosine").alias("cosine"), F.bool_and("fresh").alias("fresh"))
    order = Window.partitionBy("u", "inner").orderBy(F.desc("cosine"), "v")
    return written(once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= places).drop("place"), "lists")


def refine(vectors: DataFrame, lists: DataFrame, places: int) -> DataFrame:
    """Edges between those of different roots that meet around a vector, one of them newly; only what would enter a list."""
    listed = lists.groupBy("v").count().filter(F.col("count") > HUB)
    hubs = written(listed.select(F.col("v").alias("center"), F.expr(f"CAST((count - 1) DIV {HUB} + 1 AS INT)").alias("blocks")), "hubs")
    blocks = F.coalesce("blocks", F.lit(1))
    own = lists.select(F.col("u").alias("center"), F.col("v").alias("member"), "fresh").join(hubs, "center", "left")
    own = own.select("center", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "member", "fresh")
    back = lists.select(F.col("v").alias("center"), F.col("u").alias("member"), "fresh").join(hubs, "center", "left")
    back = back.select("center", F.pmod(F.xxhash64("member"), blocks).cast("int").alias("block"), "member", "fresh")
    floors = lists.filter("NOT inner").groupBy("u").agg(F.min("cosine").alias("floor"), F.count(F.lit(1)).alias("taken"))
    known = vectors.select("node", "root", "half").join(floors, F.col("node") == F.col("u"), "left").select(
        F.col("node").alias("member"), "root", "half", F.when(F.col("taken") >= places, F.col("floor")).otherwise(-2.0).alias("floor"))
    around = own.unionByName(back).groupBy("center", "block", "member").agg(F.bool_or("fresh").alias("fresh"))

    def meet(group: pa.Table) -> pa.Table:
        nodes, root = group.column("member").to_numpy(), group.column("root").to_numpy()
        fresh = group.column("fresh").to_numpy(zero_copy_only=False)
        allowed = (fresh[:, None] | fresh[None, :]) & (root[:, None] != root[None, :])
        if not allowed.any():
            return pa.Table.from_batches([edge_batch(nodes[:0], nodes[:0], np.empty(0))])
        units = matrix(group.column("half"), np.float16).astype(np.float32)
        return pa.Table.from_batches([edge_batch(*best_of(nodes, units @ units.T, allowed, places, group.column("floor").to_numpy()))])

    return around.join(known, "member").groupBy("center", "block").applyInArrow(meet, EDGE)


def descend(vectors: DataFrame, close: float, places: int, trees: list[int], start: DataFrame | None = None) -> DataFrame:
    """The lists of neighbours once a round brings no new link between different roots. ``start`` are the lists of before."""
    edges = windows(dealt(vectors, trees), places).select("*", F.lit(False).alias("inner"), F.lit(True).alias("fresh"))
    if start is not None:
        side = lambda end: vectors.select(F.col("node").alias(f"_{end}"), F.col("root").alias(f"_root_{end}"))
        again = start.join(side("u"), F.col("u") == F.col("_u")).join(side("v"), F.col("v") == F.col("_v"))
        edges = edges.unionByName(again.select("u", "v", "cosine", (F.col("_root_u") == F.col("_root_v")).alias("inner"), F.lit(False).alias("fresh")))
    lists = best_lists(edges, places)

    def links() -> int:
        return lists.filter(~F.col("inner") & (F.col("cosine") >= close)).count()

    before, now = -1, links()
    while now != before:
        new = refine(vectors, lists, places).select("*", F.lit(False).alias("inner"), F.lit(True).alias("fresh"))
        lists = best_lists(lists.withColumn("fresh", F.lit(False)).unionByName(new), places)
        before, now = now, links()
    return lists


def exact_links(vectors: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """u < v: the entries of the lists that are links; what half precision leaves open is compared in double precision."""
    found = lists.filter(F.col("cosine") >= threshold - SLACK).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "cosine")
    found = found.groupBy("u", "v").agg(F.max("cosine").alias("cosine"))
    open_ = found.filter(F.col("cosine") < threshold + SLACK)
    side = lambda end: vectors.select(F.col("node").alias(end), F.col("exact").alias(f"exact_{end}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [bool(np.frombuffer(a.as_py()) @ np.frombuffer(b.as_py()) >= threshold) for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))

    decided = open_.join(side("u"), "u").join(side("v"), "v").select("u", "v", "exact_u", "exact_v").mapInArrow(compare, "u long, v long")
    return found.filter(F.col("cosine") >= threshold + SLACK).select("u", "v").unionByName(decided)


def settle(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """node and links of the members (node, root, copies, exact) of each root: other vectors linked, by exact cosines.

    Members of a root are ranked by their angle to one of them and cut into blocks; every pair of blocks that the angles
    leave open is a shard of its own.
    """
    first = written(members.groupBy("root").agg(F.min_by("exact", "node").alias("pivot")), "pivots")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [float(np.arccos(np.clip(np.frombuffer(a.as_py()) @ np.frombuffer(b.as_py()), -1, 1)))
                     for a, b in zip(batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.float64())], ["root", "node", "copies", "exact", "angle"])

    pairs = members.join(first, "root").select("root", "node", "copies", "exact", "pivot")
    measured = written(pairs.mapInArrow(measure, "root long, node long, copies long, exact binary, angle double"), "angles")
    ranked = running_sums(measured.select("root", "node", "angle"), ["root"], ["angle", "node"], {"place": F.lit(1)})
    placed = written(measured.join(ranked.select("node", F.expr(f"CAST((place - 1) DIV {block} AS INT)").alias("block")), "node"), "placed")
    cells = written(placed.groupBy("root", "block").agg(F.sum("copies").alias("weight"), F.min("angle").alias("low"), F.max("angle").alias("high")), "cells")
    limit = float(np.arccos(threshold))
    other = cells.select("root", *[F.col(c).alias(f"o_{c}") for c in ("block", "weight", "low", "high")])
    near = (F.col("low") - F.col("o_high") <= limit + ROUNDING) & (F.col("o_low") - F.col("high") <= limit + ROUNDING)
    met = written(cells.join(other, "root").filter(near).withColumn("all", F.col("high") + F.col("o_high") <= limit - ROUNDING), "meetings")
    everything = written(met.filter("all").groupBy("root", "block").agg(
        F.sum("o_weight").alias("found"), F.max((F.col("block") == F.col("o_block")).cast("int")).alias("itself")), "everything")
    whole = placed.join(everything, ["root", "block"]).select("node", (F.col("found") - F.col("itself") * F.col("copies")).alias("found"))
    left = met.filter("NOT all AND block <= o_block").select("root", F.col("block").alias("i"), F.col("o_block").alias("j"))
    sides = left.select("root", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")

    def count(group: pa.Table) -> pa.Table:
        units, copies = matrix(group.column("exact"), np.float64), group.column("copies").to_numpy()
        node, block_, i, j = (group.column(c).to_numpy() for c in ("node", "block", "i", "j"))
        own, rest = np.flatnonzero(block_ == i), np.flatnonzero(block_ == j)
        linked = units[own] @ units[rest].T >= threshold
        if i[0] == j[0]:
            np.fill_diagonal(linked, False)
            return pa.table({"node": node[own], "found": linked @ copies[rest]})
        return pa.table({"node": np.concatenate((node[own], node[rest])), "found": np.concatenate((linked @ copies[rest], linked.T @ copies[own]))})

    counted = placed.join(sides, ["root", "block"]).groupBy("root", "i", "j").applyInArrow(count, "node long, found long")
    return counted.unionByName(whole).groupBy("node").agg(F.sum("found").alias("links"))


def recall(vectors: DataFrame, threshold: float, audited: int = AUDITED) -> float:
    """Of the links that some vectors, chosen by hash, have with any other, the share whose ends have one root.

    The audited vectors travel to every task, and tasks send back two numbers.
    """
    rows = vectors.select("node", "label", "size", "exact", "root")
    chosen = rows.orderBy(F.xxhash64("node"), "node").limit(audited).collect()  # a fixed number
    sorted_ = {}
    for r in chosen:
        sorted_.setdefault((r.label, r.size), []).append((np.frombuffer(bytes(r.exact)), r.root))
    asked = {k: (np.array([v for v, _ in found]), np.array([root for _, root in found])) for k, found in sorted_.items()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true = same = 0
        for batch in batches:
            root, places = batch.column(4).to_numpy(), {}
            for at, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                places.setdefault(key, []).append(at)
            for key, at in places.items():
                if key in asked:
                    queries, roots = asked[key]
                    linked = matrix(batch.column(3).take(pa.array(at)), np.float64) @ queries.T >= threshold
                    true += int(linked.sum())
                    same += int((linked & (root[at][:, None] == roots[None, :])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([true], pa.int64()), pa.array([same], pa.int64())], ["true", "same"])

    total = rows.mapInArrow(ask, "true long, same long").agg(F.sum("true").alias("true"), F.sum("same").alias("same")).first()
    own = len(chosen)  # each meets itself
    return 1.0 if total.true is None or total.true <= own else (total.same - own) / (total.true - own)


def link(rows: DataFrame, threshold: float = THRESHOLD, places: int = PLACES, least_recall: float = LEAST_RECALL) -> DataFrame:
    """label, vector, links, root of every distinct vector of (label, vector) rows with a direction."""
    found = folded(rows)
    largest = found.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 0
    vectors = found.select("*", F.col("node").alias("root"), F.lit(False).alias("grown"))
    trees, lists, links = list(range(TREES)), None, None
    while True:
        lists = descend(vectors, threshold - SLACK, places, trees, lists)
        new = written(exact_links(vectors, lists.filter("NOT inner"), threshold), "new")
        links = written(new if links is None else links.unionByName(new).distinct(), "links")
        roots = written(components(links), "roots")
        joined = vectors.drop("root", "grown").join(roots, "node", "left")
        rooted = written(joined.select(*found.columns, F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("grown")), "rooted")
        full = lists.filter("NOT inner").groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least"))
        saturated = not full.filter((F.col("n") >= places) & (F.col("least") >= threshold - SLACK)).isEmpty()
        vectors = rooted
        if saturated and not new.isEmpty():
            trees = [t + TREES for t in trees]  # the places of full lists are free for what lies beyond the component
        elif WINDOW * places >= largest or not saturated and recall(vectors, threshold) >= least_recall:
            break
        else:
            places, trees = 2 * places, [t + TREES for t in trees]
    counted = settle(vectors.filter("grown").select("root", "node", "copies", "exact"), threshold)
    return vectors.join(counted, "node", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "root")


def report(embeddings: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = embeddings.select(F.col(row_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    able = usable(F.col("vector")) & F.col("label").isNotNull()
    linked = written(link(rows.filter(able).select("label", "vector")), "linked")
    named = written(rows.filter(able).join(linked, ["label", "vector"]).select("vec_id", F.col("links").alias("n_links"), "root"), "named")
    first = written(named.groupBy("root").agg(F.min("vec_id").alias("component_id")), "firsts")
    alone = rows.filter(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = named.join(first, "root").select("vec_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    able AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0
        AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    links AS (SELECT a.k AS u, b.k AS v FROM able a JOIN able b ON a.label = b.label AND len(a.e) = len(b.e) AND a.k <> b.k
        WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
    reach AS (SELECT k AS u, k AS v FROM v UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
    least AS (SELECT u, min(vec_id) AS component_id FROM reach JOIN v ON reach.v = v.k GROUP BY u),
    degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
    FROM v JOIN least ON v.k = least.u LEFT JOIN degree ON v.k = degree.u"""
