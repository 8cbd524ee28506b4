"""Many penalised logistic fits over one table of term counts, with every pass over the rows shared by all of them.

The settings of an experiment (*arms*) differ in the rows they are trained on, in the penalty, and in the terms and weights of
terms that their own training rows give. All of them read one sparse matrix: damped counts over the union of their terms,
packed into blocks of rows. An arm's feature vector is that row times the arm's weight of each term, over the row's length
under these weights. So the margins of all arms are one block product of the counts and a matrix with a column per arm, and so
are the gradients, which every task sums over its blocks before anything moves; many partitions are summed in a tree.

Each arm walks to its own optimum by limited-memory quasi-Newton steps, one trial point per pass. They start from the second
derivatives: those along the axes, taken anew every ``RENEW`` steps, or, where all rows are few enough to be sent to every worker (``FEW_ROWS``, ``FEW_COUNTS``), the whole
matrix, never formed but solved with by conjugate gradients, each arm in a task of its own. Arms that have arrived leave the product. An arm has arrived when its gradient tells, by the convexity of the penalty, that its coefficients lie within
``TOLERANCE`` of the optimum, so the passes an experiment takes are those of its slowest arm.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, functions as F

from caselane.operators.heavy import items_of, slices
from caselane.operators.ngrams import MAX_FEATURES, Known, count_terms_of
from caselane.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # what runs in tasks travels with the task

TOLERANCE = 1e-6  # distance of the coefficients from the optimum
MEMORY = 100  # steps that the curvature is estimated from
FEW_ROWS, FEW_COUNTS = 1 << 14, 1 << 23  # rows and counts up to which workers solve with the whole second derivatives
RENEW = 15  # steps after which the second derivatives along the axes are taken anew
BLOCK_ROWS = 1 << 11
BLOCK_COUNTS = 1 << 19  # counts of a block, above which it is closed early
TREE = 64  # partitions whose sums one task adds up


@dataclass(frozen=True)
class Trial:
    """A walk asks for value and gradient at a point."""

    point: np.ndarray


@dataclass(frozen=True)
class Solve:
    """A walk asks for ``u`` with second derivatives at ``point`` times ``u`` near ``right``."""

    point: np.ndarray
    right: np.ndarray
    nearness: float  # of the product, as a share of the right-hand side


@dataclass(frozen=True)
class Axes:
    """A walk asks for the second derivatives along the axes at a point."""

    point: np.ndarray


Walk = Generator[Trial | Solve | Axes, tuple[float, np.ndarray] | np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Arm:
    """One setting: ``member`` names the 0/1 column of the rows it is trained on, ``pairs`` tells whether word pairs are terms."""

    name: str
    member: str
    c: float = 1.0
    pairs: bool = True


@dataclass(frozen=True)
class Fit:
    """A fitted arm: its terms in order of frequency, the weight of each term and its coefficient."""

    arm: Arm
    terms: list[str]
    idf: np.ndarray
    coefficients: np.ndarray
    intercept: float
    passes: int


@dataclass(frozen=True)
class Problem:
    """The packed rows and what the arms need to know of their terms and classes."""

    blocks: DataFrame
    terms: list[str]
    arms: list[Arm]
    space: list[int]  # per arm its column of ``scale``: arms of the same rows and terms share one
    scale: np.ndarray  # (terms, spaces): the weight of a term, 0 where it is none of the space's terms
    vocabularies: list[list[str]]  # per space
    members: list[str]
    class_weights: np.ndarray  # (arms, 2)


def damped(counts: np.ndarray) -> np.ndarray:
    """The logarithm is taken once for each count that may occur, not for each term of a row."""
    return (1.0 + np.log(np.arange(1, int(counts.max(initial=0)) + 1)))[counts.astype(np.intp) - 1]


def narrow_bytes(numbers: np.ndarray) -> bytes:
    """In the least of 1, 2, 4 or 8 bytes each that holds them all: passes are bound by what they read."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def prepare(rows: DataFrame, row_id: str, label: str, arms: list[Arm], size: int = MAX_FEATURES) -> Problem:
    """Count, choose terms for each space and pack the rows (row_id, label, ``_terms`` or ``_words``, the members' columns)."""
    spark = rows.sparkSession
    members = sorted({a.member for a in arms})
    spaces = sorted({(a.member, a.pairs) for a in arms})
    counts = written(count_terms_of(rows, members), "counts")
    sums = rows.agg(*[F.count_if((F.col(m) == 1) & (F.col(label) == k)).alias(f"{m}_{k}") for m in members for k in (0, 1)]).first()
    classes = {m: (sums[f"{m}_0"], sums[f"{m}_1"]) for m in members}
    vocabularies, known = [], {}
    for member, pairs in spaces:
        able = counts.filter(F.col(f"n_{member}") > 0)
        able = able if pairs else able.filter(~F.contains("term", F.lit(" ")))
        top = able.orderBy(F.desc(f"n_{member}"), "term").limit(size).select("term", F.col(f"df_{member}").alias("df")).collect()  # at most ``size``
        n = sum(classes[member])
        vocabularies.append([r.term for r in top])
        known[member, pairs] = {r.term: np.log((n + 1) / (r.df + 1)) + 1 for r in top}
    terms = sorted(set().union(*vocabularies))
    scale = np.array([[known[s].get(t, 0.0) for s in spaces] for t in terms]).reshape(len(terms), len(spaces))
    weight = {m: [sum(pair) / (2.0 * max(1, n)) for n in pair] for m, pair in classes.items()}
    packed = pack(rows, row_id, label, members, terms, scale)
    return Problem(packed, terms, list(arms), [spaces.index((a.member, a.pairs)) for a in arms], scale, vocabularies, members,
                   np.array([weight[a.member] for a in arms]))


def pack(rows: DataFrame, row_id: str, label: str, members: list[str], terms: list[str], scale: np.ndarray) -> DataFrame:
    """Blocks of rows: ids, labels, members, the lengths of the rows in each space, and the counts as sparse rows."""
    column, pairs = items_of(rows)
    sent = rows.sparkSession.sparkContext.broadcast((terms, scale))  # plain values: a broadcast object would need its module on the workers
    narrow = rows.select(F.col(column), F.col(row_id).alias("id"), F.col(label).cast("double").alias("label"),
                         *[F.col(m).cast("tinyint").alias(f"_in{k}") for k, m in enumerate(members)])
    spaces, id_type = scale.shape[1], narrow.schema["id"].dataType.simpleString()

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = sent.value
        known = Known(names, pairs)
        for batch in batches:
            labels = batch.column(2).to_numpy(zero_copy_only=False)
            inside = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[3:]], axis=1).astype(np.int8)
            for first, last in slices(batch.column(0)):
                every, place, times = known.counts(batch.column(0).slice(first, last - first))
                lengths = np.bincount(every, minlength=last - first)
                ends, at = np.cumsum(lengths), 0
                while at < last - first:
                    begin = ends[at - 1] if at else 0
                    upto = min(at + BLOCK_ROWS, max(at + 1, int(np.searchsorted(ends, begin + BLOCK_COUNTS, "right"))), last - first)
                    index, count, row = place[begin:ends[upto - 1]], times[begin:ends[upto - 1]], every[begin:ends[upto - 1]] - at
                    value, norms = damped(count), np.empty((upto - at, spaces))
                    for s in range(spaces):
                        norms[:, s] = np.sqrt(np.bincount(row, (value * weights[index, s]) ** 2, upto - at))
                    part = slice(first + at, first + upto)
                    yield pa.RecordBatch.from_arrays(
                        [pa.ListArray.from_arrays(pa.array([0, upto - at], pa.int32()), batch.column(1).slice(first + at, upto - at)),
                         pa.array([labels[part].tobytes()], pa.binary()), pa.array([inside[part].tobytes()], pa.binary()),
                         pa.array([norms.tobytes()], pa.binary()), pa.array([lengths[at:upto].astype(np.int32).tobytes()], pa.binary()),
                         pa.array([len(index)], pa.int64()), pa.array([narrow_bytes(index)], pa.binary()), pa.array([narrow_bytes(count)], pa.binary())],
                        ["ids", "labels", "members", "norms", "lengths", "counts", "index", "value"])
                    at = upto

    shape = f"ids array<{id_type}>, labels binary, members binary, norms binary, lengths binary, counts long, index binary, value binary"
    return written(narrow.mapInArrow(block, shape), "blocks")


class Block:
    """The sparse rows of one block as arrays."""

    def __init__(self, batch: pa.RecordBatch, at: int, width: int, spaces: int):
        def read(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(batch.column(name)[at].as_buffer(), kind)

        self.labels = read("labels", np.float64)
        self.members = read("members", np.int8).reshape(-1, width)
        norms = read("norms", np.float64).reshape(-1, spaces)
        self.shrink = np.divide(1.0, norms, out=np.zeros_like(norms), where=norms > 0)  # a row without terms has none
        counts = batch.column("counts")[at].as_py()

        def numbers(name: str) -> np.ndarray:
            return read(name, np.dtype(f"u{len(batch.column(name)[at].as_buffer()) // max(1, counts) or 1}"))

        self.index, self.value = numbers("index").astype(np.intp), damped(numbers("value"))  # numpy would widen them at each use
        self.row = np.repeat(np.arange(len(self.labels)), read("lengths", np.int32))

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """Counts times a (terms, columns) matrix."""
        return np.stack([np.bincount(self.row, self.value * column[self.index], len(self.labels)) for column in matrix.T], axis=1)

    def transposed(self, matrix: np.ndarray, terms: int, power: int = 1) -> np.ndarray:
        """Transposed counts (to a power) times a (rows, columns) matrix."""
        value = self.value ** power
        return np.stack([np.bincount(self.index, value * column[self.row], terms) for column in matrix.T], axis=1)


def weights_of(block: Block, problem_weights: np.ndarray, members: list[int]) -> np.ndarray:
    """What each row counts in each arm: 0 outside its training rows, else the weight of its class."""
    by_class = np.where(block.labels[:, None] == 1, problem_weights[:, 1], problem_weights[:, 0])
    return by_class * block.members[:, members]


def summed(problem: Problem, per_block, size: int) -> np.ndarray:
    """The sum over all blocks of what ``per_block`` gives, an array of ``size`` numbers."""
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size)
        for batch in batches:
            for at in range(len(batch)):
                found += per_block(batch, at)
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size)
        for batch in batches:
            for part in batch.column(0):
                found += np.frombuffer(part.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["sums"])

    parts = problem.blocks.mapInArrow(total, "sums binary")
    count = problem.blocks.rdd.getNumPartitions()
    while count > TREE:
        count = -(-count // TREE)
        parts = parts.repartition(count).mapInArrow(add, "sums binary")
    return sum((np.frombuffer(bytes(r.sums)) for r in parts.collect()), np.zeros(size))  # at most TREE rows


def evaluate(problem: Problem, arms: list[int], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and gradient of some arms at their points (arms, terms + 1), the intercept last, without the penalty."""
    terms, count = len(problem.terms), len(arms)
    space = [problem.space[a] for a in arms]
    member = [problem.members.index(problem.arms[a].member) for a in arms]
    scale, class_weights = problem.scale[:, space], problem.class_weights[arms]
    matrix, intercepts = scale * points[:, :terms].T, points[:, terms]
    width, spaces = len(problem.members), problem.scale.shape[1]

    def per_block(batch: pa.RecordBatch, at: int) -> np.ndarray:
        block = Block(batch, at, width, spaces)
        shrink, weight = block.shrink[:, space], weights_of(block, class_weights, member)
        sign = 2 * block.labels[:, None] - 1
        margin = sign * (block.times(matrix) * shrink + intercepts)
        loss = (weight * np.logaddexp(0, -margin)).sum(axis=0)
        slope = -sign * weight * np.exp(-np.logaddexp(0, margin))
        return np.concatenate((loss, slope.sum(axis=0), block.transposed(slope * shrink, terms).ravel()))

    found = summed(problem, per_block, count * (terms + 2))
    slopes = found[2 * count:].reshape(terms, count) * scale
    return found[:count], np.concatenate((slopes.T, found[count:2 * count, None]), axis=1)


def curvatures(problem: Problem, arms: list[int], points: np.ndarray) -> np.ndarray:
    """(arms, terms + 1): the second derivatives of some arms' penalised losses along the axes at their points."""
    terms, count = len(problem.terms), len(arms)
    space = [problem.space[a] for a in arms]
    member = [problem.members.index(problem.arms[a].member) for a in arms]
    scale, class_weights = problem.scale[:, space], problem.class_weights[arms]
    matrix, intercepts = scale * points[:, :terms].T, points[:, terms]
    width, spaces = len(problem.members), problem.scale.shape[1]

    def per_block(batch: pa.RecordBatch, at: int) -> np.ndarray:
        block = Block(batch, at, width, spaces)
        shrink = block.shrink[:, space]
        margin = block.times(matrix) * shrink + intercepts
        bend = weights_of(block, class_weights, member) * np.exp(-np.logaddexp(0, margin) - np.logaddexp(0, -margin))
        return np.concatenate((bend.sum(axis=0), block.transposed(bend * shrink ** 2, terms, 2).ravel()))

    found = summed(problem, per_block, count * (terms + 1))
    along = found[count:].reshape(terms, count) * scale ** 2 + [1 / problem.arms[a].c for a in arms]
    return np.concatenate((along.T, np.maximum(found[:count, None], 1e-12)), axis=1)


def dot(a: np.ndarray, b: np.ndarray) -> float:
    """The inner product by one thread: a BLAS wakes all cores for so short a vector, which takes longer than the product."""
    return float(np.einsum("i,i", a, b))


def walk(curvature: np.ndarray, nearness: float, most: int, whole: bool) -> Walk:
    """Quasi-Newton steps from 0 to the returned point. With ``whole`` second derivatives they are Newton's steps, and none is remembered."""
    x = np.zeros_like(curvature)
    value, gradient = yield Trial(x)
    first = np.sqrt(dot(gradient, gradient))
    steps: deque = deque(maxlen=0 if whole else MEMORY)
    for step in range(most):
        size = np.sqrt(dot(gradient, gradient))
        if size <= nearness:
            break
        if step and step % RENEW == 0 and not whole:
            curvature = yield Axes(x)
        direction, taken = gradient.copy(), []
        for s, y, r in reversed(steps):
            taken.append(r * dot(s, direction))
            direction -= taken[-1] * y
        if whole:
            direction = yield Solve(x, direction, min(0.1, max(1e-4, np.sqrt(size / first))))
        else:
            direction /= curvature
        if steps:
            s, y, r = steps[-1]
            direction /= r * dot(y, y / curvature)
        for (s, y, r), a in zip(steps, reversed(taken)):
            direction += (a - r * dot(y, direction)) * s
        slope, length = -dot(gradient, direction), 1.0
        while True:
            trial = x - length * direction
            new_value, new_gradient = yield Trial(trial)
            if new_value <= value + 1e-4 * length * slope + 1e-12 * abs(value) or length < 1e-9:
                break
            length /= 2
        s, y = trial - x, new_gradient - gradient
        if dot(s, y) > 1e-14 * dot(s, s):
            steps.append((s, y, 1 / dot(s, y)))
        x, value, gradient = trial, new_value, new_gradient
    return x


class AllRows:
    """All rows as one block, where they are few: sent to the workers once, for solving with second derivatives."""

    def __init__(self, problem: Problem):
        width, spaces = len(problem.members), problem.scale.shape[1]
        table = problem.blocks.toArrow().combine_chunks()
        blocks = [Block(batch, at, width, spaces) for batch in table.to_batches() for at in range(len(batch))]
        starts = np.cumsum([0] + [len(b.labels) for b in blocks])
        together = {name: np.concatenate([getattr(b, name) for b in blocks]) for name in ("labels", "members", "shrink", "index", "value")}
        together["row"] = np.concatenate([b.row + at for b, at in zip(blocks, starts)])
        self.sent = problem.blocks.sparkSession.sparkContext.broadcast((together, problem.scale, problem.class_weights))
        self.problem = problem

    def solve(self, arms: list[int], asked: list[Solve]) -> list[np.ndarray]:
        """What each arm asked for, each in a task of its own."""
        problem, sent = self.problem, self.sent
        space = [problem.space[a] for a in arms]
        member = [problem.members.index(problem.arms[a].member) for a in arms]
        penalty, count = [1 / problem.arms[a].c for a in arms], len(arms)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, scale, class_weights = sent.value
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    found = conjugate(rows, scale[:, space[k]], space[k], member[k], class_weights[arms[k]], penalty[k], asked[k])
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["k", "u"])

        tasks = problem.blocks.sparkSession.range(0, count, 1, count).mapInArrow(each, "k long, u binary")
        return [np.frombuffer(bytes(r.u)) for r in sorted(tasks.collect(), key=lambda r: r.k)]


def conjugate(rows: dict[str, np.ndarray], scale: np.ndarray, space: int, member: int, class_weights: np.ndarray, penalty: float,
              asked: Solve, most: int = 1000) -> np.ndarray:
    """Conjugate gradients, scaled by the second derivatives along the axes."""
    terms = len(scale)
    taken = np.flatnonzero(rows["members"][:, member])
    place = np.full(len(rows["labels"]), -1)
    place[taken] = np.arange(len(taken))
    inside = place[rows["row"]] >= 0
    index, row = rows["index"][inside], place[rows["row"][inside]]
    value = rows["value"][inside] * scale[index] * rows["shrink"][rows["row"][inside], space]
    weight = np.where(rows["labels"][taken] == 1, class_weights[1], class_weights[0])

    def times(u: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * u[index], len(taken)) + u[terms]

    margin = times(asked.point)
    bend = weight * np.exp(-np.logaddexp(0, margin) - np.logaddexp(0, -margin))
    flat = np.append(np.full(terms, penalty), 1e-12)
    axes = np.append(np.bincount(index, value ** 2 * bend[row], terms), bend.sum()) + flat

    def product(u: np.ndarray) -> np.ndarray:
        bent = bend * times(u)
        return np.append(np.bincount(index, value * bent[row], terms), bent.sum()) + flat * u

    found, left = np.zeros(terms + 1), asked.right.copy()
    scaled = left / axes
    search, dot = scaled.copy(), left @ scaled
    enough = asked.nearness * np.linalg.norm(left)
    for _ in range(most):
        if np.linalg.norm(left) <= enough:
            break
        ahead = product(search)
        step = dot / (search @ ahead)
        found += step * search
        left -= step * ahead
        scaled = left / axes
        dot, before = left @ scaled, dot
        search = scaled + dot / before * search
    return found


def solve(problem: Problem, tolerance: float = TOLERANCE, most: int = 1000) -> list[Fit]:
    """Minimise, for every arm, ``sum of weight * loss + |coefficients|^2 / (2 C)``; the intercept is not penalised."""
    problem.blocks.persist(StorageLevel.MEMORY_AND_DISK)  # the written blocks stand behind what is lost
    try:
        return _solve(problem, tolerance, most)
    finally:
        problem.blocks.unpersist()


def _solve(problem: Problem, tolerance: float, most: int) -> list[Fit]:
    terms, every = len(problem.terms), range(len(problem.arms))
    sums = problem.blocks.agg(F.sum(F.size("ids")).alias("rows"), F.sum("counts").alias("counts")).first()
    few = (sums.rows or 0) <= FEW_ROWS and (sums.counts or 0) <= FEW_COUNTS and bool(sums.rows)
    everything = AllRows(problem) if few else None
    penalty = np.array([1 / a.c for a in problem.arms])
    start = np.zeros((len(problem.arms), terms + 1))
    curvature = start + 1 if few else curvatures(problem, list(every), start)
    walks = [walk(h, tolerance * p, most, few) for h, p in zip(curvature, penalty)]
    asked: dict[int, Trial | Solve | Axes] = {k: next(walks[k]) for k in every}
    points, ended, passes = {}, {}, 0

    def answer(k: int, found: tuple[float, np.ndarray] | np.ndarray) -> None:
        try:
            asked[k] = walks[k].send(found)
        except StopIteration as end:
            points[k], ended[k] = end.value, passes
            del asked[k]

    while asked:
        trials = [k for k in every if isinstance(asked.get(k), Trial)]
        if trials:
            passes += 1
            losses, slopes = evaluate(problem, trials, np.array([asked[k].point for k in trials]))
            for k, loss, slope in zip(trials, losses, slopes):
                coefficients = asked[k].point[:terms]
                slope[:terms] += penalty[k] * coefficients
                answer(k, (loss + penalty[k] * dot(coefficients, coefficients) / 2, slope))
        renewed = [k for k in every if isinstance(asked.get(k), Axes)]
        if renewed:
            passes += 1
            for k, along in zip(renewed, curvatures(problem, renewed, np.array([asked[k].point for k in renewed]))):
                answer(k, along)
        waiting = [k for k in every if isinstance(asked.get(k), Solve)]
        if waiting:
            for k, found in zip(waiting, everything.solve(waiting, [asked[k] for k in waiting])):
                answer(k, found)
    if everything:
        everything.sent.unpersist()
    place = {t: k for k, t in enumerate(problem.terms)}
    fits = []
    for k, arm in enumerate(problem.arms):
        own = problem.vocabularies[problem.space[k]]
        at = np.array([place[t] for t in own], np.int64)
        fits.append(Fit(arm, own, problem.scale[at, problem.space[k]], points[k][at], float(points[k][terms]), ended[k]))
    return fits


def score(problem: Problem, fits: list[Fit]) -> DataFrame:
    """id, label, arm and y_prob: every row scored by every arm in one pass, written down."""
    terms, spaces, width = len(problem.terms), problem.scale.shape[1], len(problem.members)
    place = {t: k for k, t in enumerate(problem.terms)}
    matrix = np.zeros((terms, len(fits)))
    for k, fit in enumerate(fits):
        matrix[[place[t] for t in fit.terms], k] = fit.coefficients * fit.idf
    intercepts, space, names = np.array([f.intercept for f in fits]), problem.space, [f.arm.name for f in fits]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                block = Block(batch, at, width, spaces)
                margin = block.times(matrix) * block.shrink[:, space] + intercepts
                for k, name in enumerate(names):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("ids")[at].values, pa.array(block.labels.astype(np.int32)), pa.array([name] * len(margin)),
                         pa.array(np.exp(-np.logaddexp(0, -margin[:, k])))], ["id", "label", "arm", "y_prob"])

    kind = problem.blocks.schema["ids"].dataType.elementType.simpleString()
    return written(problem.blocks.mapInArrow(apply, f"id {kind}, label int, arm string, y_prob double"), "arm-scores")
