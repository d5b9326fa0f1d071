"""Ridge-anchored logistic fits by Newton steps over distributed sums.

The objective is the mean logistic loss plus ``strength / (2 w^2) * |theta - anchor|^2`` with ``w`` the
number of weights, constant inputs included. Fits read rows ``(a, y, x)`` and give weights in the order
``[x..., a]``. The ridge makes the optimum unique and finite, whatever the labels and inputs are.

Rows are packed into blocks of numbers once. A Newton step is one pass over them: every task adds up the
loss, the gradient and the upper half of the Hessian of its rows, at most ``FAN_IN`` of these sums meet in
one place at a time, in a fixed order, and the driver solves for the step. Beyond ``DENSE`` weights no Hessian is formed:
the step comes from conjugate gradients, a pass each, which add up the Hessian's product with one vector.
What moves is as large as the model, never as the data.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Generator, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from evenhand.operators.solve import conjugate_gradients

# Newton steps, shortened ones counted; a fit that needs more says so.
MAX_STEPS = 100
# What a further step could lower the objective by, as its quadratic model has it, when a fit comes to rest.
TOLERANCE = 1e-10
# Weights up to which the Hessian is formed.
DENSE = 512
# Products of a conjugate-gradient solve.
PRODUCTS = 200
# Tasks whose sums meet in one.
FAN_IN = 32
# Bytes of sums that meet in one place, where sums are so wide that ``FAN_IN`` of them would be more.
MET_BYTES = 64 << 20
# Bytes of inputs in a block.
BLOCK_BYTES = 1 << 20


@dataclass(frozen=True)
class Fit:
    """Weights ``[x..., a]``, the steps taken, and whether the fit came to rest before its last one."""

    weights: list[float]
    steps: int
    converged: bool


def _logistic(f: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-f)) without overflow."""
    return np.exp(-np.logaddexp(0.0, -f))


def _packed(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (grp, x, a, y) to blocks (grp, z, y) of one group each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, BLOCK_BYTES // (8 * (width + 1)))
        for batch in batches:
            lists = batch.column("x")
            if (lists.value_lengths().to_numpy(zero_copy_only=False) != width).any():
                raise ValueError(f"x does not hold {width} inputs in every row")
            names = batch.column("grp").dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            for k, name in enumerate(names.dictionary.to_pylist()):
                own = pa.array(np.flatnonzero(codes == k))
                for first in range(0, len(own), rows):
                    part = batch.take(own.slice(first, rows))
                    x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    z = np.column_stack([x, part.column("a").to_numpy(zero_copy_only=False).astype(float)])
                    y = part.column("y").to_numpy(zero_copy_only=False).astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([z.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["grp", "z", "y"])

    return run


SUMS = "grp string, part int, sums binary"


class Dense:
    """Inputs of some rows as a matrix."""

    def __init__(self, z: np.ndarray):
        self.z = z

    @staticmethod
    def unpacked(data: pa.Buffer, width: int) -> Dense:
        return Dense(np.frombuffer(data).reshape(-1, width))

    def scores(self, theta: np.ndarray) -> np.ndarray:
        return self.z @ theta

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        """The sum of the rows, each times its ``r``."""
        return self.z.T @ r

    def squares(self, w: np.ndarray) -> np.ndarray:
        """The sum of the rows' outer squares, each times its ``w``."""
        return self.z.T @ (self.z * w[:, None])


class Sparse:
    """Inputs of some rows as places that are not 0, and the group, which is the last place of every row."""

    def __init__(self, row: np.ndarray, idx: np.ndarray, val: np.ndarray, a: np.ndarray):
        self.row, self.idx, self.val, self.a = row, idx, val, a

    def packed(self) -> bytes:
        sizes = np.array([len(self.a), len(self.row)], np.int64)
        return b"".join(x.tobytes() for x in (sizes, self.a.astype(float), self.val.astype(float), self.row.astype(np.int64), self.idx.astype(np.int64)))

    @staticmethod
    def unpacked(data: pa.Buffer, width: int) -> Sparse:
        numbers = np.frombuffer(data, np.int64)
        n, m = numbers[:2]
        reals = numbers[2 : 2 + n + m].view(float)
        return Sparse(numbers[2 + n + m : 2 + n + 2 * m], numbers[2 + n + 2 * m :], reals[n:], reals[:n])

    def scores(self, theta: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * theta[self.idx], len(self.a)) + theta[-1] * self.a

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        out = np.bincount(self.idx, self.val * r[self.row], width)
        out[-1] += self.a @ r
        return out

    def squares(self, w: np.ndarray) -> np.ndarray:
        raise NotImplementedError("sparse inputs have no formed Hessian")


Inputs = Dense | Sparse
Adder = Callable[[Inputs, np.ndarray], np.ndarray]


class Blocks:
    """Packed blocks (grp, z, y) of a fit's rows, of one group each, kept for its passes."""

    def __init__(self, packed: DataFrame, width: int, unpack: Callable[[pa.Buffer, int], Inputs]):
        self.width, self.unpack = width, unpack
        self.packed = packed.persist()
        self.parts = self.packed.rdd.getNumPartitions()
        # Fewer sums meet at once the wider they are.
        self.fan_in = max(2, min(FAN_IN, MET_BYTES // (8 * width)))

    @staticmethod
    def dense(df: DataFrame, width: int, group: str | None = None) -> Blocks:
        named = F.lit("") if group is None else F.col(group).cast("string")
        rows = df.select(named.alias("grp"), F.col("x").cast("array<double>").alias("x"), "a", "y")
        return Blocks(rows.mapInArrow(_packed(width), "grp string, z binary, y binary"), width + 1, Dense.unpacked)

    def release(self) -> None:
        self.packed.unpersist()

    def totals(self, of: Mapping[str, Adder]) -> dict[str, np.ndarray]:
        """For each group the sum over its rows of what its ``of(z, y)`` gives for a block; none for a group without rows."""
        width, unpack, fan_in = self.width, self.unpack, self.fan_in

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[str, np.ndarray] = {}
            for batch in batches:
                for name, z, y in zip(*batch.columns):
                    group = name.as_py()
                    if group in of:
                        block = of[group](unpack(z.as_buffer(), width), np.frombuffer(y.as_buffer()))
                        found[group] = found[group] + block if group in found else block
            part = TaskContext.get().partitionId()
            for group, sums in found.items():
                yield _row(group, part, sums)

        sums, parts = self.packed.mapInArrow(run, SUMS), self.parts
        while parts > fan_in:
            parts = math.ceil(parts / fan_in)
            sums = sums.groupBy("grp", F.floor(F.col("part") / fan_in).alias("_met")).applyInArrow(_added(fan_in), SUMS)
        table = sums.toArrow()
        return {g: _in_order(table.filter(pc.equal(table["grp"], g))) for g in pc.unique(table["grp"]).to_pylist()}


def _row(group: str, part: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([group]), pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["grp", "part", "sums"])


def _in_order(table: pa.Table) -> np.ndarray:
    """The sum of a column of sums, always in the same order."""
    return np.sum([np.frombuffer(s.as_buffer()) for s in table.sort_by("part")["sums"]], axis=0)


def _added(fan_in: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_row(table["grp"][0].as_py(), int(table["part"][0].as_py()) // fan_in, _in_order(table))])

    return run


@dataclass(frozen=True)
class Point:
    """The objective at some weights, its gradient, and its Hessian where one is formed."""

    theta: np.ndarray
    value: float
    gradient: np.ndarray
    hessian: np.ndarray | None
    rows: float


class Objective:
    """The anchored mean loss of a group's rows: what to add up over its blocks, and what the sums mean."""

    def __init__(self, anchor: np.ndarray, ridge: float, dense: bool):
        self.anchor, self.ridge, self.dense = anchor, ridge, dense

    def sums_at(self, theta: np.ndarray) -> Adder:
        upper, dense = np.triu_indices(len(theta)) if self.dense else None, self.dense

        def sums(z: Inputs, y: np.ndarray) -> np.ndarray:
            f = z.scores(theta)
            p = _logistic(f)
            parts = [[len(y), np.logaddexp(0.0, np.where(y > 0, -f, f)).sum()], z.back(p - y, len(theta))]
            if dense:
                parts.append(z.squares(p * (1.0 - p))[upper])
            return np.concatenate(parts)

        return sums

    def point(self, theta: np.ndarray, total: np.ndarray) -> Point:
        w, n, away, hessian = len(theta), total[0], theta - self.anchor, None
        if self.dense:
            hessian = np.zeros((w, w))
            hessian[np.triu_indices(w)] = total[2 + w :] / n
            hessian = hessian + np.triu(hessian, 1).T + self.ridge * np.eye(w)
        return Point(theta, total[1] / n + self.ridge / 2 * away @ away, total[2 : 2 + w] / n + self.ridge * away, hessian, n)


def _product(blocks: Blocks, group: str, point: Point, ridge: float) -> Callable[[np.ndarray], np.ndarray]:
    """The Hessian's product with a vector: a pass."""
    theta = point.theta

    def product(v: np.ndarray) -> np.ndarray:
        def sums(z: Inputs, y: np.ndarray) -> np.ndarray:
            p = _logistic(z.scores(theta))
            return z.back(p * (1.0 - p) * z.scores(v), len(v))

        return blocks.totals({group: sums})[group] / point.rows + ridge * v

    return product


def _search(start: np.ndarray, step_at: Callable[[Point, float], np.ndarray], max_steps: int, tolerance: float) -> Generator[np.ndarray, Point | None, Fit]:
    """Newton's method as a conversation: yields weights, is sent the point there (None without rows), and returns the fit."""
    point = yield start
    if point is None:
        return Fit([float(z) for z in start], 0, True)
    first, share = float(np.linalg.norm(point.gradient)), 1.0
    step = step_at(point, first) if first else np.zeros_like(start)
    for steps in range(1, max_steps + 1):
        slope = point.gradient @ step
        # Near the optimum the error of a whole step is about the square of what is left.
        if -slope / 2 <= tolerance:
            return Fit([float(t) for t in point.theta + step], steps, True)
        trial = yield point.theta + share * step
        if trial.value <= point.value + 1e-4 * share * slope + 1e-14 * abs(point.value):
            point, share = trial, 1.0
            step = step_at(point, first)
        else:
            share /= 2
    return Fit([float(t) for t in point.theta], max_steps, False)


def fit_groups(
    df: DataFrame, group: str | None, width: int, strength: Mapping[str, float], anchors: Mapping[str, Sequence[float]], max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE
) -> dict[str, Fit]:
    """One anchored fit for each key of ``anchors``, to the rows whose ``group`` it is; all of them share their passes over the rows.

    A fit starts at its anchor, and without rows that is its result.
    """
    for anchor in anchors.values():
        if len(anchor) != width + 1:
            raise ValueError(f"{len(anchor)} weights for {width} features and the group")
    starts = {k: np.array([float(z) for z in anchor]) for k, anchor in anchors.items()}
    return fit_blocks(Blocks.dense(df, width, group), starts, {k: strength[k] / (width + 1) ** 2 for k in anchors}, max_steps, tolerance)


def fit_blocks(blocks: Blocks, starts: Mapping[str, np.ndarray], ridges: Mapping[str, float], max_steps: int, tolerance: float) -> dict[str, Fit]:
    """``fit_groups`` over packed blocks, which are released at the end."""
    dense = blocks.unpack is Dense.unpacked and blocks.width <= DENSE
    objectives = {k: Objective(start, ridges[k], dense) for k, start in starts.items()}

    def step_of(key: str) -> Callable[[Point, float], np.ndarray]:
        def step(point: Point, first: float) -> np.ndarray:
            if point.hessian is not None:
                return -np.linalg.solve(point.hessian, point.gradient)
            # The more exact the smaller the gradient is against the first one.
            size = float(np.linalg.norm(point.gradient))
            product = _product(blocks, key, point, objectives[key].ridge)
            return conjugate_gradients(product, -point.gradient, min(0.1, math.sqrt(size / first)) * size, PRODUCTS)

        return step

    try:
        searches = {k: _search(o.anchor, step_of(k), max_steps, tolerance) for k, o in objectives.items()}
        asked = {k: next(search) for k, search in searches.items()}
        fits: dict[str, Fit] = {}
        while asked:
            totals = blocks.totals({k: objectives[k].sums_at(theta) for k, theta in asked.items()})
            wanted, asked = asked, {}
            for k, theta in wanted.items():
                try:
                    asked[k] = searches[k].send(objectives[k].point(theta, totals[k]) if k in totals else None)
                except StopIteration as done:
                    fits[k] = done.value
        if slow := [k for k, fit in fits.items() if not fit.converged]:
            warnings.warn(f"{len(slow)} of {len(fits)} fits took all of their {max_steps} steps and have not come to rest", stacklevel=2)
        return fits
    finally:
        blocks.release()


def fit_anchored(df: DataFrame, width: int, strength: float, anchor: Sequence[float], max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> Fit:
    """Fit anchored at ``anchor``, which is also where it starts. No rows give the anchor itself."""
    return fit_groups(df, None, width, {"": strength}, {"": anchor}, max_steps, tolerance)[""]


def fit_shift(df: DataFrame, width: int, strength: float, anchor: Sequence[float], max_steps: int = MAX_STEPS) -> list[float]:
    """The weights of :func:`fit_anchored`."""
    return fit_anchored(df, width, strength, anchor, max_steps).weights


def fit_logistic(df: DataFrame, width: int, strength: float, max_steps: int = MAX_STEPS) -> list[float]:
    """The weights of the fit anchored at 0."""
    return fit_anchored(df, width, strength, [0.0] * (width + 1), max_steps).weights
