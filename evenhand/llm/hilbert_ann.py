"""Approximate nearest neighbours by shifted space-filling curves.

Each of ``CURVES`` orderings projects the vectors on ``DIMS`` random orthogonal directions, shifts them by a random part of
the grid, and numbers grid cells along a Hilbert curve. Keys are range-partitioned into ``RANGES`` ranges; a query meets
its own range and ``HALO`` neighbours on each side, in every ordering. Each window keeps its best candidates by exact
inner product, and the windows' lists merge.

The largest inner product is a nearest-neighbour search once each vector has one more component that brings all to the
same length; queries get 0 there and are scaled to that length. Projections' spread and the range borders are
fitted on ``SAMPLE`` vectors (those with the least hash of their id); every vector is indexed.

A window is a share of the table, so recall does not fall as the table grows: vectors without structure (random
directions) need windows that reach about three quarters of the table for 0.9, whatever the curve. Vectors that cluster
need less; ``ranges`` and ``curves`` set the trade.

A range may hold any number of vectors, copies of one vector included: it is cut into chunks by a hash of the ids. Defined
cases: null ids, null, empty and zero vectors, and null or non-finite components take no part; equal ids count once
(least vector in array order); shorter vectors are filled with zeros; ties go to the smaller vec_id; a table with fewer candidates
than asked gives fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenhand.llm import vectors as vec
from evenhand.llm.catalog import register
from evenhand.llm.common import read, written

CURVES = 14
DIMS = 12
BITS = 3
RANGES = 16
HALO = 1
SAMPLE = 4096
K = 20
SEED = 7
# Scores of one matrix product may differ in the last bits between blocks; candidates this close to the last place are scored again one by one.
SLACK = 1e-9


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of grid cells (rows of whole numbers below 2^bits)."""
    x = cells.T.astype(np.int64)
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        low = level - 1
        for axis in x:
            inverted = (axis & level) != 0
            swap = np.where(inverted, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(inverted, low, swap)
            axis ^= swap if axis is not x[0] else 0
        level >>= 1
    x[1:] = np.bitwise_xor.accumulate(x, axis=0)[1:]
    flip = np.zeros_like(x[0])
    level = top
    while level > 1:
        flip ^= np.where((x[-1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= flip
    keys = np.zeros_like(flip)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            keys = (keys << 1) | ((axis >> bit) & 1)
    return keys


@dataclass
class Index:
    """What is fitted: directions, grids and range borders of every curve."""

    longest: float
    directions: np.ndarray  # curve, component, axis
    low: np.ndarray  # curve, axis
    side: np.ndarray
    borders: np.ndarray  # curve, range border
    bits: int

    @staticmethod
    def fit(sample: np.ndarray, longest: float, curves: int, dims: int, bits: int, ranges: int, seed: int) -> Index:
        rng = np.random.default_rng(seed)
        width = sample.shape[1] + 1
        dims = min(dims, width)
        directions = np.stack([np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(curves)])
        lifted = _lift(sample, longest)
        projected = np.einsum("nw,cwd->cnd", lifted, directions)
        low, high = projected.min(axis=1), projected.max(axis=1)
        spread = np.maximum(high - low, 1e-12)
        # The grid is half as wide again as the sample, and the shift moves it within that room.
        index = Index(longest, directions, low - rng.random(low.shape) * spread / 2, spread * 1.5, np.zeros((curves, 0)), bits)
        keys = index.keys(lifted)
        at = np.arange(1, ranges) * keys.shape[1] // ranges
        index.borders = np.sort(keys, axis=1)[:, at]
        return index

    def keys(self, lifted: np.ndarray) -> np.ndarray:
        """The key of every vector on every curve (curve, vector)."""
        out = np.empty((len(self.directions), len(lifted)), np.int64)
        for c, directions in enumerate(self.directions):
            at = (lifted @ directions - self.low[c]) / self.side[c] * (1 << self.bits)
            out[c] = hilbert_keys(np.clip(at, 0, (1 << self.bits) - 1).astype(np.int64), self.bits)
        return out

    def ranges(self, lifted: np.ndarray) -> np.ndarray:
        """The key range of every vector on every curve (curve, vector)."""
        # A key that many vectors have is several borders; ranges count different ones, so that neighbours differ by 1.
        return np.stack([np.searchsorted(np.unique(b), k, side="right") for b, k in zip(self.borders, self.keys(lifted))])


def _lift(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes all as long as the longest."""
    rest = np.sqrt(np.maximum(longest**2 - (v**2).sum(axis=1), 0))
    return np.column_stack([v, rest])


def _placed(index: Index, width: int, halo: int, lifted_query: bool):
    """Rows (vec_id, v, part) to (curve, rng, part, vec_id, v): a vector's own range, a query's window of ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = index.borders.shape[1]
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                v = vec.matrix(batch.column("v"), width)
                if lifted_query:
                    lifted = np.column_stack([v * (index.longest / np.linalg.norm(v, axis=1))[:, None], np.zeros(len(v))])
                else:
                    lifted = _lift(v, index.longest)
                for curve, own in enumerate(index.ranges(lifted)):
                    for step in range(-halo, halo + 1) if lifted_query else (0,):
                        near = own + step
                        inside = np.flatnonzero((near >= 0) & (near <= last))
                        rows = batch.take(pa.array(inside))
                        keys = [pa.array(np.full(len(inside), curve), pa.int32()), pa.array(near[inside], pa.int32())]
                        yield pa.RecordBatch.from_arrays([*keys, rows.column("part"), rows.column("vec_id"), rows.column("v")], ["curve", "rng", "part", "vec_id", "v"])

    return run


PLACED = "curve int, rng int, part int, vec_id long, v array<double>"


def _rerank(k: int, parts: int, ranges: int):
    """The best candidates of each query in one chunk of one window, by inner product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = {n: batch.column(i)[row] for i, n in enumerate(batch.schema.names)}
                ids, c = vec.unpack(get["ids"], get["vals"])
                query_ids, q = vec.unpack(get["q_ids"], get["q_vals"])
                s = q @ c.T
                vec.mask_own(s, query_ids, ids, -np.inf)
                n = min(k, s.shape[1])
                last = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
                near = s >= np.where(np.isfinite(last), last - SLACK * np.maximum(1, np.abs(last)), -np.inf)[:, None]
                i, j = np.nonzero(near & (s > -np.inf))
                if not len(i):
                    continue
                exact = np.concatenate([(q[i[a : a + 8192]] * c[j[a : a + 8192]]).sum(axis=1) for a in range(0, len(i), 8192)])
                part = (get["curve"].as_py() * ranges + get["rng"].as_py()) * parts + get["part"].as_py()
                yield from vec.top_lists(query_ids, i, ids[j], exact, k, part, "double")

    return run


def nearest(
    rows: DataFrame,
    queries: Column,
    k: int = K,
    curves: int = CURVES,
    dims: int = DIMS,
    bits: int = BITS,
    ranges: int = RANGES,
    halo: int = HALO,
    sample: int = SAMPLE,
    seed: int = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` candidates with the largest inner product found for every query: rows (query_id, rank, vec_id, score)."""
    spark = rows.sparkSession
    rows = vec.valid_vectors(rows, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    rows = written(rows)
    n, n_queries, width = vec.shape_of(rows, queries)
    if n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    longest = float(rows.agg(F.max(square)).first()[0]) ** 0.5
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    index = Index.fit(vec.matrix(drawn["v"], width), longest, curves, dims, bits, ranges, seed)

    # Chunks of a range: as many as bring an even range to CHUNK_ROWS; a range that holds the whole table has chunks of ``ranges`` times that.
    parts = vec.parts_for(n, vec.CHUNK_ROWS * ranges)
    hashed = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part")
    placed = rows.select("vec_id", "v", hashed).mapInArrow(_placed(index, width, halo, False), PLACED)
    keys = ["curve", "rng", "part"]
    chunks = vec.pack(placed, keys, width).drop("slice")
    groups = vec.parts_for(n_queries * (2 * halo + 1), vec.GROUP_ROWS * ranges)
    group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int").alias("part")
    asked = rows.where(queries).select("vec_id", "v", group).mapInArrow(_placed(index, width, halo, True), PLACED)
    asked = vec.pack(asked, keys, width).select("curve", "rng", F.col("ids").alias("q_ids"), F.col("vals").alias("q_vals"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    lists = chunks.join(asked, keys).mapInArrow(_rerank(k, parts, ranges), f"query_id long, part int, {vec.TOP.format(kind='double')}")
    return vec.ranked(vec.merge_top(lists, curves * ranges * parts, k, distinct=True), "double")


@register("op1_hilbert_ann")
def hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, F.col("vec_id") % 20 == 0)
