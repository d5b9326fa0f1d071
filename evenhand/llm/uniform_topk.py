"""Exact top-k by integer inner product with a three-phase uniform threshold.

The components are dealt out in ``NODES`` slices; a node holds one slice of one strip of vectors and knows partial scores
only. Phase 1: every node lists its highest partial scores for each query; the listed vectors' whole scores give each
query a lower bound on its k-th best, the cutoff. Phase 2: the cutoffs go back to all nodes, and each sends every vector
whose partial score is at least cutoff / NODES. A vector that no node sends has a total below the cutoff, so nothing is
lost. Phase 3: vectors whose sent scores plus cutoff / NODES for each node that was silent stay below the cutoff go, and the others'
scores are resolved from their whole vectors.

Vectors and queries travel as packed blocks. A cell is a strip (some blocks of vectors) with a part (some blocks of queries),
for a node or for whole vectors. Its rows are shuffled to one task in the order in which it reads them: the vectors, which it
keeps, then each block of queries with the cutoffs and entries that belong to it, which pass by. No step joins blocks, so none
of them can become a broadcast, and a block is copied once for each strip or part and not for each block of the other side.
Bounds are compared as whole numbers (NODES * partial >= cutoff).

Defined cases: null ids, null or empty vectors, and null or non-finite components take no part; equal ids count once (least
vector); shorter vectors are filled with zeros; ties go to the smaller vec_id; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenhand.llm import vectors as vec
from evenhand.llm.catalog import register
from evenhand.llm.common import give_back, read, written

NODES = 2
K = 20
# Blocks of vectors in a strip, and blocks of queries in a part.
STRIP_CHUNKS = 16
PART_GROUPS = 16
# Queries whose scores are made at a time.
TILE_QUERIES = 256
# Vectors whose best scores are sorted before others are held against them.
FIRST = 512
# A pair by itself costs as much as so many among all pairs of two blocks.
DENSE = 100
# Candidates of a block of queries after which only the best are kept.
HELD = 1 << 20
EXACT = 2.0**53
EXACT_FLOAT = 2.0**24
NONE = -(2.0**62)

# What the rows of a cell hold.
VECTORS, QUERIES, CUTOFFS, ENTRIES = range(4)
CELL = "strip int, part int, num int, kind int, at int, slice int, a binary, b binary"
LIMITS = "array<struct<query_id:bigint,cutoff:bigint>>"
LIST = f"query_id long, part int, {vec.TOP.format(kind='long')}"


class _Block:
    """Vectors of a cell in the order of their blocks; a node's cell has one slice of them, a whole one all slices."""

    def __init__(self, rows: Iterable[dict], cuts: list[int]):
        parts: dict[int, list[np.ndarray]] = {}
        ids: dict[int, list[np.ndarray]] = {}
        for get in rows:
            at, own = get["slice"].as_py(), np.frombuffer(get["a"].as_buffer(), np.int64)
            ids.setdefault(at, []).append(own)
            parts.setdefault(at, []).append(vec.spread(get["b"].as_buffer(), len(own) * (cuts[at + 1] - cuts[at])).reshape(len(own), -1))
        first = next(iter(ids.values()))
        self.ids = np.concatenate(first)
        self.edges = np.cumsum([0, *map(len, first)]).tolist()
        self.values = np.hstack([np.vstack(parts[at]) for at in sorted(parts)])
        self.whole = self.values.dtype.kind == "i"
        self.most = max(abs(float(self.values.min(initial=0))), abs(float(self.values.max(initial=0))))
        self._as: dict[type, np.ndarray] = {}

    def matrix(self, kind: type) -> np.ndarray:
        if kind not in self._as:
            self._as[kind] = np.ascontiguousarray(self.values, kind)
        return self._as[kind]


def _kind(q: _Block, c: _Block) -> type:
    """The type that holds whole-number inner products: floats up to 2^24, doubles up to 2^53, beyond that 64-bit integers."""
    bound = q.most * c.most * q.values.shape[1]
    return np.float32 if bound < EXACT_FLOAT and q.whole and c.whole else np.float64 if bound < EXACT else np.int64


def _scorer(q: _Block, c: _Block, most: int) -> Callable[[int, int, int, int], np.ndarray]:
    """Scores of queries x to y with vectors a to b (at most ``most``), valid until the next. A query's own is NONE."""
    kind = _kind(q, c)
    left, right = q.matrix(kind), c.matrix(kind)
    order = np.argsort(c.ids)
    at = np.minimum(np.searchsorted(c.ids, q.ids, sorter=order), len(order) - 1)
    own_i = np.flatnonzero(c.ids[order[at]] == q.ids)
    own_j = order[at[own_i]]
    room = np.empty(min(len(left), TILE_QUERIES) * most, kind)

    def score(x: int, y: int, a: int, b: int) -> np.ndarray:
        s = np.matmul(left[x:y], right[a:b].T, out=room[: (y - x) * (b - a)].reshape(y - x, b - a))
        here = (own_i >= x) & (own_i < y) & (own_j >= a) & (own_j < b)
        s[own_i[here] - x, own_j[here] - a] = NONE
        return s

    return score


def _steps(rows: int) -> Iterator[tuple[int, int]]:
    """Queries whose scores with a block of vectors stay in a processor's cache."""
    return ((x, min(x + TILE_QUERIES, rows)) for x in range(0, rows, TILE_QUERIES))


def _places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that are set in a mask of which little is set."""
    flat = hit.reshape(-1)
    n = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:n].view(np.uint64))
    near = np.flatnonzero(flat[:n].reshape(-1, 8)[words])
    found = np.concatenate([words[near >> 3] * 8 + (near & 7), n + np.flatnonzero(flat[n:])])
    i = found // hit.shape[1]
    return i, found - i * hit.shape[1]


def _highest(i: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k`` highest scores of each query are."""
    order = np.lexsort((-scores, i))
    index = i[order]
    return order[np.arange(len(index)) - np.searchsorted(index, index, side="left") < k]


def _pairs(q: _Block, c: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of row i of ``q`` with row j of ``c``, pair by pair."""
    out, kind = np.empty(len(i), np.int64), _kind(q, c)
    left, right = q.matrix(kind), c.matrix(kind)
    for a in range(0, len(i), 1 << 13):
        out[a : a + (1 << 13)] = np.einsum("ij,ij->i", left[i[a : a + (1 << 13)]], right[j[a : a + (1 << 13)]])
    return out


def _chosen(q: _Block, c: _Block, i: np.ndarray, j: np.ndarray, a: int, b: int, room: list[np.ndarray]) -> np.ndarray:
    """Inner products of some queries with some of the vectors from ``a`` to ``b``: pair by pair, or out of the scores of all if many are asked for."""
    if len(i) * DENSE < len(q.ids) * (b - a):
        return _pairs(q, c, i, j)
    kind = _kind(q, c)
    if not room:
        room.append(np.empty(len(q.ids) * max(y - x for x, y in pairwise(c.edges)), kind))
    s = np.matmul(q.matrix(kind), c.matrix(kind)[a:b].T, out=room[0][: len(q.ids) * (b - a)].reshape(len(q.ids), b - a))
    return s[i, j - a].astype(np.int64)


def _base(cutoff: np.ndarray, nodes: int) -> np.ndarray:
    """What is taken off small partial scores before they are sent: the least that is sent, as far as floats hold it."""
    return np.clip(-(-cutoff // nodes), int(-EXACT_FLOAT), int(EXACT_FLOAT))


def _planes(values: np.ndarray) -> bytes:
    """Small whole numbers as bytes: all lowest bytes, then all second ones, and so on, so that zeros lie together."""
    return np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(4, -1).T).view("<i4").reshape(-1)


def _slack(*values: np.ndarray) -> float:
    """How far bounds are lowered: 0 while doubles hold all values exactly."""
    most = max(float(np.abs(v[np.abs(v) < -NONE]).max(initial=0)) for v in values)
    return 0.0 if most < EXACT else most * 2.0**-48


def _visits(batches: Iterable[pa.RecordBatch], cuts: list[int], sliced: bool) -> Iterator[tuple[dict, _Block, _Block, Iterator[tuple[int, Iterator[dict]]]]]:
    """For every block of queries of every cell: its first row, the queries, the vectors, and what else it brings, by kind."""
    rows = ({n: column[row] for n, column in zip(batch.schema.names, batch.columns)} for batch in batches for row in range(batch.num_rows))
    for _, cell in groupby(rows, lambda get: (get["strip"], get["part"], get["slice"] if sliced else None)):
        vectors = None
        for number, block in groupby(cell, lambda get: -1 if get["kind"].as_py() == VECTORS else get["num"].as_py()):
            if number < 0:
                vectors = _Block(block, cuts)
                continue
            kinds = groupby(block, lambda get: get["kind"].as_py())
            kind, found = next(kinds)
            if vectors is not None and kind == QUERIES:
                found = list(found)
                yield found[0], _Block(found, cuts), vectors, ((kind, more) for kind, more in kinds)


def _entry(get: dict, at: int, picks: bytes, partial: bytes) -> pa.RecordBatch:
    numbers = {n: get[n].as_py() for n in ("strip", "part", "num")} | {"kind": ENTRIES, "at": at, "slice": get["slice"].as_py()}
    return pa.RecordBatch.from_pydict({n: pa.array([v], pa.int32()) for n, v in numbers.items()} | {"a": pa.array([picks], pa.binary()), "b": pa.array([partial], pa.binary())})


def _local_lists(k: int, cuts: list[int]) -> Callable:
    """Phase 1: where each query's ``k`` highest partial scores are in the strip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for get, q, c, _ in _visits(batches, cuts, True):
            n, last = min(k, len(c.ids)), len(c.ids)
            first = min(max(n, FIRST), last)
            ends = sorted({0, first, *(min(first << s, last) for s in (1, 2)), *(e for e in c.edges if e > 4 * first), last})
            score = _scorer(q, c, max(b - a for a, b in pairwise(ends)))
            picks = [_highest_of(score, x, y, ends, n) for x, y in _steps(len(q.ids))]
            yield _entry(get, 0, np.concatenate(picks).astype(np.int32).tobytes(), b"")
        give_back()

    return run


def _highest_of(score: Callable, x: int, y: int, ends: list[int], n: int) -> np.ndarray:
    """Where the ``n`` highest scores of queries x to y are. What is not above the least of those held so far is passed over."""
    s = score(x, y, 0, ends[1])
    best = np.argpartition(-s, n - 1, axis=1)[:, :n]
    scores = np.take_along_axis(s, best, 1)
    least = scores.min(axis=1)
    i = np.repeat(np.arange(y - x), n)
    more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in pairwise(ends[1:]):
        s = score(x, y, a, b)
        row, column = _places(s > least[:, None])
        more.append((row, column + a, s[row, column]))
        if sum(len(m[0]) for m in more) > best.size or b == ends[-1]:
            rows, columns, values = (np.concatenate(m) for m in zip((i, best.reshape(-1), scores.reshape(-1)), *more))
            kept = _highest(rows, values, n)
            best, scores = columns[kept].reshape(-1, n), values[kept].reshape(-1, n)
            least, more = scores[:, -1], []
    return best


def _cutoffs(kinds: Iterable[tuple[int, Iterator[dict]]], query_ids: np.ndarray) -> Iterator[tuple[np.ndarray, Iterator[dict]]]:
    """The cutoffs in the order of the queries, and the entries behind them; without one (fewer candidates than k) everything passes."""
    out = np.full(len(query_ids), int(NONE), np.int64)
    for kind, rows in kinds:
        if kind == ENTRIES:
            yield out, rows
            return
        for get in rows:
            entries = get["cutoffs"].values
            out[np.searchsorted(query_ids, entries.field("query_id").to_numpy())] = entries.field("cutoff").to_numpy()
    yield out, iter(())


def _above(nodes: int, cuts: list[int]) -> Callable:
    """Phase 2: the vectors whose partial score is at least cutoff / nodes, and these scores, for each block of the strip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for get, q, c, kinds in _visits(batches, cuts, True):
            cutoff, _ = next(_cutoffs(kinds, q.ids))
            kind, score = _kind(q, c), _scorer(q, c, max(b - a for a, b in pairwise(c.edges)))
            plain = q.whole and c.whole and kind is not np.int64
            least = (-(-cutoff // nodes)).astype(kind)[:, None] if plain else None
            for at, (a, b) in enumerate(pairwise(c.edges)):
                found = []
                for x, y in _steps(len(q.ids)):
                    s = score(x, y, a, b)
                    if plain:
                        hit = s >= least[x:y]
                    else:
                        s, bound = s.astype(np.float64), cutoff[x:y].astype(np.float64)
                        hit = (nodes * s >= bound[:, None] - _slack(nodes * s, bound)) & (s > NONE)
                    i, j = _places(hit)
                    found.append((i + x, j, s[i, j]))
                i, j, s = (np.concatenate(f) for f in zip(*found))
                if len(i):
                    small = kind is np.float32
                    partial = b"\1" + _planes(s.astype(np.int64) - _base(cutoff, nodes)[i]) if small else b"\0" + vec.shrunk(s)
                    yield _entry(get, at, _planes(np.diff(i * (b - a) + j, prepend=0)), partial)
        give_back()

    return run


def _listed(rows: Iterator[dict], q: _Block, c: _Block, nodes: int, cutoff: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Queries and vectors that nodes have listed, and between which vectors these lie."""
    flat = []
    for get in rows:
        picks = np.frombuffer(get["a"].as_buffer(), np.int32).reshape(len(q.ids), -1)
        flat.append((picks + np.arange(len(q.ids))[:, None] * len(c.ids)).reshape(-1))
    if flat:
        pairs = np.unique(np.concatenate(flat))
        yield pairs // len(c.ids), pairs % len(c.ids), 0, len(c.ids)


def _sent(rows: Iterator[dict], q: _Block, c: _Block, nodes: int, cutoff: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Queries and vectors that nodes have sent and whose sent scores with cutoff / nodes from silent nodes may reach the cutoff, block by block."""
    for at, block in groupby(rows, lambda get: get["at"].as_py()):
        a, size = c.edges[at], c.edges[at + 1] - c.edges[at]
        picks, partial = [], []
        for get in block:
            found, scores = _read(get["a"], get["b"], size, _base(cutoff, nodes))
            picks.append(found)
            partial.append(scores)
        every = np.concatenate(picks)
        order = np.argsort(every, kind="stable")  # the lists ascend, so this merges them
        every, sums = every[order], np.concatenate(partial)[order]
        first = np.flatnonzero(np.diff(every, prepend=-1))
        flat, total, seen = every[first], np.add.reduceat(sums, first), np.diff(first, append=len(every))
        i, j = flat // size, flat % size
        least = cutoff[i].astype(np.float64)
        # In multiples of 1 / nodes all bounds are whole numbers.
        possible = nodes * total + (nodes - seen) * least >= nodes * least - _slack(nodes * total, nodes * least)
        yield i[possible], j[possible] + a, a, a + size


def _read(picks: pa.Scalar, partial: pa.Scalar, size: int, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a node has sent: places among the pairs of two blocks, ascending, and partial scores."""
    places = np.cumsum(_unplaned(np.frombuffer(picks.as_buffer(), np.uint8)), dtype=np.int64)
    data = partial.as_buffer()
    if data[0:1].to_pybytes() == b"\1":
        return places, (_unplaned(np.frombuffer(data, np.uint8, offset=1)) + base[places // size]).astype(np.float64)
    return places, vec.spread(data[1:], len(places)).astype(np.float64)


def _resolve(k: int, nodes: int, cuts: list[int], listed: bool) -> Callable:
    """Whole scores of the vectors that the nodes listed (phase 1) or sent (phase 3), and each query's k best of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for get, q, c, kinds in _visits(batches, cuts, False):
            cutoff, entries = next(_cutoffs(kinds, q.ids))
            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            room: list[np.ndarray] = []
            for i, j, a, b in (_listed if listed else _sent)(entries, q, c, nodes, cutoff):
                scores = _pairs(q, c, i, j) if listed else _chosen(q, c, i, j, a, b, room)
                best = (c.ids[j] != q.ids[i]) & (scores >= cutoff[i])
                held.append((i[best], c.ids[j[best]], scores[best]))
                if sum(len(x[0]) for x in held) > HELD:
                    i, ids, scores = (np.concatenate(x) for x in zip(*held))
                    order = np.lexsort((ids, -scores, i))
                    kept = order[np.arange(len(i)) - np.searchsorted(i[order], i[order], side="left") < k]
                    held = [(i[kept], ids[kept], scores[kept])]
            i, ids, scores = (np.concatenate(x) for x in zip(*held))
            if len(i):
                yield from vec.top_lists(q.ids, i, ids, scores, k, get["strip"].as_py(), "long")
        give_back()

    return run


def top_k(rows: DataFrame, queries: Column, k: int = K, nodes: int = NODES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest inner products of every query, exactly: rows (query_id, rank, vec_id, score).

    ``queries`` is a condition on the column vec_id. Components are whole numbers.
    """
    rows = written(vec.valid_vectors(rows, id_col, vector_col))
    n, n_queries, width = vec.shape_of(rows, queries)
    strips = vec.parts_for(vec.parts_for(n, vec.CHUNK_ROWS), STRIP_CHUNKS)
    groups = vec.parts_for(n_queries, vec.GROUP_ROWS)
    # A small table has few strips; then there are more parts, so that all tasks have something to do.
    wanted = vec.parts_for(rows.sparkSession.sparkContext.defaultParallelism, strips)
    parts = max(vec.parts_for(groups, PART_GROUPS), min(groups, wanted))
    nodes = max(1, min(nodes, width))
    cuts = vec.slices_of(width, nodes)
    candidates = rows.withColumn("num", vec.part_of(F.col("vec_id"), n, vec.CHUNK_ROWS))
    group = vec.part_of(F.concat(F.lit("q"), F.col("vec_id").cast("string")), n_queries, vec.GROUP_ROWS)
    vectors = written(vec.pack(candidates, ["num"], width, nodes, shrink=True))
    asked = written(vec.pack(rows.where(queries).withColumn("num", group), ["num"], width, nodes, shrink=True))

    def every(number: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(number - 1)))

    def part_of(number: str, among: int) -> Column:
        return F.pmod(F.col(number), F.lit(among)).cast("int")

    def row(df: DataFrame, kind: int) -> DataFrame:
        return df.withColumn("kind", F.lit(kind)).withColumn("at", F.lit(0))

    def cells(sliced: bool, bounds: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
        """The rows of every strip with every part, for each slice of the components or for whole vectors, in the order of ``_visits``."""
        kinds = [
            row(vectors.withColumn("strip", part_of("num", strips)).withColumn("part", every(parts)), VECTORS),
            row(asked.withColumn("part", part_of("num", parts)).withColumn("strip", every(strips)), QUERIES),
        ]
        kinds = [x.withColumnsRenamed({"ids": "a", "vals": "b"}) for x in kinds] + ([entries] if entries is not None else [])
        kinds = [x.withColumn("cutoffs", F.lit(None).cast(LIMITS)) for x in kinds]
        if bounds is not None:
            spread = bounds.withColumn("part", part_of("num", parts)).withColumn("strip", every(strips)).withColumn("slice", every(nodes))
            kinds.append(row(spread.withColumn("a", F.lit(None).cast("binary")).withColumn("b", F.lit(None).cast("binary")), CUTOFFS))
        names = [*(x.split()[0] for x in CELL.split(", ")), "cutoffs"]
        found = reduce(DataFrame.unionAll, [x.select(*names) for x in kinds])
        key = ["strip", "part", "slice"] if sliced else ["strip", "part"]
        number = F.col("strip").cast("long") * parts + F.col("part")
        number = number * nodes + F.col("slice") if sliced else number
        tasks = min(strips * parts * (nodes if sliced else 1), 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = found.repartitionById(tasks, F.pmod(number, F.lit(tasks)).cast("int"))
        return dealt.sortWithinPartitions(*key, F.col("kind") != VECTORS, "num", "kind", "at", "slice")

    listed = cells(True).mapInArrow(_local_lists(k, cuts), CELL)
    tops = cells(False, entries=listed).mapInArrow(_resolve(k, nodes, cuts, True), LIST)
    bounds = vec.merge_top(tops, strips, k).where(F.size("top") == k).select(F.col("query_id").alias("vec_id"), (-F.element_at("top", -1)["key"]).alias("cutoff"))
    bounds = bounds.select(group.alias("num"), F.col("vec_id").alias("query_id"), "cutoff")
    bounds = written(bounds.groupBy("num").agg(F.collect_list(F.struct("query_id", "cutoff")).alias("cutoffs")))
    sent = cells(True, bounds).mapInArrow(_above(nodes, cuts), CELL)
    found = cells(False, bounds, sent).mapInArrow(_resolve(k, nodes, cuts, False), LIST)
    return vec.ranked(vec.merge_top(found, strips, k), "long")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs) WHERE rank <= 20
"""


@register("op9_uniform_topk", ORACLE)
def uniform_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.floor(x * 64)))
    return top_k(rows.withColumn("embedding", whole), F.col("vec_id") % 20 == 0)
