"""Hard negatives by lists that the anchors of a cluster share.

Of each anchor's ``positives`` nearest rows with its own label (largest inner product), each is a positive; its hard negatives are the first
``negatives`` rows of another label whose score lies between ``low`` and ``high`` percent of the positive's score.

1. Clusters. Spherical k-means on at most ``SAMPLE`` anchors (least hash of the id) gives ``CLUSTERS`` directions; every anchor joins the nearest. A cluster's
   radius is the largest angle between its direction and one of all its anchors.
2. Lists. A row x at the angle t from a cluster's direction has at most |x| cos(max(0, t - radius)) as inner product with any unit vector of the
   cluster. That bound orders all rows, once for each cluster. The list is cut at the bounds of its first ``SHARES`` (found over all rows), so that
   a list is a few parts in descending order; each part is dealt out in chunks of ``BLOCK_BYTES`` by a hash of the ids.
3. Walks. All anchors of a cluster walk its list part by part. Each keeps the best rows that it wants; it is done as soon as |anchor| times the bound that
   the next part begins with is below the last of them, or below the lowest score that it wants: nothing that follows can change its result. Who is not done walks on,
   in the worst case to the end, so results are exact however poor the bounds are.
4. The first walk is for positives, the second, with the windows that their scores give, for negatives.

A task holds one block of a cluster's anchors and one chunk of a part, both bounded in bytes; no pair of vectors is a row. What reaches the driver are the
sample, the directions and counts for each cluster and part. State is a written table after every part.

Defined cases: null ids, null labels, null or empty vectors, and null or non-finite components take no part; of rows with one id the least (label,
vector) counts; shorter vectors are filled with zeros; ties go to the smaller vec_id; fewer rows than asked give fewer; a positive with a negative score has no
negatives, as its window is empty. Labels and components are whole numbers; scores are exact while they and their parts are below 2^63.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenhand.llm import vectors as vec
from evenhand.llm.catalog import register
from evenhand.llm.common import read, written

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
CLUSTERS = 8
SAMPLE = 4096
ITERATIONS = 12
SEED = 5
# Parts of a list end at these shares of it; the last part is the rest.
SHARES = (1 / 32, 1 / 4)
BLOCK_BYTES = 2 << 20
# Products of a strip of anchors and a chunk that are held at once.
PRODUCTS = 1 << 20
FAN_IN = 32
EXACT = 2.0**53
# Relative slack of the bounds, far above what rounding of angles and products can take.
SLACK = 1e-6
LEAST, MOST = -(2**63) + 1, 2**63 - 1
BEST = "array<struct<key:long,vec_id:long>>"
ROW = "vec_id long, label long, vals binary, norm double"


def _binary(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    offsets = (np.arange(len(values) + 1) * values.shape[1] * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat = np.frombuffer(column.buffers()[2], np.float64, (column.offset + len(column)) * width)
    return flat.reshape(-1, width)[column.offset :]


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def valid_rows(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """One row (vec_id, label, v) for each id that takes part."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    kept = kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~bad)
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")


def _packed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = vec.matrix(batch.column("v"), width)
            norm = np.linalg.norm(values, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _binary(values), pa.array(norm)], ["vec_id", "label", "vals", "norm"])

    return run


def directions(sample: np.ndarray, clusters: int = CLUSTERS) -> np.ndarray:
    """Spherical k-means: unit vectors, as rows; fewer if the sample has fewer different directions."""
    points = np.unique(_unit(sample), axis=0)
    points = points[np.abs(points).sum(axis=1) > 0]
    if not len(points):
        return np.eye(1, sample.shape[1])
    rng = np.random.default_rng(SEED)
    centres = points[rng.choice(len(points), min(clusters, len(points)), replace=False)]
    for _ in range(ITERATIONS):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        moved = _unit(sums)
        centres = np.where(np.abs(moved).sum(axis=1, keepdims=True) > 0, moved, centres)
    return centres


def _angles(values: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(values) @ centres.T, -1.0, 1.0))


def _assign(centres: np.ndarray, width: int):
    """Anchors to their cluster and their angle from its direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = _angles(_matrix(batch.column("vals"), width), centres)
            cluster = angles.argmin(axis=1)
            least = np.where(batch.column("norm").to_numpy() > 0, angles.min(axis=1), 0.0)  # zeros score 0 with every row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32()), pa.array(least)], [*batch.schema.names, "cluster", "angle"])

    return run


def _bound(centres: np.ndarray, radius: np.ndarray, width: int):
    """Rows with the upper bound of their product with a unit vector of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = _angles(_matrix(batch.column("vals"), width), centres)
            norm = batch.column("norm").to_numpy()[:, None]
            bounds = norm * np.cos(np.maximum(angles - radius, 0.0)) + SLACK * norm
            offsets = np.arange(len(bounds) + 1, dtype=np.int32) * bounds.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bounds.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "bounds"])

    return run


@dataclass
class Lists:
    """The clusters' lists: rows with their bounds, the bounds at which parts end, and how many rows each part has."""

    rows: DataFrame
    borders: dict[int, list[float]]
    sizes: dict[int, list[int]]

    @classmethod
    def of(cls, rows: DataFrame, clusters: Sequence[int], shares: Sequence[float]) -> Lists:
        points = [1.0 - s for s in shares]
        if not points:
            borders = {c: [] for c in clusters}
        else:
            found = rows.agg(*[F.percentile_approx(F.col("bounds")[c], points).alias(f"c{c}") for c in clusters]).first()
            borders = {c: sorted(set(found[f"c{c}"]), reverse=True) for c in clusters}
            borders = {c: b + [b[-1]] * (len(points) - len(b)) for c, b in borders.items()}
        lists = cls(rows, borders, {})
        counts = rows.agg(*[F.count_if(lists.part(c) == k).alias(f"c{c}_{k}") for c in clusters for k in range(len(points) + 1)]).first()
        lists.sizes = {c: [counts[f"c{c}_{k}"] for k in range(len(points) + 1)] for c in clusters}
        return lists

    def part(self, cluster: int) -> Column:
        """The number of the part of this cluster's list that a row is in."""
        return sum([(F.col("bounds")[cluster] < b).cast("int") for b in self.borders[cluster]], F.lit(0))

    @property
    def parts(self) -> int:
        return 1 + max(len(b) for b in self.borders.values())


def _score(width: int, k: int, same: bool):
    """The ``k`` best rows of a chunk for each anchor and each window that it wants: (query_id, slot, part, best)."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and anchors.num_rows:
            rows = rows.sort_by("vec_id")
            ids, labels, c = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["vals"], width)
            queries, own, q = anchors["query_id"].to_numpy(), anchors["label"].to_numpy(), _matrix(anchors["vals"], width)
            wanted = anchors["wanted"].combine_chunks()
            wanted = wanted.chunk(0) if isinstance(wanted, pa.ChunkedArray) else wanted
            at = np.repeat(np.arange(len(queries)), wanted.value_lengths().to_numpy(zero_copy_only=False))
            slots, lows, highs = (wanted.flatten().field(f).to_numpy() for f in ("slot", "low", "high"))
            whole = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * width >= EXACT
            each = max(1, PRODUCTS // len(ids))
            for first in range(0, len(queries), each):
                strip = slice(first, first + each)
                s = q[strip].astype(np.int64) @ c.astype(np.int64).T if whole else (q[strip] @ c.T).astype(np.int64)
                alike = own[strip, None] == labels
                usable = alike & (queries[strip, None] != ids) if same else ~alike
                mine = np.flatnonzero((at >= first) & (at < first + each))
                for slot in np.unique(slots[mine]):
                    w = mine[slots[mine] == slot]
                    row = at[w] - first
                    out.append((*_best(s[row], usable[row], lows[w], highs[w], ids, k), queries[at[w]], np.full(len(w), slot)))
        return _lists(out, int(rows["chunk"][0].as_py()) if rows.num_rows else 0)

    return run


def _best(s: np.ndarray, usable: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """For each row of ``s``: number of entries, and one after the other their scores and ids, best first."""
    fits = usable & (s >= low[:, None]) & (s <= high[:, None])
    if np.count_nonzero(fits) > 16 * k * len(s) and s.shape[1] > k:
        held = np.where(fits, s, LEAST - 1)
        fits &= s >= np.partition(held, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    i, j = np.nonzero(fits)  # ids ascend within a row
    order = np.lexsort((j, -s[i, j], i))
    i, j = i[order], j[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    i, j = i[kept], j[kept]
    return np.bincount(i, minlength=len(s)), s[i, j], ids[j]


def _lists(out: list[tuple[np.ndarray, ...]], part: int) -> pa.Table:
    n, scores, ids, queries, slots = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 5
    entries = pa.StructArray.from_arrays([pa.array(-scores, pa.int64()), pa.array(ids, pa.int64())], ["key", "vec_id"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), entries)
    table = pa.table({"query_id": pa.array(queries, pa.int64()), "slot": pa.array(slots, pa.int32()), "part": pa.array(np.full(len(n), part), pa.int32()), "best": lists})
    return table.filter(pa.array(n > 0))


def _merged(lists: DataFrame, parts: int, k: int) -> DataFrame:
    """The ``k`` best entries of each (query_id, slot); at most ``FAN_IN`` lists meet in one row."""
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    while parts > FAN_IN:
        parts = math.ceil(parts / FAN_IN)
        lists = lists.groupBy("query_id", "slot", F.floor(F.col("part") / FAN_IN).cast("int").alias("part")).agg(best)
    return lists.groupBy("query_id", "slot").agg(best.alias("found"))


def walk(lists: Lists, anchors: DataFrame, wanted: DataFrame, k: int, same: bool, width: int) -> DataFrame:
    """The ``k`` best rows of each (query_id, slot, low, high) of ``wanted``: its columns with ``best``, ``walked`` (parts) and ``open``.

    same: rows of the anchor's label except itself, else rows of other labels.
    """
    each = max(64, BLOCK_BYTES // (8 * width))
    state = wanted.select("query_id", "slot", "low", "high", F.array().cast(BEST).alias("best"), F.lit(0).alias("walked"), (F.col("low") <= F.col("high")).alias("open"))
    state = written(state.join(anchors.select(F.col("vec_id").alias("query_id"), "cluster", "norm"), "query_id"))
    for part in range(lists.parts):
        # A row for each cluster.
        walking = {r["cluster"]: r["n"] for r in state.where("open").groupBy("cluster").agg(F.count_distinct("query_id").alias("n")).collect()}
        walking = {c: n for c, n in walking.items() if lists.sizes[c][part]}
        groups = {c: math.ceil(n / each) for c, n in walking.items()}
        chunks = {c: math.ceil(lists.sizes[c][part] / each) for c in walking}
        last = F.when(F.size("best") == k, -F.element_at("best", -1)["key"])
        if walking:
            want = state.where("open").withColumn("floor", F.greatest("low", F.coalesce(last, F.col("low"))))
            want = want.groupBy("query_id").agg(F.collect_list(F.struct("slot", F.col("floor").alias("low"), "high")).alias("wanted"))
            of = lambda counts: F.element_at(F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]), F.col("cluster"))
            asking = anchors.where(F.col("cluster").isin(list(walking))).join(want.withColumnRenamed("query_id", "vec_id"), "vec_id")
            asking = asking.select("cluster", F.pmod(F.xxhash64(F.lit(1), "vec_id"), of(groups)).cast("int").alias("grp"), F.col("vec_id").alias("query_id"), "label", "vals", "wanted")
            asking = asking.withColumn("chunk", F.explode(F.sequence(F.lit(0), of(chunks) - 1)))
            cells = [F.when(lists.part(c) == part, F.struct(F.lit(c).alias("cluster"), F.pmod(F.xxhash64("vec_id"), F.lit(chunks[c])).cast("int").alias("chunk"))) for c in walking]
            listed = lists.rows.select("vec_id", "label", "vals", F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("cell"))
            listed = listed.select("cell.cluster", "cell.chunk", "vec_id", "label", "vals")
            listed = listed.withColumn("grp", F.explode(F.sequence(F.lit(0), of(groups) - 1)))
            keys = ["cluster", "grp", "chunk"]
            found = listed.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(_score(width, k, same), f"query_id long, slot int, part int, best {BEST}")
            state = state.join(_merged(found, max(chunks.values()), k), ["query_id", "slot"], "left")
            state = state.withColumn("best", F.slice(F.array_sort(F.concat("best", F.coalesce("found", F.array().cast(BEST)))), 1, k)).drop("found")
        ended = part == lists.parts - 1
        border = F.lit(0.0) if ended else F.element_at(F.create_map(*[F.lit(x) for c, b in lists.borders.items() for x in (c, b[part])]), F.col("cluster"))
        reach = border * F.col("norm") + F.abs(border * F.col("norm")) * SLACK  # no row of a later part scores more
        floor = F.greatest("low", F.coalesce(last, F.col("low")))
        walked = F.when(F.col("open"), part + 1).otherwise(F.col("walked"))
        state = state.withColumns({"walked": walked, "open": F.col("open") & F.lit(not ended) & (reach >= floor)})
        state = written(state)
        if not walking and not state.where("open").limit(1).count():
            break
    return state


def mine(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    clusters: int = CLUSTERS, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is a condition on the column vec_id.
    """
    spark = rows.sparkSession
    rows = written(valid_rows(rows, id_col, label_col, vector_col))
    n, asked, width = vec.shape_of(rows, anchors)
    if not asked:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    packed = rows.mapInArrow(_packed(width), ROW)
    own = packed.where(anchors)
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(64, min(SAMPLE, (16 * BLOCK_BYTES) // (8 * width)))).toArrow()
    centres = directions(_matrix(sample["vals"], width), clusters)
    own = written(own.mapInArrow(_assign(centres, width), f"{ROW}, cluster int, angle double"))
    radius = {r["cluster"]: r["radius"] for r in own.groupBy("cluster").agg(F.max("angle").alias("radius")).collect()}
    angles = np.array([radius.get(c, 0.0) for c in range(len(centres))])
    bounded = written(packed.mapInArrow(_bound(centres, angles, width), f"{ROW}, bounds array<double>"))
    lists = Lists.of(bounded, sorted(radius), SHARES)

    anyone = own.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("slot"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    nearest = walk(lists, own, anyone, positives, True, width).select("query_id", F.posexplode("best").alias("slot", "entry"))
    nearest = nearest.select("query_id", "slot", F.col("entry.vec_id").alias("positive_id"), (-F.col("entry.key")).alias("positive_score"))
    exact = F.col("positive_score").cast("decimal(20,0)")
    nearest = written(nearest.withColumn("low", F.ceil(exact * low / 100).cast("long")).withColumn("high", F.floor(exact * high / 100).cast("long")))
    found = walk(lists, own, nearest.where("low <= high"), negatives, False, width)
    found = found.select("query_id", "slot", F.posexplode("best").alias("rank", "entry")).join(nearest, ["query_id", "slot"])
    return found.select(
        F.col("query_id").alias("anchor_id"), "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("entry.vec_id").alias("negative_id"),
        "positive_score", (-F.col("entry.key")).alias("negative_score"),
    )


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
pairs AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@register("op12_shared_lists", ORACLE)
def shared_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.floor(x * 256)))
    return mine(rows.withColumn("label", label).withColumn("embedding", whole), F.col("vec_id") % 100 == 0)
