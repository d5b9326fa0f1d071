"""Vectors in packed blocks: a block is one row that holds the ids and the components of some thousand vectors.

Searches compare a block of queries with a block of candidates, so that no pair of vectors is ever a row. Every block is
bounded by its parameter, whatever the size or the skew of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

CHUNK_ROWS = 4096
GROUP_ROWS = 1024
FAN_IN = 32
TOP = "top array<struct<key:{kind},vec_id:long>>"


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """One row (vec_id, v) for each id: vectors that are null, empty, or hold null or non-finite components, and null ids, go.

    Of several vectors with one id the least in array order stays.
    """
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad)
    return kept.groupBy("vec_id").agg(F.min("v").alias("v"))


def shape_of(rows: DataFrame, queries: Column) -> tuple[int, int, int]:
    """Number of vectors, number of queries, components of the longest vector (shorter ones are filled with zeros)."""
    found = rows.agg(F.count("*"), F.count_if(queries), F.max(F.size("v"))).first()
    return found[0], found[1], found[2] or 0


def part_of(key: Column, rows: int, size: int) -> Column:
    """A number of a part, such that parts hold about ``size`` of ``rows``."""
    return F.pmod(F.xxhash64(key), F.lit(parts_for(rows, size))).cast("int")


def parts_for(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def matrix(column: pa.Array, width: int, dtype: str = "float64") -> np.ndarray:
    """A list column as a matrix; short lists are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return np.ascontiguousarray(flat.reshape(-1, width), dtype)
    out = np.zeros((len(lengths), width), dtype)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = flat
    return out


def slices_of(width: int, blocks: int) -> list[int]:
    """Where the slices of the components begin and end."""
    return np.linspace(0, width, blocks + 1).astype(int).tolist()


def shrunk(values: np.ndarray) -> bytes:
    """The values in the smallest type that holds them exactly: whole numbers of 1, 2 or 4 bytes, else doubles."""
    low, high = values.min(initial=0), values.max(initial=0)
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            small = values.astype(kind)
            if (small == values).all():
                return small.tobytes()
            break
    return values.astype(np.float64).tobytes()


def spread(data: pa.Buffer, count: int) -> np.ndarray:
    """The ``count`` values that ``shrunk`` has written."""
    return np.frombuffer(data, {1: np.int8, 2: np.int16, 4: np.int32}.get(len(data) // max(1, count), np.float64))


def pack(rows: DataFrame, keys: Sequence[str], width: int, blocks: int = 1, shrink: bool = False) -> DataFrame:
    """Rows (keys..., vec_id, v) to one row for each key and slice of the components: keys..., slice, ids, vals.

    ids ascend; vals is the matrix of that slice in row order, as doubles, or with ``shrink`` in the smallest type (``shrunk``).
    """
    cuts = slices_of(width, blocks)
    write = shrunk if shrink else np.ndarray.tobytes
    schema = ", ".join(f"{k} int" for k in keys) + ", slice int, ids binary, vals binary"

    def to_block(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table["vec_id"])
        table = table.take(order)
        values = matrix(table["v"], width)
        ids = table["vec_id"].to_numpy().astype("int64").tobytes()
        out = {k: pa.array([table[k][0].as_py()] * blocks, pa.int32()) for k in keys}
        out["slice"] = pa.array(range(blocks), pa.int32())
        out["ids"] = pa.array([ids] * blocks, pa.binary())
        out["vals"] = pa.array([write(np.ascontiguousarray(values[:, a:b])) for a, b in zip(cuts, cuts[1:])], pa.binary())
        return pa.table(out)

    return rows.select(*keys, "vec_id", "v").groupBy(*keys).applyInArrow(to_block, schema)


def unpack(ids: pa.Scalar, vals: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids.as_buffer(), np.int64)
    return numbers, np.frombuffer(vals.as_buffer(), np.float64).reshape(len(numbers), -1)


def mask_own(scores: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, value: float) -> None:
    """Set the score of each query with itself. Both lists of ids ascend."""
    at = np.searchsorted(ids, query_ids)
    own = np.flatnonzero(at < len(ids))
    own = own[ids[at[own]] == query_ids[own]]
    scores[own, at[own]] = value


def top_lists(query_ids: np.ndarray, query_index: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, part: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows (query_id, part, top) from pairs: for every query its ``k`` highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query_index))
    index, ids, scores = query_index[order], ids[order], scores[order]
    first = np.searchsorted(index, index, side="left")
    kept = np.arange(len(index)) - first < k
    index, ids, scores = index[kept], ids[kept], scores[kept]
    found, counts = np.unique(index, return_counts=True)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    dtype = pa.float64() if kind == "double" else pa.int64()
    entries = pa.StructArray.from_arrays([pa.array(-scores, dtype), pa.array(ids, pa.int64())], ["key", "vec_id"])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
    yield pa.RecordBatch.from_arrays([pa.array(query_ids[found], pa.int64()), pa.array(np.full(len(found), part), pa.int32()), lists], ["query_id", "part", "top"])


def merge_top(lists: DataFrame, parts: int, k: int, distinct: bool = False) -> DataFrame:
    """Rows (query_id, part, top) to one (query_id, top) for each query: the ``k`` least keys, ties to the smaller id.

    At most ``FAN_IN`` lists meet in one row; as many rounds follow as the number of parts takes.
    """

    def of(found: Column) -> Column:
        joined = F.flatten(F.collect_list(found))
        return F.slice(F.array_sort(F.array_distinct(joined) if distinct else joined), 1, k)

    while parts > FAN_IN:
        parts = math.ceil(parts / FAN_IN)
        lists = lists.groupBy("query_id", F.floor(F.col("part") / FAN_IN).cast("int").alias("part")).agg(of(F.col("top")).alias("top"))
    return lists.groupBy("query_id").agg(of(F.col("top")).alias("top"))


def ranked(tops: DataFrame, kind: str) -> DataFrame:
    """(query_id, top) to rows (query_id, rank, vec_id, score)."""
    rows = tops.select("query_id", F.posexplode("top").alias("pos", "entry"))
    return rows.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("entry.vec_id").alias("vec_id"), (-F.col("entry.key")).cast(kind).alias("score"))
