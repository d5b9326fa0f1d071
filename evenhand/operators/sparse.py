"""Inputs with many categories as sparse rows, from the encoding to the fit and the score, with no category on the driver.

``x`` is a struct ``(idx ARRAY<INT>, val ARRAY<DOUBLE>)``: the places that are not 0, ascending, and their values. Numbers come first, standardised;
then a block for each category column, one place for every category but the first in sorted order. A place of a category holds one over its
spread, not centred: centring would fill every place of every row, and only shifts the scores by a constant, which a constant input takes up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evenhand.operators.prepare import moments_of
from evenhand.operators.ranks import dense_codes
from evenhand.operators.sizes import cut_lineage, small_side
from evenhand.operators.training import MAX_STEPS, TOLERANCE, Blocks, Fit, Sparse, fit_blocks

INPUTS = "struct<idx:array<int>,val:array<double>>"


@dataclass(frozen=True)
class Encoding:
    """How rows become sparse: the numbers' moments, and for each category column a table (category, place, scale) with its size."""

    numbers: dict[str, tuple[float, float]]
    categories: dict[str, tuple[DataFrame, int]]

    @property
    def width(self) -> int:
        return len(self.numbers) + sum(n for _, n in self.categories.values())


def encoding(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], fit_on: DataFrame | None = None) -> Encoding:
    """Categories are those of ``df``; moments and shares are those of ``fit_on`` (the training rows)."""
    fitted = df if fit_on is None else fit_on
    moments = moments_of(fitted, numbers).first()["moments"] if numbers else {}
    rows = fitted.count()
    tables, start = {}, len(numbers)
    for c in categories:
        codes = dense_codes(df, c)
        share = F.coalesce(F.col("_n"), F.lit(0)) / F.lit(float(max(rows, 1)))
        spread = F.sqrt(share * (1 - share))
        counted = codes.join(fitted.groupBy(c).agg(F.count("*").alias("_n")), c, "left")
        place = (F.col("code") + (start - 1)).cast("int")
        kept = counted.where("code > 0").select(c, place.alias("_place"), F.when(spread > 0, 1 / spread).otherwise(1.0).alias("_scale"))
        table = cut_lineage(kept)
        tables[c] = (table, table.count())
        start += tables[c][1]
    return Encoding({c: (float(moments[c]["mean"]), float(moments[c]["scale"])) for c in numbers}, tables)


def sparse_rows(df: DataFrame, coding: Encoding) -> DataFrame:
    """The rows with ``x`` in place of the encoded columns. Null and unknown categories, and null numbers, have no place."""
    for c, (table, _) in coding.categories.items():
        named = table.withColumnsRenamed({"_place": f"_place_{c}", "_scale": f"_scale_{c}"})
        df = df.join(small_side(named), c, "left")
    cells = [F.struct(F.lit(i).alias("idx"), ((F.col(c) - mean) / scale).alias("val")) for i, (c, (mean, scale)) in enumerate(coding.numbers.items())]
    cells += [F.struct(F.col(f"_place_{c}").alias("idx"), F.col(f"_scale_{c}").alias("val")) for c in coding.categories]
    there = F.filter(F.array(*cells), lambda cell: cell["idx"].isNotNull() & cell["val"].isNotNull() & (cell["val"] != 0))
    x = F.struct(F.transform(there, lambda cell: cell["idx"]).alias("idx"), F.transform(there, lambda cell: cell["val"]).alias("val"))
    helpers = [f"{p}_{c}" for c in coding.categories for p in ("_place", "_scale")]
    return df.withColumn("x", x).drop(*coding.numbers, *coding.categories, *helpers)


def _columns(batch: pa.RecordBatch) -> Sparse:
    """The inputs of a batch, the group as the last place."""
    x, a = batch.column("x"), batch.column("a").to_numpy(zero_copy_only=False).astype(float)
    lists = x.field("idx")
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    return Sparse(row, lists.flatten().to_numpy(zero_copy_only=False), x.field("val").flatten().to_numpy(zero_copy_only=False), a)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([_columns(batch).packed()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["grp", "z", "y"])


def fit_sparse(df: DataFrame, width: int, strength: float, anchor: Sequence[float] | None = None, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> Fit:
    """The anchored fit (``training.fit_anchored``) to rows ``(a, y, x)`` with sparse ``x``; the anchor is 0 where none is given."""
    start = np.zeros(width + 1) if anchor is None else np.array([float(z) for z in anchor])
    if len(start) != width + 1:
        raise ValueError(f"{len(start)} weights for {width} inputs and the group")
    packed = df.select("x", "a", "y").mapInArrow(_pack, "grp string, z binary, y binary")
    return fit_blocks(Blocks(packed, width + 1, Sparse.unpacked), {"": start}, {"": strength / (width + 1) ** 2}, max_steps, tolerance)[""]


def score_sparse(df: DataFrame, theta: Sequence[float], output: str = "f") -> DataFrame:
    """The rows with their linear score. The weights go to the tasks as a broadcast, as large as the model."""
    shipped = df.sparkSession.sparkContext.broadcast(np.array(theta, dtype=float))
    others = [c for c in df.columns if c != output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _columns(batch).scores(shipped.value)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(f)], [*others, output])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)
    return df.mapInArrow(run, f"{schema}, {output} double")
