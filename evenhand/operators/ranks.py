"""Exact ranks without a global sort.

Selecting the rows around a few ranks needs three narrow steps: a histogram over order-preserving
buckets (combined map-side), the running count of that histogram, and a sort of only those buckets
that hold a wanted rank. Nothing else is shuffled, however many rows there are, and a stratum that
holds most of the rows is spread over its buckets like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenhand.functions.draws import hash_bucket
from evenhand.operators.sizes import cut_lineage, small_side

# Buckets per factor e of a value's size: each is about 0.05 % of the value wide.
VALUE_RESOLUTION = 2048
# Parts that the rows of a bucket are dealt to, by where they lie between its smallest and largest value.
PARTS = 1024
# Further hash digits that part the rows of a hash bucket.
PART_DIGITS = 3
# Cuts that are compared one by one, and found with a coarser histogram.
FEW_CUTS = 16
# Sizes below its inverse share a few buckets around 0; above its own inverse limit, the last bucket.
_SMALLEST_UNIT = 1e9
_LARGEST_VALUE = 1e290


def value_bucket(value: Column, resolution: int = VALUE_RESOLUTION) -> Column:
    """Order-preserving bucket of a double, relative to its size, so that values of any scale spread.

    Values that differ from each other by less than a bucket all over (a large constant plus a little
    noise) crowd into few buckets; ``value_part`` parts them by the data itself.
    """
    size = F.log1p(F.least(F.abs(value), F.lit(_LARGEST_VALUE)) * F.lit(_SMALLEST_UNIT))
    return F.floor(F.signum(value) * size * F.lit(float(resolution))).cast("bigint")


def value_part(value: Column, low: Column, high: Column) -> Column:
    """Order-preserving part of a number within its bucket, whose values run from ``low`` to ``high``."""
    place = (value - low) / F.nullif(high - low, F.lit(0.0)) * F.lit(float(PARTS))
    return F.when(F.isnan(place) | place.isNull(), F.lit(0)).otherwise(F.floor(F.least(place, F.lit(float(PARTS))))).cast("bigint")


def values_at_ranks(
    df: DataFrame,
    value: Column,
    bucket: Column,
    ranks: Column | DataFrame,
    by: Sequence[str] = (),
    bound: int | None = None,
    part: Callable[[Column, Column, Column], Column] = value_part,
    ends: bool = True,
) -> DataFrame:
    """The values at 0-based ranks per ``by``: ``(by..., total, at MAP<rank, value>)``.

    ``ranks`` is an array expression of ``total``, the rows of the stratum (and of ``by``), or a small
    table ``(by..., ranks)``. Ranks beyond the stratum have no entry. ``bound`` bounds the number of
    strata times ranks. ``part`` gives the order-preserving part of a value in a bucket with a smallest and
    a largest one: a bucket that holds most of the rows is dealt out by it. Without ``ends`` these two are not
    looked for, and ``part`` gets nulls.
    """
    keys = list(by) or ["_all"]
    rows = df.select(*by, bucket.alias("_bucket"), value.alias("_value"))
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    found = [F.min("_value"), F.max("_value")] if ends else [F.lit(None).cast(rows.schema["_value"].dataType)] * 2
    histogram = rows.groupBy(*keys, "_bucket").agg(
        F.count("*").alias("_n"), F.struct(found[0].alias("low"), found[1].alias("high")).alias("_ends")
    )
    stratum = Window.partitionBy(*keys)
    before = stratum.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = histogram.withColumns(
        {"_start": F.coalesce(F.sum("_n").over(before), F.lit(0)), "total": F.sum("_n").over(stratum)}
    )
    if isinstance(ranks, Column):
        placed = placed.withColumn("ranks", ranks)
    else:
        placed = placed.join(small_side(ranks, bound), keys)
    # The wanted ranks line up with the bucket starts (the first bucket brings them along), and each
    # takes the last bucket that starts at or before it.
    own = F.struct(
        F.col("_start").alias("pos"), F.lit(0).alias("wanted"), F.col("_bucket").alias("bucket"),
        F.col("_start").alias("start"), F.col("_ends").alias("ends"),
    )
    missing = F.lit(None)
    lookups = F.transform(
        F.array_distinct("ranks"),
        lambda r: F.struct(
            r.cast("bigint").alias("pos"),
            F.lit(1).alias("wanted"),
            missing.cast(placed.schema["_bucket"].dataType).alias("bucket"),
            missing.cast("bigint").alias("start"),
            missing.cast(placed.schema["_ends"].dataType).alias("ends"),
        ),
    )
    events = placed.select(
        *keys,
        "total",
        F.inline(F.when(F.col("_start") == 0, F.concat(F.array(own), lookups)).otherwise(F.array(own))),
    )
    so_far = stratum.orderBy("pos", "wanted").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = (
        events.withColumns(
            {
                "_bucket": F.last("bucket", ignorenulls=True).over(so_far),
                "_start": F.last("start", ignorenulls=True).over(so_far),
                "_ends": F.last("ends", ignorenulls=True).over(so_far),
            }
        )
        .filter((F.col("wanted") == 1) & (F.col("pos") < F.col("total")))
        .groupBy(*keys, "_bucket", "_start", "_ends", "total")
        .agg(F.collect_list("pos").alias("ranks"))
    )
    # Only rows in the buckets with a wanted rank go on; equal values are counted before the shuffle.
    cell = [*keys, "_bucket", "_part"]
    counted = (
        rows.join(small_side(hits, bound), [*keys, "_bucket"])
        .withColumn("_part", part(F.col("_value"), F.col("_ends.low"), F.col("_ends.high")))
        .groupBy(*cell, "_value")
        .agg(
            F.count("*").alias("_n"),
            F.first("_start").alias("_start"),
            F.first("total").alias("total"),
            F.first("ranks").alias("ranks"),
        )
    )
    # Both the parts' sizes and the values in them are read from it, so the rows are not met twice.
    counted = cut_lineage(counted)
    parts_before = (
        Window.partitionBy(*keys, "_bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counted.groupBy(*cell).agg(F.sum("_n").alias("_in_part")).select(
        *cell, F.coalesce(F.sum("_in_part").over(parts_before), F.lit(0)).alias("_part_start")
    )
    upto = Window.partitionBy(*cell).orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("_start") + F.col("_part_start") + F.sum("_n").over(upto)
    counted = counted.join(starts, cell)
    found = (
        counted.withColumn("_end", end)
        .withColumn(
            "_rank",
            F.explode(F.filter("ranks", lambda r: (r >= F.col("_end") - F.col("_n")) & (r < F.col("_end")))),
        )
        .groupBy(*keys)
        .agg(
            F.first("total").alias("total"),
            F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("at"),
        )
    )
    return found if by else found.drop("_all")


def exact_quantiles(
    df: DataFrame,
    value: str,
    parts: Sequence[int],
    of: int,
    by: Sequence[str] = (),
    groups: int | None = 1,
    resolution: int = VALUE_RESOLUTION,
) -> DataFrame:
    """Linearly interpolated quantiles ``part / of``, exact: ``(by..., quantiles ARRAY<DOUBLE>)``.

    ``groups`` bounds the number of ``by`` groups, None where it is unknown.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias("_v"))
    positions = F.transform(
        F.expr(f"array({', '.join(map(str, parts))})"), lambda n: (F.col("total") - 1) * n / F.lit(float(of))
    )
    neighbours = F.concat(
        F.transform(positions, lambda p: F.floor(p).cast("bigint")),
        F.transform(positions, lambda p: F.ceil(p).cast("bigint")),
    )
    bound = None if groups is None else groups * 2 * len(parts)
    found = values_at_ranks(rows, F.col("_v"), value_bucket(F.col("_v"), resolution), neighbours, by, bound)

    def interpolated(p: Column) -> Column:
        low = F.element_at("at", F.floor(p).cast("bigint"))
        high = F.element_at("at", F.ceil(p).cast("bigint"))
        return low + (high - low) * (p - F.floor(p))

    return found.select(*by, F.transform(positions, interpolated).alias("quantiles"))


def median(df: DataFrame, value: str, by: Sequence[str] = (), groups: int | None = 1) -> DataFrame:
    """``(by..., median)``; the mean of the two middle values where the count is even."""
    out = exact_quantiles(df, value, [1], 2, by, groups)
    return out.select(*by, F.col("quantiles")[0].alias("median"))


def shuffle_cuts(
    df: DataFrame,
    h: Column,
    counts: Column | DataFrame,
    by: Sequence[str] = (),
    bound: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Hashes that cut a table, taken in hash order, after given numbers of rows.

    ``counts`` is an ascending array expression of ``total`` (the rows of the stratum) or a table ``(by..., counts)``; rows
    from the hash of row ``count`` on are behind the cut. Returns ``(by..., cut_hashes ARRAY<STRING>)``,
    where a count that reaches the size of its stratum, with no row behind it, is null.
    ``digits`` sets the histogram: about 16**-digits of the rows are sorted per cut. Few cuts do with one digit less,
    as the histogram is then the larger part of the work.
    """
    if digits is None:
        digits = 3 if bound is not None and bound <= FEW_CUTS else 4
    hashed = df.select(*by, h.alias("_h"))
    ranks = counts.withColumnRenamed("counts", "ranks") if isinstance(counts, DataFrame) else counts
    further = lambda h, low, high: F.substring(h, digits + 1, PART_DIGITS)
    found = values_at_ranks(hashed, F.col("_h"), hash_bucket(F.col("_h"), digits), ranks, by, bound, further, ends=False)
    if isinstance(counts, DataFrame):
        found = found.join(counts, list(by))
    else:
        found = found.withColumn("counts", ranks)
    return found.select(*by, F.transform("counts", lambda c: F.try_element_at("at", c)).alias("cut_hashes"))


def part_of(h: Column, cut_hashes: Column, cuts: int) -> Column:
    """Number of cuts at or below the hash: the 0-based part of a row. A null cut (at the end) is never reached.

    A few cuts are compared one by one in generated code. More ascend, so halving steps find the part: the expression and the work grow
    with the logarithm of ``cuts``. The outer transform makes the hash a variable, so that it is computed once and not once per step.
    """
    if cuts <= FEW_CUTS:
        return sum([F.coalesce((h >= F.get(cut_hashes, F.lit(i))).cast("int"), F.lit(0)) for i in range(cuts)], F.lit(0))
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, cuts.bit_length()) - 1, -1, -1)])

    def reached(v: Column, n: Column) -> Column:
        return F.coalesce(v >= F.get(cut_hashes, n - 1), F.lit(False))

    return F.transform(
        F.array(h), lambda v: F.aggregate(steps, F.lit(0), lambda n, step: F.when(reached(v, n + step), n + step).otherwise(n))
    )[0]


# monotonically_increasing_id puts the partition above these bits and the place in it below them.
_PLACE_BITS = 33


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """``(column, code)``: 0-based position of each distinct value in sorted order; null has none.

    The distinct values are range-sorted, which balances partitions whatever the values look like, and
    written with their place; a value's code is its place plus the sizes of the partitions before.
    """
    distinct = df.select(column).filter(F.col(column).isNotNull()).distinct()
    placed = cut_lineage(distinct.sort(column).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.select(
        column,
        F.shiftright("_id", _PLACE_BITS).alias("_part"),
        F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("_place"),
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.join(small_side(starts, partitions), "_part").select(
        column, (F.col("_start") + F.col("_place")).cast("bigint").alias("code")
    )
