"""Synthetic rows and pseudo-positive midpoints, from minibatches of at most 128 rows per client."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenhand.functions.draws import draw_hash, draw_index, gaussian
from evenhand.functions.vectors import midpoint
from evenhand.operators.sampling import STRATA, floor_positives, per_stratum, stratum_name

# Fixed values of the design: synthetic rows per batch, positives per group, spread of the templates.
SYNTHETIC_ROWS = 32
SYNTHETIC_FLOOR = 2
TEMPLATE_SPREAD = 0.5
FLAT_STD = 1e-8

BATCH = ("round", "client_id")


def synthetic_quotas(
    stats: DataFrame, rows: int = SYNTHETIC_ROWS, floor: int = SYNTHETIC_FLOOR, by: Sequence[str] = BATCH
) -> DataFrame:
    """``(by..., ds_target, q_a?y?, ds_size, delta_s)`` from minibatch statistics.

    The total exceeds the target where the floors alone do.
    """
    size = F.col("n0") + F.col("n1")
    scaled = stats.filter(size > 0).select(
        *by,
        F.least(F.lit(rows), size).cast("bigint").alias("ds_target"),
        *[
            F.rint(F.col(stratum_name("q", a, y)) * (F.least(F.lit(rows), size) / size))
            .cast("bigint")
            .alias(stratum_name("q", a, y))
            for a, y in STRATA
        ],
    )
    out = floor_positives(scaled, F.lit(floor).cast("bigint"), F.col("ds_target"))
    negatives, positives = F.col("q_a0y0") + F.col("q_a1y0"), F.col("q_a0y1") + F.col("q_a1y1")
    return out.withColumns(
        {
            "ds_size": negatives + positives,
            "delta_s": F.greatest(F.lit(0), negatives - positives).cast("bigint"),
        }
    )


def stratum_moments(batch: DataFrame, by: Sequence[str] = BATCH) -> DataFrame:
    """``(by..., a, y, j, mean, std)`` for all four strata of every batch and every feature.

    An empty stratum takes the mean of the batch, one with fewer than two rows its spread; a flat
    feature gets spread 1.
    """
    by = list(by)
    cells = batch.select(*by, "a", "y", F.posexplode("x").alias("j", "v"))
    whole = cells.groupBy(*by, "j").agg(F.avg("v").alias("_mean_all"), F.stddev_pop("v").alias("_std_all"))
    parts = cells.groupBy(*by, "a", "y", "j").agg(
        F.count("*").alias("_n"), F.avg("v").alias("_mean"), F.stddev_pop("v").alias("_std")
    )
    skeleton = whole.withColumn(
        "_s", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(y).alias("y")) for a, y in STRATA]))
    ).select("*", "_s.a", "_s.y")
    joined = skeleton.join(parts, [*by, "a", "y", "j"], "left")
    spread = F.when(F.col("_n") > 1, F.col("_std")).otherwise(F.col("_std_all"))
    return joined.select(
        *by,
        "a",
        "y",
        "j",
        F.coalesce("_mean", "_mean_all").alias("mean"),
        F.when(spread > FLAT_STD, spread).otherwise(F.lit(1.0)).alias("std"),
    )


def _point_noise(seed: int, salt: str, keys: Sequence[Column], j: Column) -> Column:
    return gaussian(draw_hash(seed, salt, *keys, j))


def synthetic_rows(
    quotas: DataFrame, moments: DataFrame, seed: int, spread: float = TEMPLATE_SPREAD, by: Sequence[str] = BATCH
) -> DataFrame:
    """``(by..., kind, pt_id, a, y, x)``: quota rows per stratum, ``mean + spread * std * N(0, 1)``."""
    by = list(by)
    shapes = moments.groupBy(*by, "a", "y").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "mean", "std"))), lambda m: m).alias("_m")
    )
    slots = (
        shapes.join(quotas, by)
        .withColumn("_quota", per_stratum("q").cast("int"))
        .filter(F.col("_quota") > 0)
        .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_quota"))))
    )
    point = F.concat_ws("-", F.lit("s"), F.col("a"), F.col("y"), F.col("_i"))
    keys = [*[F.col(c) for c in by], F.col("pt_id")]
    x = F.transform(
        "_m",
        lambda m: m["mean"] + F.lit(float(spread)) * m["std"] * _point_noise(seed, "syn", keys, m["j"]),
    )
    return slots.withColumn("pt_id", point).select(*by, F.lit("synthetic").alias("kind"), "pt_id", "a", "y", x.alias("x"))


def universum_size(delta_s: Column, ds_size: Column, delta: Column) -> Column:
    return F.greatest(F.lit(0), F.least(delta_s, ds_size, delta)).cast("bigint")


def universum_slots(quotas: DataFrame, stats: DataFrame, by: Sequence[str] = BATCH) -> DataFrame:
    """``(by..., slot, a)``: half of the points to each group, the odd one to group 1."""
    by = list(by)
    sized = quotas.select(*by, "ds_size", "delta_s").join(
        stats.select(*by, "delta", "n0", "n1", *[stratum_name("q", a, y) for a, y in STRATA]), by
    )
    sized = sized.withColumn("u_size", universum_size(F.col("delta_s"), F.col("ds_size"), F.col("delta")))
    slots = sized.filter(F.col("u_size") > 0).withColumn(
        "slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("u_size") - 1))
    )
    return slots.withColumn("a", (F.col("slot") >= F.floor(F.col("u_size") / 2)).cast("int"))


def universum_rows(
    slots: DataFrame,
    batch: DataFrame,
    seed: int,
    width: int,
    by: Sequence[str] = BATCH,
    order: Sequence[str] = ("pos", "a"),
) -> DataFrame:
    """``(by..., kind, pt_id, a, y, x)``: halfway between a positive of the own group and a negative
    of the other one, each drawn with replacement; any positive or negative where the group has none,
    pure noise where the batch has none.

    Candidates are numbered within (y, group) and within y, so that a draw is one equi-join.
    """
    by = list(by)
    any_group = F.lit(2)
    place = [F.col(c) for c in order]
    own = batch.select(
        *by, "y", F.col("a").alias("_scope"), "x",
        (F.row_number().over(Window.partitionBy(*by, "y", "a").orderBy(*place)) - 1).cast("bigint").alias("_idx"),
    )
    either = batch.select(
        *by, "y", any_group.alias("_scope"), "x",
        (F.row_number().over(Window.partitionBy(*by, "y").orderBy(*place)) - 1).cast("bigint").alias("_idx"),
    )
    pool = own.unionByName(either)
    ones = F.when(F.col("a") == 1, F.col("q_a1y1")).otherwise(F.col("q_a0y1"))
    others = F.when(F.col("a") == 1, F.col("q_a0y0")).otherwise(F.col("q_a1y0"))
    keys = [F.col(c) for c in by] + [F.col("slot")]
    picks = slots.withColumns(
        {
            "_pos_scope": F.when(ones > 0, F.col("a")).otherwise(any_group),
            "_pos_idx": draw_index(draw_hash(seed, "upos", *keys), F.when(ones > 0, ones).otherwise(F.col("n1"))),
            "_neg_scope": F.when(others > 0, 1 - F.col("a")).otherwise(any_group),
            "_neg_idx": draw_index(draw_hash(seed, "uneg", *keys), F.when(others > 0, others).otherwise(F.col("n0"))),
        }
    )
    pos = pool.filter("y = 1").select(*by, F.col("_scope").alias("_pos_scope"), F.col("_idx").alias("_pos_idx"), F.col("x").alias("_pos"))
    neg = pool.filter("y = 0").select(*by, F.col("_scope").alias("_neg_scope"), F.col("_idx").alias("_neg_idx"), F.col("x").alias("_neg"))
    met = picks.join(pos, [*by, "_pos_scope", "_pos_idx"], "left").join(neg, [*by, "_neg_scope", "_neg_idx"], "left")
    noise = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda j: F.lit(TEMPLATE_SPREAD) * _point_noise(seed, "unoise", keys, j),
    )
    x = F.when(F.col("_pos").isNotNull() & F.col("_neg").isNotNull(), midpoint(F.col("_pos"), F.col("_neg"))).otherwise(noise)
    return met.select(
        *by,
        F.lit("universum").alias("kind"),
        F.concat(F.lit("u-"), F.col("slot").cast("string")).alias("pt_id"),
        "a",
        F.lit(1).alias("y"),
        x.alias("x"),
    )


def build_payload(synthetic: DataFrame, universum: DataFrame | None = None) -> DataFrame:
    """All rows that the clients hand in; without pseudo-positives just the synthetic ones."""
    return synthetic if universum is None else synthetic.unionByName(universum)
