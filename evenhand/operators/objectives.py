"""Losses and the smooth fairness surrogate, as aggregates over scored rows.

Every function takes rows with ``f`` (the score) and, where it matters, ``a`` and ``y``. ``theta`` and
its anchor are model-sized lists on the driver; their ridge term is a constant of the plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenhand.functions.vectors import LOGIT_CLIP

# Keeps the square root of the gap differentiable at 0.
GAP_SMOOTHING = 1e-12


def logistic_loss(f: Column, y: Column) -> Column:
    margin = (F.lit(2) * y - F.lit(1)) * f
    return F.log1p(F.exp(-F.greatest(margin, F.lit(-LOGIT_CLIP))))


def ridge(theta: Sequence[float], anchor: Sequence[float], strength: float, scaled: bool = False) -> float:
    """``strength / 2 * |theta - anchor|^2``, divided by the squared width if ``scaled``."""
    distance = sum((t - z) ** 2 for t, z in zip(theta, anchor, strict=True))
    return strength / (2.0 * (len(theta) ** 2 if scaled else 1)) * distance


def base_loss(penalty: float) -> Column:
    """Mean loss of the group plus the ridge term."""
    return F.avg(logistic_loss(F.col("f"), F.col("y"))) + F.lit(float(penalty))


def universum_loss(strength: float, delta_s: Column, chosen: Column | None = None) -> Column:
    """``strength`` times the mean loss with label 1; 0 without points or without imbalance."""
    loss = logistic_loss(F.col("f"), F.lit(1))
    mean = F.avg(loss if chosen is None else F.when(chosen, loss))
    return F.when(delta_s > 0, F.coalesce(F.lit(float(strength)) * mean, F.lit(0.0))).otherwise(F.lit(0.0))


def smooth_tpr(group: int, tau: float = 0.0, sharpness: float = 10.0) -> Column:
    """Mean of ``sigmoid(sharpness * (f - tau))`` over the positives of a group; 0 without any."""
    soft = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(float(sharpness)) * (F.col("f") - F.lit(float(tau)))))
    return F.coalesce(F.avg(F.when((F.col("y") == 1) & (F.col("a") == group), soft)), F.lit(0.0))


def smooth_gap(tpr0: Column, tpr1: Column, positives: Column) -> Column:
    """``sqrt((tpr1 - tpr0)^2 + 1e-12)``; 0 without positives."""
    difference = tpr1 - tpr0
    return F.when(positives > 0, F.sqrt(difference * difference + F.lit(GAP_SMOOTHING))).otherwise(F.lit(0.0))


def fairness_terms(
    df: DataFrame, by: Sequence[str], penalty: float, tau: float = 0.0, sharpness: float = 10.0
) -> DataFrame:
    """``(by..., outer_loss, tpr0, tpr1, gap)`` of real rows."""
    positives = F.sum(F.when(F.col("y") == 1, 1).otherwise(0))
    out = df.groupBy(*by).agg(
        base_loss(penalty).alias("outer_loss"),
        smooth_tpr(0, tau, sharpness).alias("tpr0"),
        smooth_tpr(1, tau, sharpness).alias("tpr1"),
        positives.alias("_positives"),
    )
    return out.withColumn("gap", smooth_gap(F.col("tpr0"), F.col("tpr1"), F.col("_positives"))).drop("_positives")


def inner_objective(payload: DataFrame, by: Sequence[str], penalty: float, strength: float) -> DataFrame:
    """``(by..., inner)``: base loss of the synthetic rows plus the pseudo-positive loss.

    ``payload`` has ``kind``, ``f``, ``y`` and ``delta_s``.
    """
    synthetic, universum = F.col("kind") == "synthetic", F.col("kind") == "universum"
    loss = logistic_loss(F.col("f"), F.col("y"))
    own = F.avg(F.when(synthetic, loss)) + F.lit(float(penalty))
    return payload.groupBy(*by).agg(
        (own + universum_loss(strength, F.max("delta_s"), universum)).alias("inner")
    )


def augmented_objective(outer_loss: Column, gap: Column, multiplier: Column | float, rho: float) -> Column:
    """``L_out + multiplier * gap + rho / 2 * gap^2``."""
    m = multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))
    return outer_loss + m * gap + F.lit(rho / 2.0) * gap * gap


# Weights within a block of steps span at most so many powers of ten.
_BLOCK_DECADES = 100.0


def moving_average(steps: DataFrame, run: Sequence[str], step: str, value: str, beta: float = 0.15) -> DataFrame:
    """``(run..., step, value, ema)`` with ``ema = (1 - beta) * previous + beta * value``, from 0.

    The average is a weighted running sum. It is taken within blocks of steps, so that weights stay in range,
    and each block adds what the three before it have left; what is older weighs less than a double can hold.
    """
    keep = 1.0 - beta
    if not 0.0 <= keep < 1.0:
        raise ValueError(f"beta {beta} is not in (0, 1]")
    length = max(1, int(_BLOCK_DECADES / -math.log10(keep))) if keep else 1
    place = F.row_number().over(Window.partitionBy(*run).orderBy(step)) - 1
    placed = steps.select(*run, step, F.col(value).cast("double").alias(value)).withColumn("_place", place)
    placed = placed.withColumns({"_block": F.floor(F.col("_place") / length), "_in": F.col("_place") % length})
    if keep == 0.0:
        return placed.select(*run, step, value, F.col(value).alias("ema"))
    upto = Window.partitionBy(*run, "_block").orderBy("_in").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum(F.lit(beta) * F.col(value) * F.pow(F.lit(keep), -F.col("_in"))).over(upto) * F.pow(F.lit(keep), F.col("_in"))
    placed = placed.withColumn("_own", own)
    ends = placed.groupBy(*run, "_block").agg(F.max_by("_own", "_in").alias("_end"))
    back = Window.partitionBy(*run).orderBy("_block")
    left = sum(F.coalesce(F.lag("_end", n).over(back), F.lit(0.0)) * F.lit(keep ** (length * (n - 1))) for n in (1, 2, 3))
    carried = placed.join(ends.withColumn("_left", left), [*run, "_block"])
    ema = F.col("_own") + F.col("_left") * F.pow(F.lit(keep), F.col("_in") + 1)
    return carried.select(*run, step, value, ema.alias("ema"))


def multiplier_path(smoothed: DataFrame, run: Sequence[str], step: str, rho: float) -> DataFrame:
    """Adds ``multiplier``, the running sum of ``rho * ema``."""
    upto = Window.partitionBy(*run).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return smoothed.withColumn("multiplier", F.sum(F.lit(float(rho)) * F.col("ema")).over(upto))


def stopping_step(path: DataFrame, run: Sequence[str], step: str, epsilon: float) -> DataFrame:
    """``(run..., stop_step, last_step)``: the first step with ``|ema| <= epsilon``; null if none."""
    hit = F.when(F.abs("ema") <= F.lit(float(epsilon)), F.col(step))
    return path.groupBy(*run).agg(F.min(hit).alias("stop_step"), F.max(step).alias("last_step"))


def gradient_stopping_step(
    path: DataFrame, run: Sequence[str], step: str, gradient: str, tolerance: float
) -> DataFrame:
    """The other stop rule: largest feature gradient at most ``tolerance * max(1, first one)``."""
    first = F.min_by(gradient, step).over(Window.partitionBy(*run))
    limit = F.lit(float(tolerance)) * F.greatest(F.lit(1.0), first)
    return (
        path.withColumn("_limit", limit)
        .groupBy(*run)
        .agg(
            F.min(F.when(F.col(gradient) <= F.col("_limit"), F.col(step))).alias("stop_step"),
            F.max(step).alias("last_step"),
        )
    )


def mean_gradient(df: DataFrame, x: str, width: int, penalty_gradient: Sequence[float]) -> DataFrame:
    """``(g0..g_width)``: gradient of mean loss plus ridge at the weights that gave ``f``."""
    residual = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("f"))) - F.col("y")
    inputs = [F.col(x)[i] for i in range(width)] + [F.col("a").cast("double")]
    return df.agg(
        *[
            (F.avg(residual * v) + F.lit(float(p))).alias(f"g{i}")
            for i, (v, p) in enumerate(zip(inputs, penalty_gradient, strict=True))
        ]
    )
