"""Expressions over feature arrays and linear scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Logits are clipped to this range before the sigmoid, margins from below before the loss.
LOGIT_CLIP = 50.0


def assemble(columns: Sequence[str], intercept: bool = False) -> Column:
    """Named columns to ``x``; the constant goes behind the (already scaled) features."""
    parts = [F.col(c).cast("double") for c in columns]
    if intercept:
        parts.append(F.lit(1.0))
    return F.array(*parts)


def pack(x: Column, a: Column) -> Column:
    """``[x; a]``, the input of the linear model."""
    return F.concat(x, F.array(a.cast("double")))


def score(x: Column | str, a: Column | str, theta: Sequence[float] | Column, width: int | None = None) -> Column:
    """``theta . [x; a]`` unrolled over the known width, so that it stays inside generated code."""
    x = F.col(x) if isinstance(x, str) else x
    a = F.col(a) if isinstance(a, str) else a
    if isinstance(theta, Column):
        if width is None:
            raise ValueError("a column of weights needs the number of features")
        weights = [theta[i] for i in range(width + 1)]
    else:
        weights = [F.lit(float(t)) for t in theta]
    d = len(weights) - 1
    terms = [weights[i] * x[i] for i in range(d)] + [weights[d] * a.cast("double")]
    return reduce(lambda left, right: left + right, terms)


def score_columns(columns: Sequence[str], a: str, theta: Sequence[float]) -> Column:
    """The same score from named columns."""
    names = [*columns, a]
    if len(names) != len(theta):
        raise ValueError(f"{len(names)} inputs for {len(theta)} weights")
    terms = [F.lit(float(t)) * F.col(c).cast("double") for t, c in zip(theta, names)]
    return reduce(lambda left, right: left + right, terms)


def predict(f: Column, threshold: Column | float = 0.0) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (f > t).cast("int")


def sigmoid(f: Column) -> Column:
    clipped = F.greatest(F.least(f, F.lit(LOGIT_CLIP)), F.lit(-LOGIT_CLIP))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped))


def clip(x: Column, low: float, high: float) -> Column:
    return F.transform(x, lambda v: F.greatest(F.lit(low), F.least(F.lit(high), v)))


def midpoint(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda u, v: (u + v) / F.lit(2.0))


def spread(x: str, width: int, prefix: str = "x") -> list[Column]:
    """An array as named columns ``x0, x1, ...``."""
    return [F.col(x)[i].alias(f"{prefix}{i}") for i in range(width)]
