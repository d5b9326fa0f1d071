"""Client-side refinement: one grouped-map task per (round, client).

A group holds one minibatch (at most 128 rows), its synthetic rows and its pseudo-positives, so its
size does not depend on the data. Gradients and the Hessian of the linear model are closed-form; beyond
``DENSE`` weights the Hessian is never formed, only multiplied with vectors, so a group needs memory for its
points and a few vectors, whatever their width.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from evenhand.operators.solve import conjugate_gradients

# Weights up to which the Hessian is formed and solved.
DENSE = 256
# Products of a matrix-free solve, and the length of its residual against that of the right-hand side.
PRODUCTS = 500
RESIDUAL = 1e-9

REFINED_SCHEMA = (
    "round int, client_id int, kind string, pt_id string, a int, y int, x array<double>, "
    "steps int, gap double, ema double, multiplier double"
)


@dataclass(frozen=True)
class RefineConfig:
    """Settings of the solver; the defaults are those of a full run."""

    strength_inner: float = 1e-4
    strength_outer: float = 1e-4
    universum_strength: float = 0.5
    rho: float = 0.5
    epsilon: float = 0.25
    inner_steps: int = 50
    outer_steps: int = 20
    step_theta: float = 0.05
    step_x: float = 0.02
    feature_limit: float = 10.0
    sharpness: float = 10.0
    tau: float = 0.0
    ema_beta: float = 0.15
    weighted: bool = True
    weight_cap: float = 10.0
    stop: str = "eo_gap"
    gradient_tolerance: float = 1e-6
    # "descend" lowers the outer objective; "as_published" takes the opposite, published direction.
    direction: str = "descend"
    # Divide the moving average by 1 - (1 - beta)^t, so that its first values are not near 0.
    corrected_ema: bool = False
    # The Hessian and the pull on the features take the plain mean loss, as published, or the weighted one.
    weighted_curvature: bool = False
    # Added to the Hessian's diagonal before the solve.
    damping: float = 0.0

    def __post_init__(self) -> None:
        if self.stop not in ("eo_gap", "grad_inf"):
            raise ValueError(f"stop rule {self.stop!r} is neither eo_gap nor grad_inf")
        if self.direction not in ("descend", "as_published"):
            raise ValueError(f"direction {self.direction!r} is neither descend nor as_published")


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(f, -50.0, 50.0)))


class _Points:
    """Inputs [x; a], labels and normalised weights of one kind of rows."""

    def __init__(self, rows: pd.DataFrame, width: int):
        self.rows = rows
        self.a = rows["a"].to_numpy(dtype=float)
        self.y = rows["y"].to_numpy(dtype=float)
        self.x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), width)
        self.weight = np.full(len(rows), 1.0 / len(rows)) if len(rows) else np.zeros(0)
        # Weights of the loss whose curvature and mixed derivatives are taken.
        self.curved = self.weight

    def __len__(self) -> int:
        return len(self.y)

    @property
    def inputs(self) -> np.ndarray:
        return np.column_stack([self.x, self.a])

    def gradient(self, theta: np.ndarray) -> np.ndarray:
        z = self.inputs
        return z.T @ (self.weight * (_sigmoid(z @ theta) - self.y))

    def curvature(self, theta: np.ndarray) -> np.ndarray:
        z = self.inputs
        p = _sigmoid(z @ theta)
        return z.T @ (z * (self.curved * p * (1.0 - p))[:, None])

    def feature_pull(self, theta: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Derivative of (loss gradient . h) with respect to each row's features."""
        z = self.inputs
        p = _sigmoid(z @ theta)
        along = self.curved * p * (1.0 - p) * (z @ h)
        return np.outer(along, theta[:-1]) + np.outer(self.curved * (p - self.y), h[:-1])


def _group_weights(a: np.ndarray, y: np.ndarray, cap: float) -> np.ndarray:
    w = np.ones(len(y))
    positive = y == 1
    if positive.any():
        share = float(np.mean(a[positive] == 1))
        p = np.clip(np.where(a == 1, share, 1.0 - share), 1e-6, 1.0)
        w[positive] = 1.0 / p[positive]
    return np.clip(w, 1.0, cap)


def _smooth_gap(batch: _Points, theta: np.ndarray, cfg: RefineConfig) -> tuple[float, np.ndarray]:
    """Smooth true-positive-rate gap and its gradient; both 0 without positives."""
    positive = batch.y == 1
    if not positive.any():
        return 0.0, np.zeros_like(theta)
    rates, slopes = [], []
    for group in (0, 1):
        z = batch.inputs[positive & (batch.a == group)]
        if len(z) == 0:
            rates.append(0.0)
            slopes.append(np.zeros_like(theta))
            continue
        s = _sigmoid(cfg.sharpness * (z @ theta - cfg.tau))
        rates.append(float(s.mean()))
        slopes.append((cfg.sharpness * s * (1.0 - s)) @ z / len(z))
    difference = rates[1] - rates[0]
    gap = float(np.sqrt(difference**2 + 1e-12))
    return gap, difference / gap * (slopes[1] - slopes[0])


def _inner_fit(theta, gradient, steps: int, rate: float) -> np.ndarray:
    """Adam with its usual constants (0.9, 0.999, 1e-8), started afresh."""
    theta = theta.copy()
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        g = gradient(theta)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return theta


def _direction(parts: Sequence[tuple[_Points, float]], theta: np.ndarray, ridge: float, v: np.ndarray) -> np.ndarray:
    """The solution of ``H h = v``, with ``H`` the parts' curvatures, each times its factor, and the ridge.

    The shortest least-squares one if a formed Hessian is singular.
    """
    if len(theta) > DENSE:
        # Products need the inputs and the curvature along each point only once for all vectors.
        curved = [(p.inputs, factor * p.curved * (s := _sigmoid(p.inputs @ theta)) * (1.0 - s)) for p, factor in parts]
        product = lambda u: sum((z.T @ (c * (z @ u)) for z, c in curved), ridge * u)
        return conjugate_gradients(product, v, RESIDUAL * float(np.linalg.norm(v)), PRODUCTS)
    hessian = sum((factor * p.curvature(theta) for p, factor in parts), ridge * np.eye(len(theta)))
    try:
        return np.linalg.solve(hessian, v)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(hessian, v, rcond=None)[0]


def refine_points(points: pd.DataFrame, anchor: np.ndarray, cfg: RefineConfig, move: bool = True) -> pd.DataFrame:
    """Refine one client's synthetic rows and pseudo-positives against its minibatch.

    ``move=False`` is the plain local fit, whose loss has no weights. Returns them with moved features, and one row of kind ``theta`` with the local weights.
    """
    width = len(anchor) - 1
    points = points.sort_values(["kind", "pt_id"], kind="stable")
    kinds = {kind: _Points(points[points["kind"] == kind], width) for kind in ("batch", "synthetic", "universum", "buffer")}
    batch, synthetic, universum = kinds["batch"], kinds["synthetic"], kinds["universum"]
    if len(kinds["buffer"]):
        # Buffered positives stand in for a group that has none in the batch.
        absent = [s for s in (0, 1) if not ((batch.y == 1) & (batch.a == s)).any()]
        extra = kinds["buffer"].rows
        fair = _Points(pd.concat([batch.rows, extra[extra["a"].isin(absent)]]), width)
    else:
        fair = batch
    if cfg.weighted and move and len(synthetic):
        w = _group_weights(synthetic.a, synthetic.y, cfg.weight_cap)
        synthetic.weight = w / w.sum()
        if cfg.weighted_curvature:
            synthetic.curved = synthetic.weight
    pull_up = cfg.universum_strength if len(universum) and (synthetic.y == 0).sum() > (synthetic.y == 1).sum() else 0.0
    ridge = cfg.strength_inner / len(anchor) ** 2 if move else cfg.strength_inner

    def gradient(theta):
        g = synthetic.gradient(theta) + ridge * (theta - anchor)
        return g + pull_up * universum.gradient(theta) if pull_up else g

    theta = anchor.copy()
    multiplier = ema = gap = 0.0
    first_pull = None
    steps = 0
    for steps in range(1, (cfg.outer_steps if move else 1) + 1):
        theta = _inner_fit(theta, gradient, cfg.inner_steps, cfg.step_theta)
        gap, gap_slope = _smooth_gap(fair, theta, cfg)
        if not move:
            break
        outer_slope = batch.gradient(theta) + cfg.strength_outer * theta
        v = outer_slope + (multiplier + cfg.rho * gap) * gap_slope
        parts = [(synthetic, 1.0), (universum, pull_up)] if pull_up else [(synthetic, 1.0)]
        h = _direction(parts, theta, ridge + cfg.damping, v)
        sign = 1.0 if cfg.direction == "descend" else -1.0
        largest = 0.0
        for part, factor in ((synthetic, 1.0), (universum, pull_up)):
            if len(part) and factor:
                pull = factor * part.feature_pull(theta, h)
                largest = max(largest, float(np.abs(pull).max()))
                part.x = np.clip(part.x + sign * cfg.step_x * pull, -cfg.feature_limit, cfg.feature_limit)
        first_pull = largest if first_pull is None else first_pull
        ema = (1.0 - cfg.ema_beta) * ema + cfg.ema_beta * gap
        signal = ema / (1.0 - (1.0 - cfg.ema_beta) ** steps) if cfg.corrected_ema else ema
        multiplier += cfg.rho * signal
        if cfg.stop == "eo_gap" and abs(signal) <= cfg.epsilon:
            break
        if cfg.stop == "grad_inf" and largest <= cfg.gradient_tolerance * max(1.0, first_pull):
            break

    out = []
    for part in (synthetic, universum):
        moved = part.rows[["round", "client_id", "kind", "pt_id", "a", "y"]].copy()
        moved["x"] = list(part.x)
        out.append(moved)
    head = points.iloc[0]
    out.append(
        pd.DataFrame(
            {
                "round": [head["round"]], "client_id": [head["client_id"]], "kind": ["theta"], "pt_id": ["theta"],
                "a": [0], "y": [0], "x": [theta],
            }
        )
    )
    result = pd.concat(out, ignore_index=True)
    return result.assign(steps=steps, gap=gap, ema=ema, multiplier=multiplier)


def refine_clients(points: DataFrame, anchor: Sequence[float], cfg: RefineConfig, move: bool = True) -> DataFrame:
    """``refine_points`` for every (round, client) of ``points(round, client_id, kind, pt_id, a, y, x)``.

    ``move=False`` only fits the local weights and leaves the features as they are.
    """
    start = np.asarray(anchor, dtype=float)

    def one_client(group: pd.DataFrame) -> pd.DataFrame:
        return refine_points(group, start, cfg, move)

    return points.groupBy("round", "client_id").applyInPandas(one_client, REFINED_SCHEMA)


def refine_settings(points: DataFrame, anchors: Mapping[str, Sequence[float]], configs: Mapping[str, RefineConfig]) -> DataFrame:
    """``refine_points`` for every (setting, round, client), each setting with its own anchor and configuration.

    Anchors and configurations are as large as so many models, and go to the tasks with the function.
    """
    starts = {name: np.asarray(anchor, dtype=float) for name, anchor in anchors.items()}

    def one_client(group: pd.DataFrame) -> pd.DataFrame:
        name = group["setting"].iloc[0]
        return refine_points(group, starts[name], configs[name]).assign(setting=name)

    return points.groupBy("setting", "round", "client_id").applyInPandas(one_client, f"{REFINED_SCHEMA}, setting string")
