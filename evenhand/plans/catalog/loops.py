"""Queries for whole loops: local fits, refinement and rounds, on one feature, with their steps written out in SQL."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.operators import refine
from evenhand.plans import oracle as o, views
from evenhand.plans.catalog import register
from evenhand.plans.catalog.synthesizing import parts_of, payload_from
from evenhand.plans.rounds import RunConfig, judge_weights, train_rounds

START = (0.05, -0.4)
LOOP = refine.RefineConfig(
    inner_steps=5, outer_steps=2, step_theta=0.02, step_x=0.2, rho=0.5, epsilon=0.02, strength_inner=0.4, strength_outer=0.1,
    universum_strength=0.5, feature_limit=100.0,
)
ROUNDS = RunConfig(clients=views.CLIENTS, rounds=2, seed=views.SEED, strength=0.1, noise_enabled=False, solver=dataclasses.replace(LOOP, epsilon=0.0))
FIT_STEPS = 9
WHO = "round, client_id"
POINT = f"{WHO}, kind, pt_id, a, y"


def _score(x: str) -> str:
    return f"1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least(t0 * {x} + t1 * a, 50.0::DOUBLE), -50.0::DOUBLE)))"


def _weights(weighted: bool, pull: float) -> dict[str, str]:
    """CTE ``pts``: payload points on one feature, each with its weight ``w`` in the loss and ``c`` in its curvature, and the share's factor."""
    raw = "1.0::DOUBLE"
    if weighted:
        raw = "CASE WHEN kind = 'synthetic' AND y = 1 THEN greatest(1.0::DOUBLE, least(10.0::DOUBLE, 1.0::DOUBLE / greatest(1e-6::DOUBLE, CASE a WHEN 1 THEN share ELSE 1 - share END))) ELSE 1.0::DOUBLE END"
    factor = f"CASE WHEN kind = 'synthetic' THEN 1.0::DOUBLE WHEN delta_s > 0 THEN {o.dbl(pull)} ELSE 0.0::DOUBLE END"
    shares = "avg(CASE WHEN kind = 'synthetic' AND y = 1 THEN a END) OVER (PARTITION BY round, client_id)"
    own = f"{WHO}, kind"
    return {
        "flat": f"SELECT {POINT}, v AS x, delta_s, {shares} AS share FROM payload JOIN (SELECT round, client_id, delta_s FROM syn_quotas) USING ({WHO}) WHERE j = 0",
        "pts": f"SELECT {POINT}, x, {factor} AS factor, {factor} * raw / sum(raw) OVER (PARTITION BY {own}) AS w, {factor} / count(*) OVER (PARTITION BY {own}) AS c FROM (SELECT *, {raw} AS raw FROM flat)",
    }


def _inner(points: str, state: str, anchor: str, ridge: float, config: refine.RefineConfig, name: str) -> dict[str, str]:
    """CTEs of Adam steps from ``state(round, client_id, t0, t1)``; the last one is ``{name}``. anchor: an expression table (z0, z1)."""
    ctes = {f"{name}_0": f"SELECT {WHO}, t0, t1, 0.0::DOUBLE AS m0, 0.0::DOUBLE AS m1, 0.0::DOUBLE AS s0, 0.0::DOUBLE AS s1 FROM {state}"}
    for k in range(1, config.inner_steps + 1):
        before = f"{name}_{k - 1}"
        pull = [f"sum(w * (p - y) * {v}) + {o.dbl(ridge)} * (t{i} - any_value(z{i}))" for i, v in enumerate(("x", "a"))]
        slopes = f"SELECT {WHO}, t0, t1, m0, m1, s0, s1, {pull[0]} AS g0, {pull[1]} AS g1 FROM (SELECT *, {_score('x')} AS p FROM {points} JOIN {before} USING ({WHO}), {anchor}) GROUP BY {WHO}, t0, t1, m0, m1, s0, s1"
        moments = f"SELECT {WHO}, t0, t1, " + ", ".join(f"0.9::DOUBLE * m{i} + 0.1::DOUBLE * g{i} AS m{i}, 0.999::DOUBLE * s{i} + 0.001::DOUBLE * g{i} * g{i} AS s{i}" for i in (0, 1)) + f" FROM ({slopes})"
        moved = [f"t{i} - {o.dbl(config.step_theta)} * (m{i} / {o.dbl(1 - 0.9**k)}) / (sqrt(s{i} / {o.dbl(1 - 0.999**k)}) + 1e-8::DOUBLE) AS t{i}" for i in (0, 1)]
        ctes[f"{name}_{k}"] = f"SELECT {WHO}, {moved[0]}, {moved[1]}, m0, m1, s0, s1 FROM ({moments})"
    ctes[name] = f"SELECT {WHO}, t0, t1 FROM {name}_{config.inner_steps}"
    return ctes


def _gaps(state: str, config: refine.RefineConfig, name: str) -> dict[str, str]:
    """CTE ``{name}``: smooth gap ``g`` and the slopes v0, v1 of the outer objective without its gap part, d0, d1 of the gap."""
    soft = f"SELECT {WHO}, b.a, b.y, x[1] AS x, t0, t1, 1.0::DOUBLE / (1.0::DOUBLE + exp({o.dbl(-config.sharpness)} * (t0 * x[1] + t1 * b.a))) AS s FROM batch b JOIN {state} USING ({WHO})"
    rate = lambda what, group: f"coalesce(avg(CASE WHEN y = 1 AND a = {group} THEN {what} END), 0.0::DOUBLE)"
    steep = f"{o.dbl(config.sharpness)} * s * (1 - s)"
    sums = (
        f"SELECT {WHO}, t0, t1, sum(y) AS positives, {rate('s', 1)} - {rate('s', 0)} AS d, "
        + ", ".join(f"{rate(f'{steep} * {v}', 1)} - {rate(f'{steep} * {v}', 0)} AS d{i}, avg((p - y) * {v}) + {o.dbl(config.strength_outer)} * t{i} AS v{i}" for i, v in enumerate(("x", "a")))
        + f" FROM (SELECT *, {_score('x')} AS p FROM ({soft})) GROUP BY {WHO}, t0, t1"
    )
    return {name: f"SELECT {WHO}, t0, t1, v0, v1, g, CASE WHEN g > 0 THEN d / g ELSE 0.0::DOUBLE END * d0 AS d0, CASE WHEN g > 0 THEN d / g ELSE 0.0::DOUBLE END * d1 AS d1 FROM (SELECT *, CASE WHEN positives > 0 THEN sqrt(d * d + 1e-12::DOUBLE) ELSE 0.0::DOUBLE END AS g FROM ({sums}))"}


def _outer(points: str, start: str, anchor: str, config: refine.RefineConfig, name: str) -> dict[str, str]:
    """CTEs of whole refinements: ``{name}_done`` (weights, gap, ema, multiplier, steps) and ``{name}_points`` with moved ``x``."""
    ridge = config.strength_inner / 4
    ctes: dict[str, str] = {f"{name}_l0": f"SELECT {WHO}, t0, t1, 0.0::DOUBLE AS multiplier, 0.0::DOUBLE AS ema, 0.0::DOUBLE AS gap, 0 AS steps, true AS going FROM {start}"}
    now, loop = points, f"{name}_l0"
    for j in range(1, config.outer_steps + 1):
        tag = f"{name}_{j}"
        ctes[f"{tag}_from"] = f"SELECT {WHO}, t0, t1 FROM {loop} WHERE going"
        ctes |= _inner(now, f"{tag}_from", anchor, ridge, config, f"{tag}_in")
        ctes |= _gaps(f"{tag}_in", config, f"{tag}_gap")
        ctes[f"{tag}_curved"] = (
            f"SELECT {WHO}, sum(c * p * (1 - p) * x * x) + {o.dbl(ridge)} AS h00, sum(c * p * (1 - p) * x * a) AS h01, sum(c * p * (1 - p) * a * a) + {o.dbl(ridge)} AS h11 "
            f"FROM (SELECT *, {_score('x')} AS p FROM {now} JOIN {tag}_in USING ({WHO})) GROUP BY {WHO}"
        )
        ctes[f"{tag}_way"] = (
            f"SELECT {WHO}, t0, t1, g, multiplier, ema, (h11 * e0 - h01 * e1) / (h00 * h11 - h01 * h01) AS h0, (h00 * e1 - h01 * e0) / (h00 * h11 - h01 * h01) AS h1 FROM "
            f"(SELECT {WHO}, q.t0, q.t1, g, l.multiplier, l.ema, v0 + (l.multiplier + {o.dbl(config.rho)} * g) * d0 AS e0, v1 + (l.multiplier + {o.dbl(config.rho)} * g) * d1 AS e1 "
            f"FROM {tag}_gap q JOIN {loop} l USING ({WHO})) JOIN {tag}_curved USING ({WHO})"
        )
        move = f"{o.dbl(config.step_x)} * c * (p * (1 - p) * (x * h0 + a * h1) * t0 + (p - y) * h0)"
        bounded = f"greatest({o.dbl(-config.feature_limit)}, least({o.dbl(config.feature_limit)}, x + {move}))"
        ctes[f"{tag}_pts"] = (
            f"SELECT {POINT}, CASE WHEN t0 IS NULL THEN x ELSE {bounded} END AS x, factor, w, c FROM (SELECT *, {_score('x')} AS p FROM {now} LEFT JOIN {tag}_way USING ({WHO}))"
        )
        ema = f"{o.dbl(1 - config.ema_beta)} * ema + {o.dbl(config.ema_beta)} * g"
        ctes[f"{tag}_l"] = (
            f"SELECT {WHO}, t0, t1, multiplier + {o.dbl(config.rho)} * ({ema}) AS multiplier, {ema} AS ema, g AS gap, {j} AS steps, {ema} > {o.dbl(config.epsilon)} AS going FROM {tag}_way "
            f"UNION ALL SELECT {WHO}, t0, t1, multiplier, ema, gap, steps, going FROM {loop} WHERE NOT going"
        )
        now, loop = f"{tag}_pts", f"{tag}_l"
    return ctes | {f"{name}_done": f"SELECT * FROM {loop}", f"{name}_points": f"SELECT * FROM {now}"}


def _fit(rows: str, anchor: str, strength: float, name: str) -> dict[str, str]:
    """CTEs of Newton steps on ``rows(x, a, y)`` from and around the row (z0, z1) of ``anchor``; the last one is ``{name}(z0, z1)``."""
    ridge = o.dbl(strength / 4)
    ctes = {f"{name}_0": f"SELECT z0 AS t0, z1 AS t1 FROM {anchor}"}
    for k in range(1, FIT_STEPS + 1):
        sums = (
            f"SELECT t0, t1, avg((p - y) * x) + {ridge} * (t0 - any_value(z0)) AS g0, avg((p - y) * a) + {ridge} * (t1 - any_value(z1)) AS g1, avg(p * (1 - p) * x * x) + {ridge} AS h00, "
            f"avg(p * (1 - p) * x * a) AS h01, avg(p * (1 - p) * a * a) + {ridge} AS h11 FROM (SELECT *, {_score('x')} AS p FROM {rows}, {name}_{k - 1}, {anchor}) GROUP BY t0, t1"
        )
        ctes[f"{name}_{k}"] = f"SELECT t0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS t0, t1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS t1 FROM ({sums})"
    return ctes | {name: f"SELECT t0 AS z0, t1 AS z1 FROM {name}_{FIT_STEPS}"}


def _sql(select: str, **ctes: str) -> str:
    """Every step is worked out once, although several later ones read it."""
    text = o.query(select, "payload", "batch", "syn_quotas", **ctes)
    for name in ("payload", "batch", "syn_quotas", *ctes):
        text = text.replace(f" {name} AS (", f" {name} AS MATERIALIZED (", 1)
    return text


FIXED = {"anchor": f"SELECT {o.dbl(START[0])} AS z0, {o.dbl(START[1])} AS z1"}
FROM_ANCHOR = f"(SELECT DISTINCT {WHO}, z0 AS t0, z1 AS t1 FROM pts, anchor)"


def one_feature_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minibatch, synthetic rows and pseudo-positives of two rounds, on their first feature."""
    batch, stats, quotas = parts_of(spark, sf_dir)
    real = batch.select("round", "client_id", F.lit("batch").alias("kind"), F.col("row_id").alias("pt_id"), "a", "y", "x")
    points = real.unionByName(payload_from(batch, stats, quotas).select(*real.columns))
    return points.withColumn("x", F.slice("x", 1, 1))


def _numbers(refined: DataFrame) -> list:
    return [F.round(c, 5).alias(c) for c in ("gap", "ema", "multiplier")]


_STATE = ", ".join(f"{o.rnd(c, 5)} AS {c}" for c in ("gap", "ema", "multiplier"))


@register(
    "f9_refinement_loop",
    _sql(
        f"SELECT {POINT}, steps, {_STATE}, {o.rnd('x', 5)} AS v0, CAST(NULL AS DOUBLE) AS v1 FROM r_points JOIN r_done USING ({WHO}) "
        f"UNION ALL SELECT {WHO}, 'theta' AS kind, 'theta' AS pt_id, 0 AS a, 0 AS y, steps, {_STATE}, {o.rnd('t0', 5)} AS v0, {o.rnd('t1', 5)} AS v1 FROM r_done",
        **FIXED,
        **_weights(True, LOOP.universum_strength),
        **_outer("pts", FROM_ANCHOR, "anchor", LOOP, "r"),
    ),
)
def refinement_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole loop of every client: five inner steps, two outer ones, stop rule included."""
    refined = refine.refine_clients(one_feature_points(spark, sf_dir), START, LOOP)
    values = [F.round(F.get("x", F.lit(i)), 5).alias(f"v{i}") for i in (0, 1)]
    return refined.select("round", "client_id", "kind", "pt_id", "a", "y", "steps", *_numbers(refined), *values)


LOCAL = dataclasses.replace(LOOP, inner_steps=20, weighted=False)


@register(
    "f10_local_loop",
    _sql(
        f"SELECT {WHO}, {o.rnd('g', 5)} AS gap, {o.rnd('t0', 5)} AS theta0, {o.rnd('t1', 5)} AS theta1 FROM gaps",
        **FIXED,
        **_weights(False, LOCAL.universum_strength),
        **_inner("pts", FROM_ANCHOR, "anchor", LOCAL.strength_inner, LOCAL, "fitted"),
        **_gaps("fitted", LOCAL, "gaps"),
    ),
)
def local_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local fit of every client, twenty steps."""
    fitted = refine.refine_clients(one_feature_points(spark, sf_dir), START, LOCAL, move=False).where("kind = 'theta'")
    return fitted.select("round", "client_id", F.round("gap", 5).alias("gap"), *[F.round(F.col("x")[i], 5).alias(f"theta{i}") for i in (0, 1)])


def _round(t: int) -> dict[str, str]:
    """CTEs of a round: refinement from the weights of the round before, and the fit to all clients' points; ``after{t}`` is its result."""
    before = "anchor" if t == 0 else f"after{t - 1}"
    own = f"round{t}"
    start = f"(SELECT DISTINCT {WHO}, z0 AS t0, z1 AS t1 FROM {own}, {before})"
    return {own: f"SELECT * FROM pts WHERE round = {t}", **_outer(own, start, before, ROUNDS.solver, f"r{t}"), **_fit(f"r{t}_points", before, ROUNDS.strength, f"after{t}")}


@register(
    "f13_two_rounds",
    _sql(
        f"SELECT round, {o.rnd('z0', 5)} AS theta0, {o.rnd('z1', 5)} AS theta1, {o.metrics('accuracy', 'eo_gap', 'tpr0', 'tpr1', 'f1')} FROM (SELECT round, z0, z1, {o.outcome_cells()} FROM judged GROUP BY round, z0, z1)",
        anchor="SELECT 0.0::DOUBLE AS z0, 0.0::DOUBLE AS z1",
        **_weights(True, ROUNDS.solver.universum_strength),
        **_round(0),
        **_round(1),
        judged="SELECT round, z0, z1, a, y, CAST(z0 * l_quantity + z1 * a > 0 AS INT) AS pred FROM lines, (SELECT 0 AS round, * FROM after0 UNION ALL SELECT 1 AS round, * FROM after1)",
    ),
)
def two_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of refinement, release and fit; their weights, judged on all line items."""
    points = one_feature_points(spark, sf_dir)
    thetas = train_rounds(points, ROUNDS, 1)
    lines = views.labelled_lines(spark, sf_dir).withColumn("x", F.slice("x", 1, 1))
    logs = judge_weights(lines, thetas, 1)
    weights = spark.createDataFrame([(t, round(z[0], 5), round(z[1], 5)) for t, z in thetas.items()], "round int, theta0 double, theta1 double")
    return logs.join(weights, "round").select("round", "theta0", "theta1", *[F.round(c, 6).alias(c) for c in ("accuracy", "eo_gap", "tpr0", "tpr1", "f1")])
