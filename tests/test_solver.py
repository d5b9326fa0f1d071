import dataclasses
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from evenhand.functions.vectors import score
from evenhand.operators import objectives as f, refine, training

WIDTH = 3


def _points(seed=0, n=60):
    rng = np.random.default_rng(seed)

    def rows(kind, count, positive=None):
        a = rng.integers(0, 2, count)
        y = rng.integers(0, 2, count) if positive is None else (rng.random(count) < positive).astype(int)
        x = rng.normal(size=(count, WIDTH)) + y[:, None] * 0.5 + a[:, None] * 0.3
        return pd.DataFrame(
            {"round": 0, "client_id": 0, "kind": kind, "pt_id": [f"{kind}{i:03d}" for i in range(count)], "a": a, "y": y, "x": list(x)}
        )

    return pd.concat([rows("batch", n), rows("synthetic", 32, 0.3), rows("universum", 8, 1.0)], ignore_index=True)


def _phi(points, theta, cfg):
    batch = refine._Points(points[points.kind == "batch"], WIDTH)
    margin = (2 * batch.y - 1) * (batch.inputs @ theta)
    loss = np.mean(np.log1p(np.exp(-margin))) + cfg.strength_outer / 2 * theta @ theta
    gap, _ = refine._smooth_gap(batch, theta, cfg)
    return loss + cfg.rho / 2 * gap**2


def test_gap_gradient_matches_finite_differences():
    cfg = refine.RefineConfig()
    batch = refine._Points(_points()[lambda d: d.kind == "batch"], WIDTH)
    theta = np.array([0.2, -0.1, 0.3, 0.1])
    _, slope = refine._smooth_gap(batch, theta, cfg)
    for i in range(len(theta)):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        numeric = (refine._smooth_gap(batch, theta + step, cfg)[0] - refine._smooth_gap(batch, theta - step, cfg)[0]) / 2e-6
        assert slope[i] == pytest.approx(numeric, abs=1e-6)


def test_loss_gradient_and_curvature():
    part = refine._Points(_points()[lambda d: d.kind == "synthetic"], WIDTH)
    theta = np.array([0.2, -0.1, 0.3, 0.1])
    h = np.array([1.0, -2.0, 0.5, 0.3])
    eps = 1e-6
    change = (part.gradient(theta + eps * h) - part.gradient(theta - eps * h)) / (2 * eps)
    assert part.curvature(theta) @ h == pytest.approx(change, abs=1e-8)
    # Importance weights leave the curvature alone unless it is asked to take them.
    plain = part.curvature(theta)
    part.weight = refine._group_weights(part.a, part.y, 10.0)
    part.weight = part.weight / part.weight.sum()
    assert (part.curvature(theta) == plain).all()
    part.curved = part.weight
    change = (part.gradient(theta + eps * h) - part.gradient(theta - eps * h)) / (2 * eps)
    assert part.curvature(theta) @ h == pytest.approx(change, abs=1e-8)
    pull = part.feature_pull(theta, h)
    base = part.x.copy()
    part.x = base.copy()
    part.x[4, 1] += eps
    up = part.gradient(theta) @ h
    part.x[4, 1] -= 2 * eps
    down = part.gradient(theta) @ h
    assert pull[4, 1] == pytest.approx((up - down) / (2 * eps), abs=1e-8)


def test_descending_lowers_the_outer_objective_and_the_published_sign_raises_it():
    cfg = refine.RefineConfig(rho=5.0, outer_steps=1, inner_steps=600, step_x=0.3, damping=1e-6, strength_inner=0.5, weighted=False)
    points, anchor = _points(3), np.zeros(WIDTH + 1)

    def after(direction):
        moved = refine.refine_points(points, anchor, dataclasses.replace(cfg, direction=direction))
        own = moved[moved.kind != "theta"][["round", "client_id", "kind", "pt_id", "a", "y", "x"]]
        again = refine.refine_points(pd.concat([points[points.kind == "batch"], own]), anchor, cfg)
        return _phi(points, np.array(again[again.kind == "theta"].x.iloc[0]), cfg)

    start = refine.refine_points(points, anchor, cfg)
    before = _phi(points, np.array(start[start.kind == "theta"].x.iloc[0]), cfg)
    assert after("descend") < before < after("as_published")


def test_stop_rules_and_bounds():
    points, anchor = _points(1), np.zeros(WIDTH + 1)
    early = refine.refine_points(points, anchor, refine.RefineConfig(epsilon=0.25))
    assert early.steps.iloc[0] == 1  # the average starts at 0, so one step is always within 0.25
    corrected = refine.refine_points(points, anchor, refine.RefineConfig(epsilon=1e-9, corrected_ema=True, outer_steps=3))
    assert corrected.steps.iloc[0] == 3
    loose = refine.refine_points(points, anchor, refine.RefineConfig(stop="grad_inf", gradient_tolerance=1e9))
    assert loose.steps.iloc[0] == 1
    tight = refine.refine_points(points, anchor, refine.RefineConfig(step_x=1e6, epsilon=0.0, outer_steps=2, feature_limit=2.0))
    assert max(np.abs(np.stack(tight[tight.kind != "theta"].x)).ravel()) <= 2.0
    with pytest.raises(ValueError):
        refine.RefineConfig(stop="never")
    with pytest.raises(ValueError):
        refine.RefineConfig(direction="sideways")


def test_no_universum_single_class_and_buffer():
    points, anchor = _points(2), np.zeros(WIDTH + 1)
    alone = refine.refine_points(points[points.kind != "universum"], anchor, refine.RefineConfig())
    assert set(alone.kind) == {"synthetic", "theta"} and all(np.isfinite(v).all() for v in alone.x)
    negatives = points[~((points.kind == "batch") & (points.y == 1))]
    quiet = refine.refine_points(negatives, anchor, refine.RefineConfig())
    assert quiet.gap.iloc[0] == 0.0
    buffer = points[(points.kind == "batch") & (points.y == 1)].assign(kind="buffer")
    filled = refine.refine_points(pd.concat([negatives, buffer]), anchor, refine.RefineConfig())
    assert filled.gap.iloc[0] > 0.0


def _kinds(points, width):
    return {kind: refine._Points(points[points.kind == kind], width) for kind in ("synthetic", "universum")}


def _both_ways(monkeypatch, parts, theta, ridge, v):
    dense = refine._direction(parts, theta, ridge, v)
    monkeypatch.setattr(refine, "DENSE", 0)
    return dense, refine._direction(parts, theta, ridge, v)


def test_singular_curvature_has_a_direction(monkeypatch):
    rows = pd.DataFrame({"a": [0, 0], "y": [1, 0], "x": [[2.0], [-2.0]]})
    part = refine._Points(rows, 1)
    dense, free = _both_ways(monkeypatch, [(part, 1.0)], np.zeros(2), 0.0, np.array([1.0, 0.0]))
    assert dense == pytest.approx([1.0, 0.0]) and free == pytest.approx([1.0, 0.0])


def test_direction_without_a_matrix(monkeypatch):
    parts = _kinds(_points(5), WIDTH)
    theta, v = np.array([0.4, -0.2, 0.1, 0.3]), np.array([1.0, -2.0, 0.5, 0.1])
    dense, free = _both_ways(monkeypatch, [(parts["synthetic"], 1.0), (parts["universum"], 0.5)], theta, 0.01, v)
    assert free == pytest.approx(dense, rel=1e-4)


def test_refinement_without_a_matrix(monkeypatch):
    cfg, points, anchor = refine.RefineConfig(strength_inner=0.4, epsilon=0.0, outer_steps=4), _points(6), np.zeros(WIDTH + 1)
    dense = refine.refine_points(points, anchor, cfg)
    monkeypatch.setattr(refine, "DENSE", 0)
    free = refine.refine_points(points, anchor, cfg)
    assert np.allclose(np.concatenate(dense.x.tolist()), np.concatenate(free.x.tolist()), atol=1e-5)


def _wide(width, seed=3, n=60):
    rng = np.random.default_rng(seed)
    kinds = ["batch"] * n + ["synthetic"] * 40 + ["universum"] * 10
    labels = rng.integers(0, 2, len(kinds)) * np.array([k != "universum" for k in kinds]) | np.array([k == "universum" for k in kinds])
    labels[n : n + 40] = np.arange(40) < 12
    x = rng.normal(size=(len(kinds), width)) / np.sqrt(width)
    return pd.DataFrame({"round": 0, "client_id": 0, "kind": kinds, "pt_id": [str(i) for i in range(len(kinds))], "a": rng.integers(0, 2, len(kinds)), "y": labels.astype(int), "x": list(x)})


def test_wide_direction_agrees_with_the_dense_solve(monkeypatch):
    parts = _kinds(_wide(600), 600)
    theta, v = np.full(601, 0.01), np.random.default_rng(1).normal(size=601)
    free = refine._direction([(parts["synthetic"], 1.0), (parts["universum"], 0.5)], theta, 1e-3, v)
    monkeypatch.setattr(refine, "DENSE", 10_000)
    dense = refine._direction([(parts["synthetic"], 1.0), (parts["universum"], 0.5)], theta, 1e-3, v)
    assert np.linalg.norm(free - dense) < 1e-4 * np.linalg.norm(dense)


def test_five_thousand_features_are_refined_in_little_memory():
    points, anchor = _wide(5000), np.zeros(5001)
    tracemalloc.start()
    moved = refine.refine_points(points, anchor, refine.RefineConfig(inner_steps=5, outer_steps=2, epsilon=0.0))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300e6
    assert len(moved) == 51 and all(np.isfinite(x).all() for x in moved.x)


def test_local_fit_has_no_weights():
    points, anchor = _points(4), np.zeros(WIDTH + 1)
    plain = refine.refine_points(points, anchor, refine.RefineConfig(weighted=False), move=False)
    asked = refine.refine_points(points, anchor, refine.RefineConfig(weighted=True), move=False)
    assert all(np.array_equal(u, v) for u, v in zip(plain.x, asked.x))


def test_grouped_job_is_deterministic_and_keeps_labels(spark):
    both = pd.concat([_points(0), _points(5).assign(client_id=1)])
    rows = [tuple(r) for r in both.assign(x=both.x.map(lambda v: [float(z) for z in v])).itertuples(index=False, name=None)]
    df = spark.createDataFrame(rows, "round int, client_id int, kind string, pt_id string, a int, y int, x array<double>")
    cfg = refine.RefineConfig(inner_steps=20)
    first = refine.refine_clients(df, [0.0] * (WIDTH + 1), cfg)
    again = refine.refine_clients(df.repartition(6), [0.0] * (WIDTH + 1), cfg)
    assert first.exceptAll(again).isEmpty() and first.count() == 2 * (32 + 8 + 1)
    kept = first.filter("kind <> 'theta'").select("client_id", "pt_id", "a", "y")
    assert kept.exceptAll(df.select("client_id", "pt_id", "a", "y")).isEmpty()
    local = refine.refine_clients(df, [0.0] * (WIDTH + 1), cfg, move=False).filter("kind = 'synthetic'")
    assert local.select("client_id", "pt_id", "x").exceptAll(df.select("client_id", "pt_id", "x")).isEmpty()


def _training(spark, constant=False, n=600):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 2))
    a = rng.integers(0, 2, n)
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.7 * a - 0.3 + rng.logistic(size=n) > 0).astype(int)
    rows = [([*map(float, v), 1.0] if constant else [*map(float, v)], int(g), int(t)) for v, g, t in zip(x, a, y)]
    return spark.createDataFrame(rows, "x array<double>, a int, y int")


def test_both_fits_find_the_optimum(spark):
    df = _training(spark)
    first = training.fit_logistic(df, 2, 1e-4)
    for anchor in ([0.0, 0.0, 0.0], [0.4, -0.2, 0.3]):
        assert training.fit_shift(df, 2, 1e-4, anchor) == pytest.approx(first, abs=1e-3)
    gradient = f.mean_gradient(df.withColumn("f", score("x", "a", first)), "x", 2, [0.0] * 3).first()
    assert max(map(abs, gradient)) < 1e-3


def _gradient(df, theta, anchor, strength):
    """Length of the objective's gradient at the weights."""
    pull = [strength / len(theta) ** 2 * (t - z) for t, z in zip(theta, anchor)]
    found = f.mean_gradient(df.withColumn("f", score("x", "a", theta)), "x", len(theta) - 1, pull).first()
    return max(map(abs, found))


def test_constant_input_is_a_weight_like_others(spark):
    df = _training(spark, constant=True)
    for anchor in ([0.0] * 4, [0.2, 0.1, -0.4, 0.3]):
        fit = training.fit_anchored(df, 3, 0.5, anchor)
        assert fit.converged and 0 < fit.steps < training.MAX_STEPS
        assert fit.weights[2] != 0 and _gradient(df, fit.weights, anchor, 0.5) < 1e-4


def _by_library(df, width, strength):
    """Weights of Spark ML's fit at the same objective, each row with its mirror image."""
    z = F.concat("x", F.array(F.col("a").cast("double")))
    rows = df.select(z.alias("z"), F.col("y").cast("double").alias("y"))
    mirrored = rows.select(F.transform("z", lambda v: -v).alias("z"), (1 - F.col("y")).alias("y"))
    ready = rows.unionByName(mirrored).select("y", array_to_vector("z").alias("features"))
    model = LogisticRegression(featuresCol="features", labelCol="y", regParam=strength / (width + 1) ** 2, standardization=False, fitIntercept=False, maxIter=500, tol=1e-14)
    return [float(c) for c in model.fit(ready).coefficients]


@pytest.mark.parametrize("constant", [False, True])
def test_newton_steps_agree_with_the_library(spark, constant):
    df, width = _training(spark, constant), 3 if constant else 2
    fit = training.fit_anchored(df, width, 0.1, [0.0] * (width + 1))
    assert fit.weights == pytest.approx(_by_library(df, width, 0.1), abs=1e-6)
    assert fit.steps < 12


def test_steps_by_products_agree_with_solved_ones(spark, monkeypatch):
    df = _training(spark, constant=True)
    anchor = [0.2, 0.1, -0.4, 0.3]
    solved = training.fit_anchored(df, 3, 0.5, anchor).weights
    monkeypatch.setattr(training, "DENSE", 0)
    assert training.fit_anchored(df, 3, 0.5, anchor).weights == pytest.approx(solved, abs=1e-5)


def test_sums_of_many_tasks_meet_in_few(spark, monkeypatch):
    df = _training(spark)
    plain = training.fit_anchored(df.repartition(3), 2, 0.1, [0.0] * 3).weights
    monkeypatch.setattr(training, "FAN_IN", 2)
    monkeypatch.setattr(training, "BLOCK_BYTES", 64)
    assert training.fit_anchored(df.repartition(7), 2, 0.1, [0.0] * 3).weights == pytest.approx(plain, abs=1e-9)


def test_far_starts_take_shorter_steps(spark):
    df = _training(spark)
    near = training.fit_anchored(df, 2, 1e-4, [0.0] * 3).weights
    far = training.fit_anchored(df, 2, 1e-4, [60.0, 40.0, -50.0])
    assert far.converged and _gradient(df, far.weights, [60.0, 40.0, -50.0], 1e-4) < 1e-6
    assert far.weights == pytest.approx(near, abs=0.1)


def test_rows_of_another_width_are_refused(spark):
    with pytest.raises(Exception, match="does not hold 3 inputs"):
        training.fit_anchored(_training(spark), 3, 0.1, [0.0] * 4)


def test_separable_rows_stay_finite(spark):
    rows = [([float(i - 20), 1.0], i % 2, int(i > 20)) for i in range(41)]
    df = spark.createDataFrame(rows, "x array<double>, a int, y int")
    for theta in (training.fit_logistic(df, 2, 1e-4), training.fit_shift(df, 2, 1e-4, [0.1, 0.0, 0.0])):
        assert np.isfinite(theta).all() and theta[0] > 0


def test_no_rows_give_the_anchor(spark):
    df = _training(spark).limit(0)
    assert training.fit_anchored(df, 2, 1e-4, [0.3, 0.2, 0.1]) == training.Fit([0.3, 0.2, 0.1], 0, True)


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_gives_finite_weights(spark, label):
    rows = [([float(i % 5) - 2.0, 1.0], i % 2, label) for i in range(20)]
    df = spark.createDataFrame(rows, "x array<double>, a int, y int")
    for anchor in ([0.0] * 3, [0.5, -0.2, 0.1]):
        fit = training.fit_anchored(df, 2, 0.1, anchor)
        assert np.isfinite(fit.weights).all() and _gradient(df, fit.weights, anchor, 0.1) < 1e-4
        assert (fit.weights[1] > anchor[1]) == (label == 1)


def test_equal_rows_move_all_weights(spark):
    df = spark.createDataFrame([([2.0], 1, 1)] * 4, "x array<double>, a int, y int")
    fit = training.fit_anchored(df, 1, 0.4, [0.1, 0.0])
    assert _gradient(df, fit.weights, [0.1, 0.0], 0.4) < 1e-4


def test_five_thousand_inputs(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.normal(size=5000).tolist(), int(i % 2), int(rng.random() < 0.5)) for i in range(40)]
    df = spark.createDataFrame(rows, "x array<double>, a int, y int")
    anchor = [0.001] * 5001
    fit = training.fit_anchored(df, 5000, 10.0, anchor)
    assert len(fit.weights) == 5001 and np.isfinite(fit.weights).all()


def test_steps_that_do_not_suffice_are_reported(spark):
    with pytest.warns(UserWarning, match="not come to rest"):
        fit = training.fit_anchored(_training(spark), 2, 1e-4, [0.1, 0.0, 0.0], max_steps=1)
    assert not fit.converged


def test_losses_by_hand(spark):
    df = spark.createDataFrame([(0.0, 1, 1), (100.0, 0, 0), (-100.0, 1, 0)], "f double, y int, a int")
    got = [r[0] for r in df.select(f.logistic_loss(F.col("f"), F.col("y"))).collect()]
    assert got == pytest.approx([np.log(2), 50.0, 50.0])
    assert f.ridge([1.0, 2.0], [0.0, 0.0], 0.1) == pytest.approx(0.25)
    assert f.ridge([1.0, 2.0], [0.0, 0.0], 0.1, scaled=True) == pytest.approx(0.0625)
    terms = f.fairness_terms(df.filter("y = 0"), [], 0.0).first()
    assert (terms.gap, terms.tpr0, terms.tpr1) == (0.0, 0.0, 0.0)
    sided = f.fairness_terms(df.filter("f = 0"), [], 0.0).first()
    assert sided.gap == pytest.approx(0.5)


def test_average_multiplier_and_stops(spark):
    steps = spark.createDataFrame([(0, 1, 0.8, 5.0), (0, 2, 0.4, 1.0), (0, 3, 0.0, 0.1), (1, 1, 0.1, 0.5)], "run int, step int, g double, grad double")
    smooth = f.moving_average(steps, ["run"], "step", "g")
    path = f.multiplier_path(smooth, ["run"], "step", 0.5)
    got = {(r.run, r.step): (r.ema, r.multiplier) for r in path.collect()}
    assert got[(0, 2)] == (pytest.approx(0.85 * 0.12 + 0.06), pytest.approx(0.5 * (0.12 + 0.162)))
    stops = {r.run: (r.stop_step, r.last_step) for r in f.stopping_step(path, ["run"], "step", 0.05).collect()}
    assert stops == {0: (None, 3), 1: (1, 1)}
    by_gradient = f.gradient_stopping_step(steps, ["run"], "step", "grad", 0.2)
    assert {r.run: r.stop_step for r in by_gradient.collect()} == {0: 2, 1: None}


def test_long_average(spark):
    rng = np.random.default_rng(6)
    values = rng.random(3000)
    steps = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "run int, step int, g double")
    for beta in (0.001, 0.15, 0.9, 1.0):
        expected, last = [], 0.0
        for v in values:
            last = (1 - beta) * last + beta * v
            expected.append(last)
        got = [r.ema for r in f.moving_average(steps, ["run"], "step", "g", beta).orderBy("step").collect()]
        assert got == pytest.approx(expected, rel=1e-12)


def test_saturated_scores_tie(spark):
    from evenhand.plans.rounds import model_results

    df = spark.createDataFrame([([60.0], 0, 1), ([80.0], 0, 0), ([70.0], 1, 1), ([-60.0], 1, 0)], "x array<double>, a int, y int")
    found = model_results(df, {"m": [1.0, 0.0]}, {"m": 0.0}, 1).first().result.extended_metrics
    assert (found.ROC_AUC, found.PR_AUC) == (pytest.approx(0.75), pytest.approx(2 / 3))
