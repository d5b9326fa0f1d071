"""Queries for objectives at fixed weights, model fits and the round driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.functions import vectors
from evenhand.operators import metrics, objectives as f, prepare, refine, splits, training
from evenhand.plans import oracle as o, views
from evenhand.plans.catalog import register
from evenhand.plans.catalog.synthesizing import parts_of, payload_from
from evenhand.plans.datasets import Prepared
from evenhand.plans.rounds import RunConfig, judge_weights, model_results, round_points, run_experiment
from evenhand.plans.views import ANCHOR, CLIENTS, SEED, THETA, WIDTH

STRENGTH = 0.1
UNIVERSUM = 0.5
RHO = 0.5
MULTIPLIER = 0.3
PENALTY = f.ridge(THETA, ANCHOR, STRENGTH)
OUTER_PENALTY = f.ridge(THETA, [0.0] * len(THETA), STRENGTH)


def _margin_loss(score: str, label: str) -> str:
    return f"ln(1.0::DOUBLE + exp(-greatest((2 * {label} - 1) * {score}, -50.0::DOUBLE)))"


def _soft(group: int) -> str:
    return f"coalesce(avg(CASE WHEN y = 1 AND a = {group} THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-10.0::DOUBLE * (f - 0.0::DOUBLE))) END), 0.0::DOUBLE)"


def scored_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Payload (with the imbalance of its client) and minibatch, scored; the batch is drawn once."""
    batch, stats, quotas = parts_of(spark, sf_dir)
    imbalance = quotas.select("round", "client_id", "delta_s")
    scored = payload_from(batch, stats, quotas).withColumn("f", vectors.score("x", "a", THETA))
    return scored.join(imbalance, ["round", "client_id"]), batch.withColumn("f", vectors.score("x", "a", THETA))


@register("f1_logistic_loss", o.query(f"SELECT row_id, {o.rnd(_margin_loss('f', 'y'), 9)} AS loss FROM scored", "scored"))
def logistic_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = views.scored_lines(spark, sf_dir)
    return scored.select("row_id", F.round(f.logistic_loss(F.col("f"), F.col("y")), 9).alias("loss"))


@register(
    "f2_base_loss",
    o.query(
        f"SELECT client_id, {o.rnd('avg(' + _margin_loss('f', 'y') + ') + ' + o.dbl(PENALTY), 9)} AS base, "
        f"{o.rnd('avg(' + _margin_loss('f', 'y') + ') + ' + o.dbl(f.ridge(THETA, ANCHOR, STRENGTH, scaled=True)), 9)} AS base_scaled FROM scored GROUP BY client_id",
        "scored",
    ),
)
def base_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scored_lines(spark, sf_dir).groupBy("client_id").agg(
        F.round(f.base_loss(PENALTY), 9).alias("base"),
        F.round(f.base_loss(f.ridge(THETA, ANCHOR, STRENGTH, scaled=True)), 9).alias("base_scaled"),
    )


_UNI_LOSS = (
    f"CASE WHEN max(delta_s) > 0 THEN coalesce({o.dbl(UNIVERSUM)} * avg(CASE WHEN kind = 'universum' THEN {_margin_loss('f', '1')} END), 0.0::DOUBLE) ELSE 0.0::DOUBLE END"
)


@register(
    "f3_universum_loss",
    o.query(f"SELECT round, client_id, {o.rnd(_UNI_LOSS)} AS loss FROM payload_scored GROUP BY round, client_id", "payload_scored"),
)
def universum_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.col("kind") == "universum"
    payload, _ = scored_parts(spark, sf_dir)
    return payload.groupBy("round", "client_id").agg(
        F.round(f.universum_loss(UNIVERSUM, F.max("delta_s"), chosen), 6).alias("loss")
    )


@register(
    "f4_smooth_tpr",
    o.query(f"SELECT client_id, {o.rnd(_soft(0))} AS tpr0, {o.rnd(_soft(1))} AS tpr1 FROM scored GROUP BY client_id", "scored"),
)
def smooth_tpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scored_lines(spark, sf_dir).groupBy("client_id").agg(
        F.round(f.smooth_tpr(0), 6).alias("tpr0"), F.round(f.smooth_tpr(1), 6).alias("tpr1")
    )


_GAP = "CASE WHEN positives > 0 THEN sqrt((t1 - t0) * (t1 - t0) + 1e-12::DOUBLE) ELSE 0.0::DOUBLE END"
_TERMS = f"{_soft(0)} AS t0, {_soft(1)} AS t1, sum(y) AS positives, avg({_margin_loss('f', 'y')}) + {o.dbl(OUTER_PENALTY)} AS outer_loss"


@register(
    "f5_smooth_gap",
    o.query(f"SELECT client_id, {o.rnd(_GAP)} AS gap FROM (SELECT client_id, {_TERMS} FROM scored GROUP BY client_id)", "scored"),
)
def smooth_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = f.fairness_terms(views.scored_lines(spark, sf_dir), ["client_id"], OUTER_PENALTY)
    return terms.select("client_id", F.round("gap", 6).alias("gap"))


@register(
    "f6_objectives",
    o.query(
        f"SELECT round, client_id, {o.rnd('inner_value')} AS inner, {o.rnd('outer_loss')} AS outer_loss, "
        f"{o.rnd(f'outer_loss + {o.dbl(MULTIPLIER)} * gap + {o.dbl(RHO / 2)} * gap * gap')} AS augmented FROM "
        f"(SELECT round, client_id, avg(CASE WHEN kind = 'synthetic' THEN {_margin_loss('f', 'y')} END) + {o.dbl(PENALTY)} + {_UNI_LOSS} AS inner_value FROM payload_scored GROUP BY round, client_id) "
        f"JOIN (SELECT round, client_id, outer_loss, {_GAP} AS gap FROM (SELECT round, client_id, {_TERMS} FROM batch_scored GROUP BY round, client_id)) USING (round, client_id)",
        "payload_scored",
        "batch_scored",
    ),
)
def all_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["round", "client_id"]
    payload, batch = scored_parts(spark, sf_dir)
    inner = f.inner_objective(payload, by, PENALTY, UNIVERSUM)
    outer = f.fairness_terms(batch, by, OUTER_PENALTY)
    augmented = f.augmented_objective(F.col("outer_loss"), F.col("gap"), MULTIPLIER, RHO)
    return inner.join(outer, by).select(
        *by, F.round("inner", 6).alias("inner"), F.round("outer_loss", 6).alias("outer_loss"),
        F.round(augmented, 6).alias("augmented"),
    )


def training_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised line items as training rows."""
    scaled = prepare.standardize(views.line_columns(spark, sf_dir), views.LINE_FEATURES)
    return scaled.select("row_id", "client_id", "a", "y", vectors.assemble(views.LINE_FEATURES).alias("x"))


FIT_FEATURE = "l_quantity"
FIT_ANCHOR = [0.5, -0.3]
NEWTON_STEPS = 8


def newton(rows: str, strength: float, anchor: list[float], name: str = "n") -> dict[str, str]:
    """CTEs of Newton steps on ``rows(x, a, y)``, two weights each; the last one is ``{name}``."""
    pull = [f"{o.dbl(strength / 4)} * (t{i} - {o.dbl(z)})" for i, z in enumerate(anchor)]
    ctes = {f"{name}0": f"SELECT {o.dbl(anchor[0])} AS t0, {o.dbl(anchor[1])} AS t1"}
    for k in range(1, NEWTON_STEPS + 1):
        p = f"SELECT x, a, y, t0, t1, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(t0 * x + t1 * a))) AS p FROM {rows}, {name}{k - 1}"
        sums = (
            f"SELECT t0, t1, avg((p - y) * x) + {pull[0]} AS g0, avg((p - y) * a) + {pull[1]} AS g1, avg(p * (1 - p) * x * x) + {o.dbl(strength / 4)} AS h00, "
            f"avg(p * (1 - p) * x * a) AS h01, avg(p * (1 - p) * a * a) + {o.dbl(strength / 4)} AS h11 FROM ({p}) GROUP BY t0, t1"
        )
        last = name if k == NEWTON_STEPS else f"{name}{k}"
        ctes[last] = f"SELECT t0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS t0, t1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS t1 FROM ({sums})"
    return ctes


SCALED = f"SELECT client_id, a, y, ({FIT_FEATURE} - avg({FIT_FEATURE}) OVER ()) / stddev_pop({FIT_FEATURE}) OVER () AS x FROM lines"


def scaled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One standardised feature of the line items."""
    scaled = prepare.standardize(views.line_columns(spark, sf_dir), [FIT_FEATURE])
    return scaled.select("row_id", "client_id", "a", "y", vectors.assemble([FIT_FEATURE]).alias("x"))


def exact_fit(rows: DataFrame, strength: float, anchor: list[float]) -> list[float]:
    """Weights to more digits than a run needs."""
    return training.fit_anchored(rows, 1, strength, anchor, tolerance=1e-12).weights


def _fitted(spark: SparkSession, theta: list[float], rows: DataFrame) -> DataFrame:
    """Weights, and how they do per client."""
    judged = rows.withColumn("pred", vectors.predict(vectors.score("x", "a", theta)))
    report = metrics.evaluate(metrics.outcome_counts(judged, ["client_id"]), ["client_id"])
    weights = [F.lit(round(t, 4)).alias(f"theta{i}") for i, t in enumerate(theta)]
    return report.select("client_id", F.round("accuracy", 6).alias("accuracy"), F.round("eo_gap", 6).alias("eo_gap"), *weights)


def _fit_oracle(strength: float, anchor: list[float]) -> str:
    return o.query(
        f"SELECT client_id, {o.rnd(o.METRIC['accuracy'])} AS accuracy, {o.rnd(o.METRIC['eo_gap'])} AS eo_gap, round(t0, 4) AS theta0, round(t1, 4) AS theta1 "
        f"FROM (SELECT client_id, {o.outcome_cells()} FROM judged GROUP BY client_id), n",
        "lines",
        scaled=SCALED,
        **newton("scaled", strength, anchor),
        judged="SELECT client_id, a, y, CAST(t0 * x + t1 * a > 0 AS INT) AS pred FROM scaled, n",
    )


@register("f7_anchored_fit", _fit_oracle(0.4, FIT_ANCHOR))
def anchored_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled_lines(spark, sf_dir)
    return _fitted(spark, exact_fit(rows, 0.4, FIT_ANCHOR), rows)


@register(
    "f7_gradient_at_weights",
    o.query(
        "SELECT "
        + ", ".join(
            f"{o.rnd(f'avg((1.0::DOUBLE / (1.0::DOUBLE + exp(-f)) - y) * {v}) + {o.dbl(STRENGTH / 25 * (t - z))}', 4)} AS g{i}"
            for i, (v, t, z) in enumerate(zip([*views.LINE_FEATURES, "a"], THETA, ANCHOR))
        )
        + " FROM scored",
        "scored",
    ),
)
def gradient_at_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the anchored objective at the fixed weights: zero only where they are optimal."""
    rows = views.labelled_lines(spark, sf_dir).withColumn("f", vectors.score("x", "a", THETA))
    pull = [STRENGTH / (WIDTH + 1) ** 2 * (t - z) for t, z in zip(THETA, ANCHOR)]
    gradient = f.mean_gradient(rows, "x", WIDTH, pull)
    return gradient.select(*[F.round(c, 4).alias(c) for c in gradient.columns])


@register("f8_baseline_fit", _fit_oracle(1e-4, [0.0, 0.0]))
def baseline_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled_lines(spark, sf_dir)
    return _fitted(spark, exact_fit(rows, 1e-4, [0.0, 0.0]), rows)


def _client_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_lines(spark, sf_dir)
    return round_points(rows, SEED, 1, WIDTH, CLIENTS)


def _solver_report(refined: DataFrame) -> DataFrame:
    local = refined.filter("kind = 'theta'").select(
        "round", "client_id", "steps", *[F.round(c, 4).alias(c) for c in ("gap", "ema", "multiplier")],
        *[F.round(F.col("x")[i], 4).alias(f"theta{i}") for i in range(WIDTH + 1)],
    )
    points = refined.filter("kind <> 'theta'").groupBy("round", "client_id").agg(
        F.count("*").alias("n_points"),
        F.round(F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))), 4).alias("largest_feature"),
    )
    return local.join(points, ["round", "client_id"])


@register("f9_client_refinement")
def client_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = refine.RefineConfig(rho=0.05, epsilon=0.1, inner_steps=100)
    return _solver_report(refine.refine_clients(_client_points(spark, sf_dir), [0.0] * (WIDTH + 1), config))


STEP = refine.RefineConfig(
    inner_steps=0, outer_steps=1, weighted=False, rho=0.5, strength_inner=0.4, strength_outer=0.1, universum_strength=0.5, step_x=0.2, feature_limit=100.0
)
_T0, _T1 = 0.05, -0.4
_U = o.dbl(STEP.universum_strength)


def _curvature(side: str) -> str:
    return f"CASE WHEN u.n > 0 AND delta_s > 0 THEN s.{side} + {_U} * u.{side} ELSE s.{side} END"


@register(
    "f9_refinement_step",
    o.query(
        f"SELECT round, client_id, kind, pt_id, a, y, {o.rnd('g', 5)} AS gap, {o.rnd(f'greatest(-100.0::DOUBLE, least(100.0::DOUBLE, v + {o.dbl(STEP.step_x)} * factor / n * (p * (1 - p) * (v * h0 + a * h1) * {o.dbl(_T0)} + (p - y) * h0)))', 5)} AS v "
        f"FROM (SELECT *, CASE WHEN kind = 'synthetic' THEN 1.0::DOUBLE WHEN delta_s > 0 THEN {_U} ELSE 0.0::DOUBLE END AS factor FROM pts JOIN (SELECT round, client_id, kind, n FROM curved) USING (round, client_id, kind) JOIN direction USING (round, client_id))",
        "payload",
        "batch",
        pts=f"SELECT round, client_id, kind, pt_id, a, y, v, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({o.dbl(_T0)} * v + {o.dbl(_T1)} * a))) AS p FROM payload WHERE j = 0",
        curved="SELECT round, client_id, kind, count(*) AS n, avg(p * (1 - p) * v * v) AS c00, avg(p * (1 - p) * v * a) AS c01, avg(p * (1 - p) * a * a) AS c11 FROM pts GROUP BY round, client_id, kind",
        real=f"SELECT round, client_id, a, y, x[1] AS v, {o.dbl(_T0)} * x[1] + {o.dbl(_T1)} * a AS f FROM batch",
        soft="SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-10.0::DOUBLE * f)) AS s, 1.0::DOUBLE / (1.0::DOUBLE + exp(-f)) AS p FROM real",
        rates="SELECT round, client_id, sum(y) AS positives, "
        + ", ".join(
            f"coalesce(avg(CASE WHEN y = 1 AND a = {g} THEN s END), 0) AS r{g}, coalesce(avg(CASE WHEN y = 1 AND a = {g} THEN 10 * s * (1 - s) * v END), 0) AS d{g}0, "
            f"coalesce(avg(CASE WHEN y = 1 AND a = {g} THEN 10 * s * (1 - s) * a END), 0) AS d{g}1"
            for g in (0, 1)
        )
        + f", avg((p - y) * v) + {o.dbl(STEP.strength_outer * _T0)} AS o0, avg((p - y) * a) + {o.dbl(STEP.strength_outer * _T1)} AS o1 FROM soft GROUP BY round, client_id",
        gaps="SELECT *, CASE WHEN positives > 0 THEN sqrt((r1 - r0) * (r1 - r0) + 1e-12::DOUBLE) ELSE 0.0::DOUBLE END AS g FROM rates",
        slopes="SELECT *, " + ", ".join(f"o{i} + CASE WHEN g > 0 THEN {o.dbl(STEP.rho)} * (r1 - r0) * (d1{i} - d0{i}) ELSE 0.0::DOUBLE END AS v{i}" for i in (0, 1)) + " FROM gaps",
        hessian=f"SELECT s.round, s.client_id, q.delta_s, {_curvature('c00')} + {o.dbl(STEP.strength_inner / 4)} AS h00, {_curvature('c01')} AS h01, {_curvature('c11')} + {o.dbl(STEP.strength_inner / 4)} AS h11 "
        "FROM (SELECT * FROM curved WHERE kind = 'synthetic') s LEFT JOIN (SELECT * FROM curved WHERE kind = 'universum') u USING (round, client_id) JOIN (SELECT round, client_id, delta_s FROM syn_quotas) q USING (round, client_id)",
        direction="SELECT round, client_id, delta_s, g, (h11 * v0 - h01 * v1) / (h00 * h11 - h01 * h01) AS h0, (h00 * v1 - h01 * v0) / (h00 * h11 - h01 * h01) AS h1 FROM hessian JOIN slopes USING (round, client_id)",
    ),
)
def refinement_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outer step from fixed weights on one feature: gap, direction and moved points."""
    batch, stats, quotas = parts_of(spark, sf_dir)
    real = batch.select("round", "client_id", F.lit("batch").alias("kind"), F.col("row_id").alias("pt_id"), "a", "y", "x")
    points = real.unionByName(payload_from(batch, stats, quotas).select(*real.columns)).withColumn("x", F.slice("x", 1, 1))
    moved = refine.refine_clients(points, [_T0, _T1], STEP).filter("kind <> 'theta'")
    return moved.select("round", "client_id", "kind", "pt_id", "a", "y", F.round("gap", 5).alias("gap"), F.round(F.col("x")[0], 5).alias("v"))


@register("f10_local_fit")
def local_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = refine.RefineConfig(inner_steps=100, weighted=False)
    return _solver_report(refine.refine_clients(_client_points(spark, sf_dir), [0.0] * (WIDTH + 1), config, move=False))


_STEP_GAPS = f"SELECT client_id, l_linenumber AS step, {o.METRIC['eo_gap']} AS gap FROM (SELECT client_id, l_linenumber, {o.outcome_cells()} FROM predicted GROUP BY client_id, l_linenumber)"
_EMA = (
    "SELECT client_id, step, gap, 0.15::DOUBLE * gap AS ema FROM gaps WHERE step = 1 UNION ALL "
    "SELECT g.client_id, g.step, g.gap, 0.85::DOUBLE * e.ema + 0.15::DOUBLE * g.gap FROM ema e JOIN gaps g ON g.client_id = e.client_id AND g.step = e.step + 1"
)


def _recursive(select: str) -> str:
    return o.query(select, "predicted", gaps=_STEP_GAPS, ema=_EMA).replace("WITH ", "WITH RECURSIVE ", 1)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["client_id", "l_linenumber"]
    counts = metrics.outcome_counts(views.predicted_lines(spark, sf_dir, "l_linenumber"), by)
    gaps = counts.select("client_id", F.col("l_linenumber").alias("step"), metrics.eo_gap().alias("gap"))
    return f.moving_average(gaps, ["client_id"], "step", "gap")


@register("f11_moving_average", _recursive(f"SELECT client_id, step, {o.rnd('gap', 9)} AS gap, {o.rnd('ema', 9)} AS ema FROM ema"))
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select("client_id", "step", F.round("gap", 9).alias("gap"), F.round("ema", 9).alias("ema"))


EPSILON = 0.006


@register(
    "f12_multiplier_and_stop",
    _recursive(
        f"SELECT client_id, step, {o.rnd(f'sum({o.dbl(RHO)} * ema) OVER (PARTITION BY client_id ORDER BY step)', 9)} AS multiplier, "
        f"CAST(min(CASE WHEN abs(ema) <= {o.dbl(EPSILON)} THEN step END) OVER (PARTITION BY client_id) AS INT) AS stop_step FROM ema"
    ),
)
def multiplier_and_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f.multiplier_path(_steps(spark, sf_dir), ["client_id"], "step", RHO)
    stops = f.stopping_step(path, ["client_id"], "step", EPSILON)
    return path.join(stops, "client_id").select(
        "client_id", "step", F.round("multiplier", 9).alias("multiplier"), "stop_step"
    )


def _run_rows(spark: SparkSession, sf_dir: str) -> Prepared:
    """Line items parted into training and test rows, as a dataset of the round driver."""
    rows = splits.stratified_split(views.line_columns(spark, sf_dir).drop("client_id"), "row_id", SEED)
    return Prepared(
        rows.filter("split = 'train'").drop("split"), rows.filter("split = 'test'").drop("split"), views.LINE_FEATURES
    )


def run_of(spark: SparkSession, sf_dir: str, rounds: int = 8) -> DataFrame:
    """A full run in the published setting: 5 clients, 8 rounds, 100 inner steps."""
    config = RunConfig(
        clients=CLIENTS, rounds=rounds, seed=SEED, intercept=True, tune_threshold=True, noise_enabled=False,
        solver=refine.RefineConfig(rho=0.05, epsilon=0.1, inner_steps=100),
    )
    return run_experiment(_run_rows(spark, sf_dir), config, "lines")


@register("f13_round_driver")
def round_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation log of every round (also the per-round log of the evaluation rows)."""
    logs = run_of(spark, sf_dir).select(F.inline("round_logs"))
    return logs.select("round", *[F.round(c, 4).alias(c) for c in logs.columns if c != "round"])


ROUND_THETAS = {t: [w * (1.0 - 0.2 * t) for w in THETA[:-1]] + [THETA[-1] + 0.1 * t] for t in range(3)}
_LOG = ("accuracy", "eo_gap", "tpr0", "tpr1", "f1")


@register(
    "g9_validation_log",
    o.query(
        f"SELECT round, {o.metrics(*_LOG)} FROM (SELECT round, {o.outcome_cells()} FROM judged GROUP BY round)",
        "lines",
        judged=" UNION ALL ".join(
            f"SELECT {t} AS round, a, y, CAST({o.dot(theta, [*views.LINE_FEATURES, 'a'])} > 0 AS INT) AS pred FROM lines"
            for t, theta in ROUND_THETAS.items()
        ),
    ),
)
def validation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed weights of three rounds, judged on all line items in one pass."""
    logs = judge_weights(views.labelled_lines(spark, sf_dir), ROUND_THETAS, WIDTH)
    return logs.select("round", *[F.round(c, 6).alias(c) for c in _LOG])


CUTS = {"baseline": 0.1, "pipeline": 0.2}
_TUNED = {"accuracy": "accuracy", "F1_score": "f1", "EO_gap": "eo_gap", "TPR_group0": "tpr0", "TPR_group1": "tpr1"}
_EXTENDED = {"macro_F1": "macro_f1", "balanced_accuracy": "balanced_accuracy", "DP_gap": "dp_gap", "EOD_gap": "eod_gap"}
_AREAS = {"ROC_AUC": "roc_auc", "PR_AUC": "pr_auc"}


def _counted(source: str) -> str:
    return f"SELECT model, {o.outcome_cells()} FROM {source} GROUP BY model"


@register(
    "g10_final_result",
    o.query(
        "SELECT model, " + ", ".join(f"t.{n}" for n in _TUNED) + ", " + ", ".join(f"p.{n}" for n in _EXTENDED) + ", "
        + ", ".join(f"{o.rnd(c)} AS {n}" for n, c in _AREAS.items())
        + " FROM tuned t JOIN plain p USING (model) JOIN scores_areas USING (model)",
        "model_rows",
        scores="SELECT model, a, y, 1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least(f, 50.0::DOUBLE), -50.0::DOUBLE))) AS f, pred, CAST(model_rows.f > CASE model WHEN 'baseline' THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END AS INT) AS cut FROM model_rows",
        tuned="SELECT model, " + ", ".join(f"{o.rnd(o.METRIC[c])} AS {n}" for n, c in _TUNED.items())
        + f" FROM ({_counted('(SELECT model, a, y, cut AS pred FROM scores)')})",
        plain="SELECT model, " + ", ".join(f"{o.rnd(o.METRIC[c])} AS {n}" for n, c in _EXTENDED.items())
        + f" FROM ({_counted('scores')})",
        **{name: body for name, (_, body) in o.auc("scores", "model").items()},
    ),
)
def final_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result struct of both models at given thresholds, flattened."""
    results = model_results(views.labelled_lines(spark, sf_dir), views.MODELS, CUTS, WIDTH)
    flat = results.select("model", "result.*").select("*", "extended_metrics.*").drop("extended_metrics")
    return flat.select("model", *[F.round(c, 6).alias(c) for c in (*_TUNED, *_EXTENDED, *_AREAS)])
