"""The round driver: minibatches, refinement, release and fit over rounds, then one evaluation.

Minibatches do not depend on the model, so those of all rounds are drawn in one program and written
once, as a small table. A round then works on that table only. Likewise the weights of all rounds are
judged in one pass at the end. The data itself is read a fixed number of times, however many rounds.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evenhand.functions.vectors import assemble, predict, score, sigmoid
from evenhand.operators import metrics, noise, prepare, refine, sampling, splits, synthesis, training
from evenhand.operators.sizes import cut_lineage, written_tables
from evenhand.plans.datasets import Prepared
from evenhand.sources import schemas


# Clients whose points one task of a round's fit holds.
CLIENTS_PER_FIT_TASK = 16


# Threshold and sharpness of the smooth gap where none are chosen.
PLAIN_TAU, PLAIN_SHARPNESS = 0.0, 10.0


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run."""

    clients: int = 3
    partition: str = "iid"
    dirichlet_alpha: float = 1.0
    rounds: int = 3
    seed: int = 42
    val_share: float = 0.2
    scale: bool = True
    intercept: bool = False
    tune_threshold: bool = False
    universum: bool = True
    # Take the solver's threshold and sharpness for the smooth gap, else the plain ones.
    use_tpr_gap: bool = True
    # Let positives of earlier rounds stand in for a group that has none in a batch.
    buffer: bool = False
    fairness: bool = True
    refine_features: bool = True
    strength: float = 1e-4
    noise_enabled: bool = True
    noise_sigma: float = 1.0
    noise_variant: str = "post_server"
    min_rows: int = 1
    solver: refine.RefineConfig = field(default_factory=refine.RefineConfig)

    def __post_init__(self) -> None:
        if self.partition not in ("iid", "dirichlet", "natural"):
            raise ValueError(f"partition {self.partition!r} is not iid, dirichlet or natural")


def buffered_positives(batch: DataFrame, rounds: int, size: int = 50) -> DataFrame:
    """For every round the last positives of the rounds before, for the (client, group) pairs whose
    own batch of that round has none."""
    who = ["client_id", "a"]
    order = Window.partitionBy(*who).orderBy("round", "pos", "row_id")
    numbered = sampling.positive_slice(batch).withColumn("_n", F.row_number().over(order))
    # What each pair has seen before a round; a round without positives of its own is one that lacks them.
    counts = numbered.groupBy(*who, "round").agg(F.count("*").alias("_own"))
    every = counts.select(*who).distinct().withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    before = Window.partitionBy(*who).orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    seen = every.join(counts, [*who, "round"], "left").withColumn("_seen", F.coalesce(F.sum("_own").over(before), F.lit(0)))
    lacking = seen.filter(F.col("_own").isNull() & (F.col("_seen") > 0))
    wanted = lacking.select(*who, "round", F.explode(F.sequence(F.greatest(F.col("_seen") - (size - 1), F.lit(1)), F.col("_seen"))).alias("_n"))
    return numbered.drop("round").join(wanted, [*who, "_n"]).drop("_n")


def round_points(
    rows: DataFrame,
    seed: int,
    rounds: int,
    width: int,
    clients: int | None,
    universum: bool = True,
    buffer: bool = False,
) -> DataFrame:
    """Minibatch, synthetic rows and pseudo-positives of every round and client in one table."""
    batch = sampling.draw_minibatch(rows.select("row_id", "client_id", "a", "y", "x"), seed, rounds, clients=clients)
    # Everything below hangs on the batch, which is bounded by clients x rounds x 128 rows.
    batch = cut_lineage(batch)
    stats = sampling.minibatch_stats(batch)
    quotas = synthesis.synthetic_quotas(stats)
    points = synthesis.synthetic_rows(quotas, synthesis.stratum_moments(batch), seed)
    if universum:
        slots = synthesis.universum_slots(quotas, stats)
        points = synthesis.build_payload(points, synthesis.universum_rows(slots, batch, seed, width))
    real = batch.withColumn("kind", F.lit("batch"))
    if buffer:
        added = buffered_positives(batch, rounds).withColumn("kind", F.lit("buffer"))
        real = real.select(*real.columns).unionByName(added.select(*real.columns))
    own = real.select("round", "client_id", "kind", F.col("row_id").alias("pt_id"), "a", "y", "x")
    return own.unionByName(points)


def _weight_structs(thetas: Mapping[int, Sequence[float]], name: str) -> Column:
    return F.array(
        *[
            F.struct(F.lit(k).alias(name), F.array(*[F.lit(float(w)) for w in theta]).alias("theta"))
            for k, theta in thetas.items()
        ]
    )


def judge_weights(rows: DataFrame, thetas: Mapping[int, Sequence[float]], width: int, threshold: float = 0.0) -> DataFrame:
    """Threshold metrics of several weight vectors, keyed by ``round``, in one pass over the rows."""
    scored = rows.select("a", "y", "x", F.explode(_weight_structs(thetas, "round")).alias("_w")).select(
        "a", "y", F.col("_w.round").alias("round"), predict(score("x", "a", F.col("_w.theta"), width), threshold).alias("pred")
    )
    return metrics.evaluate(metrics.outcome_counts(scored, ["round"]), ["round"])


def keyed_rows(prepared: Prepared, config: RunConfig) -> DataFrame:
    """``(row_id, client_id, split, a, y, features...)`` with split train, val or test, written once.

    Even partitions are cut together with the validation split; the others are cut afterwards. The rows to be cut are written
    first: cutting reads them three times, and what is above them may be anything.
    """
    features = [F.col(c).cast("double").alias(c) for c in prepared.features]
    client = [F.col("client")] if config.partition == "natural" else []
    train = cut_lineage(prepared.train.select("row_id", "a", "y", *client, *features))
    if config.partition == "iid":
        parts = splits.split_and_partition(train, "row_id", config.seed, config.val_share, config.clients)
    else:
        parts = splits.split_by_count(train, "row_id", config.seed, config.val_share)
        parts = parts.withColumn("client_id", client[0] if client else F.lit(None).cast("int"))
    nobody = F.lit(None).cast(parts.schema["client_id"].dataType)
    test = prepared.test.withColumns({"split": F.lit("test"), "client_id": nobody})
    columns = ["row_id", "client_id", "split", "a", "y", *features]
    return cut_lineage(parts.select(*columns).unionByName(test.select(*columns)), ["split"])


def with_inputs(keyed: DataFrame, features: Sequence[str], config: RunConfig) -> DataFrame:
    """Scale by the moments of the training rows and assemble ``x``.

    The moments are a model-sized row: two numbers per feature, which become constants of the plan.
    """
    scaled = keyed
    if config.scale:
        moments = prepare.moments_of(keyed.filter("split = 'train'"), features).first()["moments"]
        scaled = keyed.withColumns(
            {c: (F.col(c) - F.lit(moments[c]["mean"])) / F.lit(moments[c]["scale"]) for c in features}
        )
    return scaled.select("row_id", "client_id", "split", "a", "y", assemble(features, config.intercept).alias("x"))


def client_rows(train: DataFrame, config: RunConfig) -> DataFrame:
    """The training rows with their client; small clients are left out where a minimum is set."""
    parted = train
    if config.partition == "dirichlet":
        shares = splits.dirichlet_shares([0, 1], config.clients, config.dirichlet_alpha, config.seed)
        parted = splits.partition_by_shares(train.drop("client_id"), "row_id", config.seed, shares)
    if config.min_rows > 1:
        bound = None if config.partition == "natural" else config.clients
        parted = splits.with_enough_rows(parted, config.min_rows, bound)
    return parted


def _solver(config: RunConfig) -> refine.RefineConfig:
    settings = config.solver if config.fairness else dataclasses.replace(config.solver, rho=0.0)
    return settings if config.use_tpr_gap else dataclasses.replace(settings, tau=PLAIN_TAU, sharpness=PLAIN_SHARPNESS)


def train_rounds(points: DataFrame, config: RunConfig, width: int) -> dict[int, list[float]]:
    """Weights after every round. Only the weights, a model-sized list, come to the driver."""
    return train_points(points, {"": config}, width)[""]


def train_points(points: DataFrame, configs: Mapping[str, RunConfig], width: int) -> dict[str, dict[int, list[float]]]:
    """Weights after every round for several settings over the same ``points``, in one program per round.

    Every setting refines its own copy of the points, keyed by its name, and all fits share their passes. The settings agree in all that
    makes the points and releases them.
    """
    one = next(iter(configs.values()))
    settings = {name: _solver(config) for name, config in configs.items()}
    release = noise.noise_config(one.noise_enabled, one.noise_sigma, one.noise_variant)
    plain = [name for name, config in configs.items() if not config.universum]
    still = [name for name, config in configs.items() if not config.refine_features]
    theta = {name: [0.0] * (width + 1) for name in configs}
    found: dict[str, dict[int, list[float]]] = {name: {} for name in configs}
    for t in range(one.rounds):
        own = points.filter(F.col("round") == t).withColumn("setting", F.explode(F.array(*[F.lit(name) for name in configs])))
        own = own.filter(~(F.col("setting").isin(plain) & (F.col("kind") == "universum"))) if plain else own
        sent = own.filter("kind IN ('synthetic', 'universum')")
        if len(still) < len(configs):
            moving = own.filter(~F.col("setting").isin(still)) if still else own
            moved = refine.refine_settings(moving, theta, settings).filter("kind <> 'theta'").select(*sent.columns)
            sent = moved.unionByName(sent.filter(F.col("setting").isin(still))) if still else moved
        payload = noise.release(sent.select("setting", "round", "client_id", "pt_id", "a", "y", "x"), release, one.seed)
        if one.partition != "natural":
            # A fit passes several times over a few hundred points per client: fewer tasks, less overhead.
            # A shuffle, so that the clients above it are still refined side by side.
            payload = payload.repartition(-(-one.clients * len(configs) // CLIENTS_PER_FIT_TASK))
        fits = training.fit_groups(payload, "setting", width, {name: config.strength for name, config in configs.items()}, theta)
        theta = {name: fits[name].weights for name in configs}
        for name in configs:
            found[name][t] = theta[name]
    return found


def scored_by_model(rows: DataFrame, models: Mapping[str, Sequence[float]], width: int) -> DataFrame:
    """``(model, a, y, f)``: every row scored by every model."""
    weighted = rows.select("a", "y", "x", F.explode(_weight_structs(models, "model")).alias("_w"))
    return weighted.select(F.col("_w.model").alias("model"), "a", "y", score("x", "a", F.col("_w.theta"), width).alias("f"))


def thresholds(rows: DataFrame, models: Mapping[str, Sequence[float]], width: int) -> dict[str, float]:
    """The validation-tuned threshold of every model, all from the same passes."""
    picked = metrics.pick_threshold(scored_by_model(rows, models, width), "f", ["model"], groups=len(models))
    return {row["model"]: float(row["threshold"]) for row in picked.collect()}


def model_results(
    test: DataFrame, models: Mapping[str, Sequence[float]], cuts: Mapping[str, float], width: int
) -> DataFrame:
    """``(model, result)``: metrics at the tuned threshold, and ``extended_metrics`` at threshold 0.

    The areas rank probabilities of clipped scores, so saturated scores tie.
    """
    scored = scored_by_model(test, models, width)
    cut = F.element_at(F.create_map(*[F.lit(v) for m, t in cuts.items() for v in (m, float(t))]), F.col("model"))
    judged = scored.withColumns({"tuned": predict(F.col("f"), cut), "plain": predict(F.col("f"))})
    counts = metrics.two_predictions(judged, ["model"], "tuned", "plain")
    report = metrics.evaluate(counts, ["model", "which"])
    extended = F.struct(
        F.col("pr_auc").alias("PR_AUC"),
        F.col("roc_auc").alias("ROC_AUC"),
        F.col("macro_f1").alias("macro_F1"),
        F.col("balanced_accuracy").alias("balanced_accuracy"),
        F.col("dp_gap").alias("DP_gap"),
        F.col("eod_gap").alias("EOD_gap"),
    )
    plain = (
        report.filter("which = 'plain'")
        .join(metrics.ranking_metrics(scored.withColumn("f", sigmoid(F.col("f"))), "f", ["model"]), "model")
        .select("model", extended.alias("extended_metrics"))
    )
    tuned = report.filter("which = 'tuned'").select(
        "model",
        "accuracy",
        F.col("f1").alias("F1_score"),
        F.col("eo_gap").alias("EO_gap"),
        F.col("tpr0").alias("TPR_group0"),
        F.col("tpr1").alias("TPR_group1"),
    )
    joined = tuned.join(plain, "model")
    return joined.select("model", F.struct(*[c for c in joined.columns if c != "model"]).alias("result"))


# What settings have to agree in to share their rows, draws and baseline.
SHARED = (
    "clients", "partition", "dirichlet_alpha", "rounds", "seed", "val_share", "scale", "intercept", "tune_threshold", "buffer", "strength",
    "noise_enabled", "noise_sigma", "noise_variant", "min_rows",
)


def run_experiment(prepared: Prepared, config: RunConfig, dataset: str) -> DataFrame:
    """A whole run; returns its result as one nested row (see ``schemas.RUN``).

    The tables that it writes on the way are deleted when it ends.
    """
    return run_settings(prepared, {"": config}, dataset).drop("setting")


def run_settings(prepared: Prepared, configs: Mapping[str, RunConfig], dataset: str) -> DataFrame:
    """A run for each of several settings: rows (setting, result...), results as in ``schemas.RUN``.

    Settings that agree in ``SHARED`` are one program: rows are cut and scaled, minibatches drawn and the baseline fitted once, and every
    pass over the data judges the models of all of them. Groups of settings that differ there follow each other.
    """
    groups: dict[tuple, dict[str, RunConfig]] = {}
    for name, config in configs.items():
        groups.setdefault(tuple(getattr(config, field) for field in SHARED), {})[name] = config
    spark: SparkSession = prepared.train.sparkSession
    documents = []
    for group in groups.values():
        with written_tables(spark):
            documents += _run(prepared, group, dataset)
    return spark.createDataFrame(documents, f"setting STRING, {schemas.RUN}")


def _run(prepared: Prepared, configs: Mapping[str, RunConfig], dataset: str) -> list[dict]:
    """The results of settings that share their data, as nested records."""
    config = next(iter(configs.values()))
    labelled = with_inputs(keyed_rows(prepared, config), prepared.features, config)
    train, val, test = (labelled.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test"))
    width = len(prepared.features) + (1 if config.intercept else 0)
    clients = None if config.partition == "natural" else config.clients
    universum = any(c.universum for c in configs.values())
    drawn = round_points(client_rows(train, config), config.seed, config.rounds, width, clients, universum, config.buffer)
    thetas = train_points(cut_lineage(drawn, ["round"]), configs, width)
    models = {BASELINE: training.fit_logistic(train, width, config.strength)}
    models |= {name: thetas[name][config.rounds - 1] for name in configs}
    # Rounds of all settings are judged together, numbered one after the other.
    numbered = {i * config.rounds + t: thetas[name][t] for i, name in enumerate(configs) for t in range(config.rounds)}
    logs = {row["round"]: row for row in judge_weights(val, numbered, width).collect()}
    cuts = thresholds(val, models, width) if config.tune_threshold else dict.fromkeys(models, 0.0)
    results = {row["model"]: row["result"].asDict(recursive=True) for row in model_results(test, models, cuts, width).collect()}
    return [
        {
            "setting": name,
            "baseline": results[BASELINE],
            "pipeline": {**results[name], **_settings(own, cuts[name], cuts[BASELINE])},
            "dataset": dataset,
            "round_logs": [_log(t, logs[i * config.rounds + t]) for t in range(config.rounds)],
        }
        for i, (name, own) in enumerate(configs.items())
    ]


# The baseline's name among the models; no setting can have it.
BASELINE = "<baseline>"


def _settings(config: RunConfig, cut: float, baseline_cut: float) -> dict:
    return {
        "num_clients": config.clients,
        "rounds": config.rounds,
        "use_tpr_gap": config.use_tpr_gap,
        "tpr_alpha": config.solver.sharpness,
        "tpr_tau": config.solver.tau,
        "ema_beta": config.solver.ema_beta,
        "use_importance_weighting": config.solver.weighted,
        "use_rolling_buffer": config.buffer,
        "dp_enabled": config.noise_enabled,
        "dp_sigma": config.noise_sigma,
        "dp_variant": noise.noise_config(config.noise_enabled, config.noise_sigma, config.noise_variant).variant,
        "stop_criterion": config.solver.stop,
        "outer_tol_xhat": config.solver.gradient_tolerance,
        "partition": config.partition,
        "dirichlet_alpha": config.dirichlet_alpha,
        "add_intercept": config.intercept,
        "tune_threshold": config.tune_threshold,
        "threshold_pipeline": cut,
        "threshold_baseline": baseline_cut,
    }


def _log(t: int, judged) -> dict:
    return {
        "round": t,
        "val_accuracy": judged["accuracy"],
        "val_EO_gap": judged["eo_gap"],
        "val_TPR_group0": judged["tpr0"],
        "val_TPR_group1": judged["tpr1"],
        "val_F1": judged["f1"],
    }
