"""Analytics over experiment runs: grids, seed summaries, selection, frontiers and report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evenhand.functions.values import fixed, mean_and_spread, ratio

# Text that a report shows for a run that does not exist.
FAILED = "FAILED"


def config_grid(spark: SparkSession, axes: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the axis values, one row each."""
    grid = spark.range(1).select()
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


def pending(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid points without a result."""
    return grid.join(done.select(*keys).distinct(), list(keys), "left_anti")


def promoted(results: DataFrame, selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The result rows of the selected configurations."""
    return results.join(selected.select(*keys).distinct(), list(keys), "left_semi")


def run_fields(label: Column) -> list[Column]:
    """Configuration columns that are only written in the name of a run."""
    def number(tag: str) -> Column:
        found = F.regexp_extract(label, rf"{tag}([0-9]+(?:\.[0-9]+)?)", 1)
        return F.nullif(found, F.lit("")).cast("double").alias(tag)

    tag = F.nullif(F.regexp_extract(label, r"_ablation_([a-z]+)", 1), F.lit(""))
    return [
        F.regexp_extract(label, r"^([^_]+)", 1).alias("dataset"),
        number("rho"),
        number("eps"),
        number("alpha"),
        number("seed").cast("int").alias("seed"),
        tag.alias("ablation"),
        label.contains("_nouniversum").alias("universum_off"),
        label.contains("_final_").alias("final"),
    ]


def seed_summary(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, population spread and number of runs per configuration."""
    parts = []
    for m in metrics:
        parts += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return runs.groupBy(*keys).agg(*parts, F.count("*").alias("n"))


def by_model(results: DataFrame, keys: Sequence[str], models: Sequence[str] = ("baseline", "pipeline")) -> DataFrame:
    """One row per run and model, from a struct column per model."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), _model_metrics(m).alias("metrics")) for m in models])
    return results.select(*keys, F.inline(pairs)).select(*keys, "model", "metrics.*")


def _model_metrics(model: str) -> Column:
    own = {"accuracy": "accuracy", "f1": "F1_score", "eo_gap": "EO_gap"}
    extended = {
        "macro_f1": "macro_F1",
        "balanced_accuracy": "balanced_accuracy",
        "roc_auc": "ROC_AUC",
        "pr_auc": "PR_AUC",
        "dp_gap": "DP_gap",
        "eod_gap": "EOD_gap",
    }
    return F.struct(
        *[F.col(f"{model}.{source}").alias(name) for name, source in own.items()],
        *[F.col(f"{model}.extended_metrics.{source}").alias(name) for name, source in extended.items()],
    )


def _report(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    summary = seed_summary(rows, ["dataset", "model"], metrics)
    return summary.select(
        "dataset", "model", *[mean_and_spread(F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(m) for m in metrics]
    )


def performance_table(rows: DataFrame) -> DataFrame:
    """Six quality metrics per dataset and model, as ``mean +/- spread``."""
    return _report(rows, ["accuracy", "f1", "macro_f1", "balanced_accuracy", "roc_auc", "pr_auc"])


def fairness_table(rows: DataFrame) -> DataFrame:
    """The three gaps per dataset and model."""
    return _report(rows, ["dp_gap", "eo_gap", "eod_gap"])


def sensitivity_table(runs: DataFrame) -> DataFrame:
    """Sweep runs by dataset and falling accuracy; final, winner and skewed runs are left out."""
    swept = runs.filter(F.col("rho").isNotNull() & F.col("eps").isNotNull())
    kept = swept.filter(~F.col("label").contains("winner") & ~F.col("label").contains("dirichlet"))
    # The order is that of the printed accuracy, ties by name.
    return kept.orderBy(F.col("dataset"), fixed(F.col("accuracy")).cast("double").desc(), F.col("label")).select(
        "dataset", "variant", "rho", "eps", *[fixed(F.col(c)).alias(c) for c in ("accuracy", "eo_gap", "f1")]
    )


# What stands in the gap column where skew left no result. Fixed value.
STARVED = "ZeroDivisionError/RuntimeError: extreme skew starves a client of data"


def skew_table(
    expected: DataFrame, runs: DataFrame, keys: Sequence[str] = ("dataset", "partition"), even: str = "iid", reason: str = STARVED
) -> DataFrame:
    """Per dataset the even partition, if it has a run, then the skewed ones from mild to strong, FAILED with the
    reason where there is no run.

    The last key is the partition's name; skewed ones are ordered by the number in it, the mildest (largest) first.
    """
    *groups, partition = keys
    joined = expected.join(runs, list(keys), "left")
    is_even, missing = F.col(partition) == even, F.col("accuracy").isNull()
    size = F.regexp_extract(partition, r"([0-9.]+)", 1).try_cast("double")
    shown = joined.filter(~(is_even & missing)).orderBy(*groups, ~is_even, size.desc(), partition)
    return shown.select(
        *keys,
        F.when(missing, FAILED).otherwise(fixed(F.col("accuracy"))).alias("accuracy"),
        F.when(missing, reason).otherwise(fixed(F.col("eo_gap"))).alias("eo_gap"),
    )


def ablation_table(variants: DataFrame, runs: DataFrame) -> DataFrame:
    """Named variants that have a run, keyed by dataset, run label and seed."""
    return variants.join(runs, ["dataset", "label", "seed"]).select(
        "dataset", "variant", "seed", *[fixed(F.col(c)).alias(c) for c in ("accuracy", "eo_gap", "f1", "dp_gap", "eod_gap")]
    )


def sweep_points(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last validation log and test metrics of every run that has both."""
    return (
        results.filter(F.col("pipeline.accuracy").isNotNull() & (F.size("round_logs") > 0))
        .withColumn("_last", F.element_at("round_logs", -1))
        .select(
            *keys,
            F.col("_last.val_accuracy").alias("val_acc"),
            F.col("_last.val_EO_gap").alias("val_eo"),
            F.col("pipeline.accuracy").alias("test_acc"),
            F.col("pipeline.EO_gap").alias("test_eo"),
        )
    )


SWEEP_METRICS = ("val_acc", "val_eo", "test_acc", "test_eo")


def sweep_grid(points: DataFrame, keys: Sequence[str] = ("dataset", "universum_off", "rho")) -> DataFrame:
    return seed_summary(points, keys, SWEEP_METRICS)


def coverage(grid: DataFrame, results: DataFrame, keys: Sequence[str], seeds: int) -> DataFrame:
    """Configurations with fewer results than seeds, with the number they have."""
    have = results.groupBy(*keys).agg(F.count("*").alias("n"))
    joined = grid.join(have, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return joined.filter(F.col("n") < seeds)


def select_config(
    grid: DataFrame,
    target: float = 0.1,
    by: Sequence[str] = ("dataset",),
    tie: Sequence[str] = ("universum_off", "rho"),
    accuracy: str = "val_acc_mean",
    gap: str = "val_eo_mean",
) -> DataFrame:
    """Per dataset the most accurate configuration within the gap target; where none is, the fairest.

    A single aggregate; ties go to the first configuration in grid order.
    """
    feasible = F.col(gap) <= F.lit(float(target))
    order = F.struct(
        F.when(feasible, 0).otherwise(1),
        F.when(feasible, -F.col(accuracy)).otherwise(F.col(gap)),
        -F.col(accuracy),
        *[F.col(t) for t in tie],
    )
    rest = [c for c in grid.columns if c not in by]
    best = grid.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_best"))
    return best.select(*by, "_best.*")


def flag_selected(grid: DataFrame, selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    marked = selected.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return grid.join(marked, list(keys), "left").withColumn("selected", F.col("_hit").isNotNull()).drop("_hit")


def pareto_frontier(
    grid: DataFrame,
    by: Sequence[str] = ("dataset",),
    gap: str = "test_eo_mean",
    accuracy: str = "test_acc_mean",
    salts: int = 32,
) -> DataFrame:
    """Configurations that no other one beats on gap and accuracy; equal points are all kept.

    A point survives if it is the most accurate at its own gap and more accurate than everything
    fairer. Points are first reduced within salted parts, where most of them are already beaten.
    """

    def survivors(points: DataFrame, keys: Sequence[str]) -> DataFrame:
        best = points.groupBy(*keys, gap).agg(F.max(accuracy).alias(accuracy))
        fairer = Window.partitionBy(*keys).orderBy(gap).rowsBetween(Window.unboundedPreceding, -1)
        reached = F.max(accuracy).over(fairer)
        return best.withColumn("_reached", reached).filter(
            F.col("_reached").isNull() | (F.col(accuracy) > F.col("_reached"))
        ).drop("_reached")

    points = grid.select(*by, gap, accuracy).withColumn("_salt", F.pmod(F.xxhash64(gap, accuracy), F.lit(salts)))
    local = survivors(points, [*by, "_salt"]).drop("_salt")
    front = survivors(local, list(by))
    return grid.join(front, [*by, gap, accuracy], "left_semi")


def matched_points(
    frontier: DataFrame,
    reference: DataFrame,
    by: str = "dataset",
    gap: str = "test_eo_mean",
    accuracy: str = "test_acc_mean",
    config: Sequence[str] = ("universum_off", "rho"),
) -> DataFrame:
    """Compare a frontier with one reference point ``(dataset, ref_acc, ref_eo)`` per dataset.

    At matched accuracy: the frontier point nearest above the reference accuracy, else the most
    accurate one; at matched gap: the point nearest below the reference gap, else the fairest one.
    """
    joined = frontier.join(reference, by)
    point = F.struct(*config, F.col(accuracy).alias("acc"), F.col(gap).alias("eo"))
    tie = [F.col(c) for c in config]
    acc_ok, eo_ok = F.col(accuracy) >= F.col("ref_acc"), F.col(gap) <= F.col("ref_eo")
    by_accuracy = F.struct(
        F.when(acc_ok, 0).otherwise(1), F.when(acc_ok, F.col(accuracy)).otherwise(-F.col(accuracy)), F.col(gap), *tie
    )
    by_gap = F.struct(F.when(eo_ok, 0).otherwise(1), F.when(eo_ok, -F.col(gap)).otherwise(F.col(gap)), *tie)
    best = joined.groupBy(by, "ref_acc", "ref_eo").agg(
        F.min_by(point, by_accuracy).alias("at_acc"), F.min_by(point, by_gap).alias("at_eo")
    )
    return best.select(
        by,
        *[F.col(f"at_acc.{c}").alias(f"acc_match_{c}") for c in (*config, "acc", "eo")],
        (F.col("at_acc.acc") >= F.col("ref_acc")).alias("acc_match_reached"),
        F.when(F.col("at_acc.eo") < F.col("ref_eo"), "fairer").otherwise("less fair").alias("acc_match_verdict"),
        *[F.col(f"at_eo.{c}").alias(f"eo_match_{c}") for c in (*config, "acc", "eo")],
        (F.col("at_eo.eo") <= F.col("ref_eo")).alias("eo_match_reached"),
        F.when(F.col("at_eo.acc") > F.col("ref_acc"), "higher").otherwise("lower").alias("eo_match_verdict"),
    )


def convergence(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per run and round with accuracy and gap in percent; a run without logs has no rows."""
    logs = results.select(*keys, F.explode("round_logs").alias("_log"))
    return logs.select(
        *keys,
        F.col("_log.round").alias("round"),
        (F.col("_log.val_accuracy") * 100).alias("accuracy_pct"),
        (F.col("_log.val_EO_gap") * 100).alias("eo_gap_pct"),
    )


def distinct_baselines(runs: DataFrame) -> DataFrame:
    """One baseline per dataset and accuracy to four digits, the one of the first label.

    Runs without a result of the fair model (``pipe_acc``) are skipped before their baseline is looked at.
    """
    shown = runs.filter(F.col("pipe_acc").isNotNull() & F.col("base_acc").isNotNull())
    return shown.groupBy("dataset", F.round("base_acc", 4).alias("base_acc_key")).agg(
        F.min("label").alias("label"),
        F.min_by("base_acc", "label").alias("base_acc"),
        F.min_by("base_eo", "label").alias("base_eo"),
    )


def relative_change(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Percentage by which the fair model's metric lies below the baseline's."""
    def of(model: str, m: str) -> Column:
        return F.avg(F.when(F.col("model") == model, F.col(m)))

    means = rows.groupBy(*keys).agg(
        *[of("baseline", m).alias(f"_b_{m}") for m in metrics], *[of("pipeline", m).alias(f"_p_{m}") for m in metrics]
    )
    return means.select(
        *keys,
        *[
            (F.lit(100.0) * ratio(F.col(f"_b_{m}") - F.col(f"_p_{m}"), F.col(f"_b_{m}"))).alias(f"{m}_cut_pct")
            for m in metrics
        ],
    )


def nan_counts(results: DataFrame, keys: Sequence[str], doubles: Sequence[Column]) -> DataFrame:
    """``(keys..., n_values, n_nan)`` over the given double and array<double> expressions."""
    parts = F.concat(*[F.coalesce(d, F.array().cast("array<double>")) for d in doubles])
    flat = results.select(*keys, parts.alias("_v"))
    return flat.select(
        *keys,
        F.size(F.filter("_v", lambda v: v.isNotNull())).cast("bigint").alias("n_values"),
        F.size(F.filter("_v", lambda v: F.isnan(v))).cast("bigint").alias("n_nan"),
    )
