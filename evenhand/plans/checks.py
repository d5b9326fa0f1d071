"""Checks of whole runs: the baseline beside an independent fit, expected numbers, the effect of a part, and reruns."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from evenhand.functions.vectors import predict
from evenhand.operators import metrics, training
from evenhand.operators.sizes import written_tables
from evenhand.plans import rounds
from evenhand.plans.datasets import Prepared
from evenhand.plans.rounds import RunConfig, run_experiment, run_settings

# What two accuracies may differ by, as published.
TOLERANCE = 0.02
# Metrics of a result that a rerun has to repeat.
MODELS = ("baseline", "pipeline")


def baseline_agreement(prepared: Prepared, config: RunConfig, tolerance: float = TOLERANCE) -> DataFrame:
    """Test accuracies of the baseline and of Spark's own logistic regression on the same inputs: one row as ``metrics.agreement`` has it.

    The second fit has a free intercept and a penalty of one over the rows, the group is one of its inputs, and both cut at 0.
    """
    spark = prepared.train.sparkSession
    with written_tables(spark):
        labelled = rounds.with_inputs(rounds.keyed_rows(prepared, config), prepared.features, config)
        train, test = (labelled.filter(F.col("split") == s) for s in ("train", "test"))
        width = len(prepared.features) + (1 if config.intercept else 0)
        theta = training.fit_logistic(train, width, config.strength)
        own = rounds.scored_by_model(test, {rounds.BASELINE: theta}, width).select("y", predict(F.col("f")).alias("pred"))
        inputs = array_to_vector(F.concat("x", F.array(F.col("a").cast("double"))))
        fit_on = train.select(inputs.alias("features"), F.col("y").cast("double").alias("y"))
        fit = LogisticRegression(labelCol="y", regParam=1.0 / max(fit_on.count(), 1), standardization=False, maxIter=200, tol=1e-8)
        other = fit.fit(fit_on).transform(test.select("y", inputs.alias("features"))).select("y", F.col("prediction").alias("pred"))
        found = metrics.agreement(own, other, tolerance)
        return spark.createDataFrame(found.collect(), found.schema)


def reported(results: DataFrame) -> DataFrame:
    """The threshold metrics of results as rows (dataset, model, metric, value)."""
    names = ("accuracy", "F1_score", "EO_gap", "TPR_group0", "TPR_group1")
    cells = [F.struct(F.lit(m).alias("model"), F.lit(n).alias("metric"), F.col(f"{m}.{n}").alias("value")) for m in MODELS for n in names]
    return results.select("dataset", F.explode(F.array(*cells)).alias("cell")).select("dataset", "cell.*")


def as_expected(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows (dataset, model, metric, expected, tolerance) with the results' value and whether it is near enough; a missing one is not."""
    return metrics.within_tolerance(reported(results), expected, ["dataset", "model"])


def same_results(first: DataFrame, second: DataFrame) -> DataFrame:
    """``metrics.differing_rows`` of whole results, to the last digit of every number and round."""
    return metrics.differing_rows(*[r.select(F.to_json(F.struct(*sorted(r.columns))).alias("result")) for r in (first, second)])


def without_universum(prepared: Prepared, config: RunConfig, dataset: str) -> DataFrame:
    """Whether leaving the pseudo-positives out widens the equal-opportunity gap; both runs are one program."""
    pair = {name: dataclasses.replace(config, universum=name == "full") for name in ("full", "without")}
    gaps = run_settings(prepared, pair, dataset).select("setting", "dataset", F.col("pipeline.EO_gap").alias("eo_gap"))
    return metrics.raises_gap(gaps.filter("setting = 'full'"), gaps.filter("setting = 'without'"), ["dataset"])


def verify(prepared: Prepared, config: RunConfig, dataset: str, expected: Mapping[tuple[str, str], tuple[float, float]]) -> DataFrame:
    """All checks of a dataset and configuration: rows (check, ok, detail).

    ``expected`` gives value and tolerance by (model, metric). A run and its rerun are made from the same tables.
    """
    spark = prepared.train.sparkSession
    first, again = (run_experiment(prepared, config, dataset) for _ in range(2))
    rows = []
    wanted = [(dataset, m, n, float(v), float(t)) for (m, n), (v, t) in expected.items()]
    if wanted:
        table = spark.createDataFrame(wanted, "dataset STRING, model STRING, metric STRING, expected DOUBLE, tolerance DOUBLE")
        for r in as_expected(first, table).orderBy("model", "metric").collect():
            rows.append((f"expected {r.model} {r.metric}", r.ok, f"{r.value} for {r.expected} +- {r.tolerance}"))
    values = reported(first)
    bad = values.where(F.col("value").isNull() | F.isnan("value")).count()
    rows.append(("numbers", bad == 0, f"{bad} of {values.count()} missing"))
    gap = baseline_agreement(prepared, config).first()
    rows.append(("independent fit", gap.agrees, f"{gap.accuracy_left} and {gap.accuracy_right}"))
    difference = same_results(first, again).first()
    rows.append(("rerun", difference.only_left == difference.only_right == 0, f"{difference.only_left} results differ"))
    effect = without_universum(prepared, config, dataset).first()
    rows.append(("universum", effect.ok, f"{effect.full_gap} with, {effect.ablated_gap} without"))
    return spark.createDataFrame(rows, "check STRING, ok BOOLEAN, detail STRING")
