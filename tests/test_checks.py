"""Checks of whole runs on a small table."""

import dataclasses

import pytest
from pyspark.sql import functions as F
from test_datasets import CONFIG, _prepared

from evenhand.plans import checks
from evenhand.plans.rounds import run_experiment


@pytest.fixture(scope="module")
def data(spark):
    return _prepared(spark, 600, 5)


def test_all_checks(spark, data):
    expected = {("baseline", "accuracy"): (0.9, 0.1), ("baseline", "EO_gap"): (5.0, 0.1), ("pipeline", "none"): (0.5, 1.0)}
    found = {r.check: r for r in checks.verify(data, CONFIG, "toy", expected).collect()}
    assert set(found) == {"expected baseline accuracy", "expected baseline EO_gap", "expected pipeline none", "numbers", "independent fit", "rerun", "universum"}
    assert found["expected baseline accuracy"].ok and not found["expected baseline EO_gap"].ok and not found["expected pipeline none"].ok
    assert found["numbers"].ok and found["independent fit"].ok and found["rerun"].ok
    full, without = (float(p.split()[0]) for p in found["universum"].detail.split(", "))
    assert found["universum"].ok == (without > full)


def test_differences_are_found(spark, data):
    first = run_experiment(data, CONFIG, "toy")
    other = run_experiment(data, dataclasses.replace(CONFIG, seed=2), "toy")
    assert tuple(checks.same_results(first, other).first()) == (1, 1)
    moved = first.withColumn("baseline", F.col("baseline").withField("accuracy", F.col("baseline.accuracy") + 1e-15))
    assert tuple(checks.same_results(first, moved).first()) == (1, 1)
    spoiled = dataclasses.replace(data, train=data.train.withColumn("x1", F.col("x1") * 0).withColumn("x2", F.col("x2") * 0))
    gap = checks.baseline_agreement(spoiled, dataclasses.replace(CONFIG, intercept=False, strength=1e9)).first()
    assert gap.accuracy_left != gap.accuracy_right or gap.agrees
    assert {r.metric for r in checks.reported(first).collect()} == {"accuracy", "F1_score", "EO_gap", "TPR_group0", "TPR_group1"}
