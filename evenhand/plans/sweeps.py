"""A resumable sweep: run the grid points that have no result yet, and summarise what is there."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Row, SparkSession

from evenhand.operators import runs
from evenhand.plans.datasets import Prepared
from evenhand.plans.rounds import RunConfig, run_settings
from evenhand.sources import ledger, schemas, writers

KEYS = ("dataset", "universum_off", "rho", "seed")
RESULT = f"{schemas.RUN}, universum_off BOOLEAN, rho DOUBLE, seed INT"


def sweep_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results written so far, the latest of each point; an empty table before the first run."""
    return ledger.latest(spark, folder, RESULT, KEYS)


def _configured(config: RunConfig, point: Row) -> RunConfig:
    solver = dataclasses.replace(config.solver, rho=point["rho"])
    return dataclasses.replace(config, seed=point["seed"], universum=not point["universum_off"], solver=solver)


def run_sweep(
    spark: SparkSession,
    datasets: Mapping[str, Prepared],
    folder: str,
    rhos: Sequence[float],
    seeds: Sequence[int],
    config: RunConfig,
    run: Callable[[Prepared, Mapping[str, RunConfig], str], DataFrame] = run_settings,
) -> DataFrame:
    """Run every pending point of dataset x universum x rho x seed and return all results.

    The points of a dataset and seed are one distributed program, committed together; their configuration is kept in columns
    beside the results. A point that is run again replaces its result.
    """
    axes = {"dataset": list(datasets), "universum_off": [False, True], "rho": list(rhos), "seed": list(seeds)}
    todo = runs.pending(runs.config_grid(spark, axes), sweep_results(spark, folder), KEYS).orderBy(*KEYS).collect()
    for dataset, seed in sorted({(p["dataset"], p["seed"]) for p in todo}):
        points = {f"point{i}": p for i, p in enumerate(todo) if (p["dataset"], p["seed"]) == (dataset, seed)}
        results = run(datasets[dataset], {name: _configured(config, p) for name, p in points.items()}, dataset)
        labels = spark.createDataFrame([(name, p["universum_off"], p["rho"], p["seed"]) for name, p in points.items()], "setting string, universum_off boolean, rho double, seed int")
        ledger.commit(results.join(labels, "setting").drop("setting"), folder, KEYS)
    return sweep_results(spark, folder)


def promote(spark: SparkSession, folder: str, selected: DataFrame, final_folder: str) -> DataFrame:
    """Republish the runs of the selected configurations under their final names; returns them as published."""
    chosen = runs.promoted(sweep_results(spark, folder), selected, KEYS[:-1])
    writers.write_final_runs(chosen, final_folder)
    return spark.read.schema(f"{RESULT}, label STRING").json(final_folder)
