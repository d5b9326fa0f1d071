"""Accuracy and group gaps of a scored stream.

The counts behind the metrics are sums, so Spark keeps eight numbers of state per group and the batch
operators run on a stream as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from evenhand.operators.metrics import evaluate, outcome_counts


def running_report(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics over everything seen so far; for complete or update mode."""
    return evaluate(outcome_counts(scored, by), by)


def windowed_report(
    scored: DataFrame, time: str, window: str, lateness: str, by: Sequence[str] = ()
) -> DataFrame:
    """Metrics per time window, final once the watermark has passed it; for append mode too."""
    timed = scored.withWatermark(time, lateness).withColumn("window", F.window(time, window))
    keys = ["window", *by]
    return evaluate(outcome_counts(timed, keys), keys)
