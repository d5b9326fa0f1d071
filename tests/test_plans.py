"""Shapes of physical plans that matter at scale."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from evenhand.operators import metrics, ranks, runs, sampling, sizes, splits
from evenhand.plans import views


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_projection_reaches_the_scan(spark, sf_dir):
    counted = metrics.outcome_counts(views.predicted_lines(spark, sf_dir), ["client_id"])
    columns = re.search(r"FileScan parquet \[([^\]]*)\]", _plan(counted)).group(1)
    assert "l_orderkey" not in columns and "l_shipdate" not in columns and "l_discount" in columns


def test_metrics_combine_before_the_only_shuffle(spark, sf_dir):
    plan = _plan(metrics.evaluate(metrics.outcome_counts(views.predicted_lines(spark, sf_dir), ["client_id"]), ["client_id"]))
    assert plan.count("Exchange") == 1 and "partial_sum" in plan and "Python" not in plan


def test_filters_reach_the_scan(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").filter(F.col("l_tax") > 0.05).select("l_tax")
    assert "GreaterThan(l_tax,0.05)" in _plan(lines)


def test_split_does_not_shuffle_rows(spark, sf_dir):
    rows = views.line_columns(spark, sf_dir)
    plan = _plan(splits.split_by_count(rows, "row_id", 1, 0.2))
    outside = plan.split("Subquery subquery")[0]
    assert "Exchange" not in outside and "Window" not in outside


def test_sample_drops_rows_before_the_shuffle(spark, sf_dir):
    batch = sampling.draw_minibatch(views.labelled_lines(spark, sf_dir), 1, 2, clients=5)
    plan = _plan(batch)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("BroadcastExchange")[0]


def test_last_positives_are_limited_before_the_shuffle(spark, sf_dir):
    rows = views.line_columns(spark, sf_dir, "l_shipdate").select("client_id", "a", "y", "row_id", "l_shipdate")
    plan = _plan(sampling.last_positives(rows, ["l_shipdate", "row_id"]))
    assert plan.count("WindowGroupLimit") >= 3


def test_selection_and_frontier_have_no_pair_join(spark):
    schema = "dataset string, universum_off boolean, rho double, val_acc_mean double, val_eo_mean double, test_acc_mean double, test_eo_mean double"
    grid = spark.createDataFrame([("d", False, 0.1, 0.5, 0.1, 0.5, 0.1)], schema)
    for df in (runs.select_config(grid), runs.pareto_frontier(grid)):
        assert "Cartesian" not in _plan(df) and "NestedLoop" not in _plan(df)


def test_unknown_sizes_are_counted_before_a_broadcast(spark):
    small = sizes.small_side(spark.range(10), limit=20 * 24)
    large = sizes.small_side(spark.range(100), limit=20 * 24)
    assert "broadcast" in small._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in large._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in sizes.small_side(spark.range(5), bound=10**9)._jdf.queryExecution().logical().toString().lower()


def test_written_tables_use_the_shared_folder(spark, tmp_path, monkeypatch):
    named = spark.conf.get(sizes.FOLDER_SETTING, None)
    assert sizes.shared_folder(spark) == (named or sizes.shared_folder(spark))
    monkeypatch.setattr(sizes, "shared_folder", lambda s: str(tmp_path))
    kept = sizes.cut_lineage(spark.range(4).withColumn("p", F.lit("007")), ["p"])
    assert str(tmp_path) in kept.inputFiles()[0]
    assert dict(kept.dtypes) == {"id": "bigint", "p": "string"} and kept.first().p == "007"


class _Session:
    """A session of a cluster or of a local master, without a checkpoint folder."""

    def __init__(self, master):
        self.sparkContext = type("C", (), {"master": master, "applicationId": master, "getCheckpointDir": lambda s: None})()
        self.conf = type("R", (), {"get": lambda s, key, default: default})()


def test_a_cluster_must_name_the_folder():
    with pytest.raises(RuntimeError):
        sizes.shared_folder(_Session("yarn"))
    assert sizes.shared_folder(_Session("local[2]")) == sizes.shared_folder(_Session("local[2]"))


def test_sizes_are_read_with_units():
    assert [sizes._bytes(s) for s in ("134217728b", "128m", "128MB", "1g", "5")] == [2**27, 2**27, 2**27, 2**30, 5]


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    rows = views.line_columns(spark, sf_dir).select("row_id", "client_id", "a", "y")
    scattered = rows.repartition(17)
    for split in (lambda d: splits.partition_iid(d, "row_id", 3, 7), lambda d: splits.stratified_split(d, "row_id", 3)):
        assert tuple(metrics.differing_rows(split(rows), split(scattered)).first()) == (0, 0)
    assert ranks.median(rows.withColumn("v", F.length("row_id").cast("double")), "v").first() == ranks.median(
        scattered.withColumn("v", F.length("row_id").cast("double")), "v"
    ).first()


def test_scattered_parts_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    from evenhand.plans.catalog import evaluation

    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    lines = [(i // 4, i % 4, i % 7, i % 5, 1.0, 2.0, 0.1, 0.2, "R", "F", datetime.date(1995, 1, 1)) for i in range(200)]
    spark.createDataFrame(lines, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    counted, most = evaluation.m.differing_rows, []

    def differing(*sides):
        for side in sides:
            most.append(side.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return counted(*sides)

    monkeypatch.setattr(evaluation.m, "differing_rows", differing)
    monkeypatch.setattr(evaluation, "PART_ROWS", 10, raising=False)
    found = {r.runs: (r.only_left, r.only_right) for r in evaluation.two_run_equality(spark, str(tmp_path)).collect()}
    # A scan task leaves a part at most one row more than the others.
    assert len(most) == 4 and max(most) <= 10 + 8
    assert found["same seed"] == (0, 0) and found["other seed"][0] == found["other seed"][1] > 0
    assert [evaluation._parts(spark.range(n)) for n in (0, 50, 51, 200)] == [5, 5, 6, 20]
