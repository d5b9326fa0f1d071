import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.operators import ranks, splits


@pytest.mark.parametrize("n", [1, 2, 5, 200, 1001])
def test_quantiles_match_numpy_with_ties_and_negatives(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.0, -1.5, 3.0, rng.gauss(0, 1000), rng.gauss(0, 1e-3)]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    parts = [1, 10, 25, 50, 99]
    got = ranks.exact_quantiles(df, "v", parts, 100).first()["quantiles"]
    assert got == pytest.approx(list(np.quantile(values, [p / 100 for p in parts])), rel=1e-12, abs=1e-12)
    assert ranks.median(df, "v").first()["median"] == pytest.approx(float(np.median(values)))


def test_hot_value_and_hot_group(spark):
    rows = [("hot", 5.0)] * 3000 + [("hot", float(i)) for i in range(100)] + [("cold", 1.0), ("cold", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in ranks.median(df, "v", ["g"], 2).collect()}
    assert got == {"hot": 5.0, "cold": 1.5}
    unbounded = {r.g: r.median for r in ranks.median(df, "v", ["g"], None).collect()}
    assert unbounded == got


def test_empty_table_has_no_median(spark):
    assert ranks.median(spark.createDataFrame([], "v double"), "v").first() is None


def test_dense_codes(spark):
    words = ["b", "a", "abc", "abcd", "abce", "B", "", "zz", "a"]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    got = {r.w: r.code for r in ranks.dense_codes(df, "w").collect()}
    assert got == {w: i for i, w in enumerate(sorted(set(words)))}


def _ids(spark, n, **extra):
    df = spark.range(n).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    return df


@pytest.mark.parametrize("n,fraction,at_least", [(10, 0.25, 0), (3, 0.1, 1), (7, 0.0, 0), (5, 1.0, 0), (0, 0.5, 0)])
def test_split_by_count_is_exact(spark, n, fraction, at_least):
    got = splits.split_by_count(_ids(spark, n), "row_id", 1, fraction, at_least=at_least)
    counts = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    first = min(n, max(at_least, int(n * fraction)))
    assert counts.get("val", 0) == first and counts.get("train", 0) == n - first


@pytest.mark.parametrize("n,clients", [(11, 5), (10, 5), (3, 5), (100, 1)])
def test_iid_parts_differ_by_at_most_one(spark, n, clients):
    got = splits.partition_iid(_ids(spark, n), "row_id", 1, clients)
    counts = {r.client_id: r["count"] for r in got.groupBy("client_id").count().collect()}
    sizes = [len(p) for p in np.array_split(np.arange(n), clients)]
    assert [counts.get(k, 0) for k in range(clients)] == sizes


def test_fast_partition_is_roughly_even(spark):
    got = splits.partition_iid(_ids(spark, 4000), "row_id", 1, 4, exact=False)
    counts = {r.client_id: r["count"] for r in got.groupBy("client_id").count().collect()}
    assert set(counts) == {0, 1, 2, 3} and all(900 < n < 1100 for n in counts.values())


def test_split_and_partition_in_one_go(spark):
    got = splits.split_and_partition(_ids(spark, 103), "row_id", 1, 0.2, 4)
    counts = {(r.split, r.client_id): r["count"] for r in got.groupBy("split", "client_id").count().collect()}
    assert counts == {("val", None): 20, ("train", 0): 21, ("train", 1): 21, ("train", 2): 21, ("train", 3): 20}
    alone = splits.split_by_count(_ids(spark, 103), "row_id", 1, 0.2)
    assert got.select("row_id", "split").exceptAll(alone.select("row_id", "split")).isEmpty()


def test_stratified_counts_use_largest_remainder(spark):
    df = spark.createDataFrame([(0,)] * 13 + [(1,)] * 8, "y int")
    got = {r.y: (r.n_train, r.n_test) for r in splits.stratified_counts(df, "y", 0.2).collect()}
    # 21 rows: 5 test, 16 train; exact train shares 9.904 and 6.095.
    assert got == {0: (10, 3), 1: (6, 2)}


def test_stratified_split_sizes(spark):
    got = splits.stratified_split(_ids(spark, 101), "row_id", 5)
    counts = {(r.y, r.split): r["count"] for r in got.groupBy("y", "split").count().collect()}
    assert counts[(0, "test")] + counts[(1, "test")] == 21
    assert sum(counts.values()) == 101


def test_shares_cut_at_truncated_cumulative_sums(spark):
    shares = {0: [0.5, 0.0, 0.5], 1: [0.0, 0.3, 0.7]}
    got = splits.partition_by_shares(_ids(spark, 30), "row_id", 1, shares)
    counts = {(r.y, r.client_id): r["count"] for r in got.groupBy("y", "client_id").count().collect()}
    assert counts == {(0, 0): 10, (0, 2): 10, (1, 1): 3, (1, 2): 7}


def test_dirichlet_shares_are_seeded():
    first = splits.dirichlet_shares([0, 1], 4, 0.5, 3)
    assert first == splits.dirichlet_shares([0, 1], 4, 0.5, 3)
    assert all(abs(sum(s) - 1) < 1e-9 for s in first.values())


def test_starved_clients_are_reported_and_dropped(spark):
    df = spark.createDataFrame([(0,)] * 10 + [(1,)] * 2, "client_id int")
    assert {r.client_id for r in splits.with_enough_rows(df, 5, 3).collect()} == {0}
    got = {(r.client_id, r.n) for r in splits.starved_clients(df, 5, 3).collect()}
    assert got == {(1, 2), (2, 0)}


def test_buckets_keep_the_order_and_spread_any_scale(spark):
    rng = random.Random(9)
    values = [rng.gauss(0, 1) * 10.0 ** rng.randint(-12, 12) for _ in range(500)]
    values += [0.0, -0.0, 1e308, -1e308, float("inf"), float("-inf"), 5e-324]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = sorted((r.v, r.b) for r in df.select("v", ranks.value_bucket(F.col("v")).alias("b")).collect())
    assert [b for _, b in rows] == sorted(b for _, b in rows)
    tiny = spark.range(2000).select((F.randn(3) * 1e-6).alias("v"))
    assert tiny.groupBy(ranks.value_bucket(F.col("v"))).count().agg(F.max("count")).first()[0] < 20


CROWDED = {
    "seconds": lambda i: 1.7e9 + i,
    "one value": lambda i: 5.0,
    "mostly zero": lambda i: 0.0 if i % 10 else i / 7.0,
    "constant plus noise": lambda i: 1e6 + ((i * 7919) % 20011) * 1e-7,
    "one far value": lambda i: 1e300 if i == 0 else 1.7e9 + i,
}


@pytest.mark.parametrize("name", CROWDED)
def test_crowded_values(spark, name):
    values = [CROWDED[name](i) for i in range(4000)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    got = ranks.exact_quantiles(df, "v", [1, 2, 3], 4).first().quantiles
    assert got == pytest.approx([float(np.quantile(values, q)) for q in (0.25, 0.5, 0.75)], rel=1e-15)
    # Rows of the fullest bucket spread over its parts, but for equal values.
    bucket = ranks.value_bucket(F.col("v")).alias("b")
    ends = df.groupBy(bucket).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_distinct("v").alias("d"))
    full = ends.orderBy(F.desc("d")).first()
    inside = df.where(ranks.value_bucket(F.col("v")) == full.b)
    parts = inside.select(ranks.value_part(F.col("v"), F.lit(full.lo), F.lit(full.hi)).alias("p"), "v").distinct().groupBy("p").count()
    assert full.d == 1 or parts.count() >= min(100, full.d)


def test_many_parts_keep_the_plan_small(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).cast("int").alias("y"))
    sizes = {}
    for clients in (5, 5000):
        even = splits.partition_iid(df, "k", 1, clients)
        skewed = splits.partition_by_shares(df, "k", 1, {0: [1 / clients] * clients, 1: [1 / clients] * clients})
        sizes[clients] = [len(d._jdf.queryExecution().analyzed().toString()) for d in (even, skewed)]
        counts = even.groupBy("client_id").count()
        assert counts.count() == clients and counts.agg(F.max("count") - F.min("count")).first()[0] <= 1
    assert all(b < 1.5 * a for a, b in zip(sizes[5], sizes[5000]))


def test_equal_shares_of_both_splits(spark):
    df = spark.range(103).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))
    got = splits.client_shares(df, "k", 9).groupBy("split", "client_id").count().collect()
    assert sorted((r.split, r.client_id, r["count"]) for r in got) == (
        [("test", i, 6 if i == 0 else 5) for i in range(5)] + [("train", i, 16 if i < 2 else 15) for i in range(5)]
    )
