import pytest
from pyspark.sql import functions as F

from evenhand.operators import noise, sampling as s, synthesis as e


def _client(spark, n00, n01, n10, n11, client=0):
    cells = [(0, 0, n00), (0, 1, n01), (1, 0, n10), (1, 1, n11)]
    rows = [
        (f"{client}-{a}{y}-{i}", client, a, y, [float(i), float(a), 7.0])
        for a, y, n in cells
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "row_id string, client_id int, a int, y int, x array<double>")


def _quotas(spark, *counts):
    row = s.batch_quotas(s.client_profile(_client(spark, *counts))).first()
    return row["size"], [row[f"q_a{a}y{y}"] for a, y in s.STRATA]


@pytest.mark.parametrize(
    "counts,size,quotas",
    [
        # No positives: the smallest size, no floor.
        ((20, 0, 12, 0), 32, [20, 0, 12, 0]),
        # 16 wanted, 32 taken; a quarter each.
        ((10, 10, 10, 10), 32, [8, 8, 8, 8]),
        # Shares 2.5, 2.5, 7.5, 19.5 -> 2, 2, 8, 20; the floor of 5 costs group 0 all its negatives.
        ((5, 5, 15, 39), 32, [0, 5, 8, 20]),
        # The floor is the smaller number of positives (3); (0, 0) takes the row that rounding lost.
        ((900, 50, 900, 3), 128, [63, 3, 59, 3]),
        # A group without positives switches the floor off.
        ((900, 50, 900, 0), 128, [63, 3, 62, 0]),
    ],
)
def test_quotas_by_hand(spark, counts, size, quotas):
    assert _quotas(spark, *counts) == (size, quotas)


def test_half_even_rounding(spark):
    # 32 rows of 64: shares 5/64 * 32 = 2.5 -> 2 and 7/64 * 32 = 3.5 -> 4, then the floor of 5 positives.
    assert _quotas(spark, 5, 20, 7, 32) == (32, [2, 10, 4, 16])


def test_sample_is_without_replacement_and_covers_small_strata(spark):
    df = _client(spark, 500, 3, 40, 6)
    batch = s.draw_minibatch(df, 1, rounds=6)
    stats = {r["round"]: r for r in s.minibatch_stats(batch).collect()}
    assert batch.count() == batch.select("round", "row_id").distinct().count()
    assert set(stats) == set(range(6))
    _, quotas = _quotas(spark, 500, 3, 40, 6)
    sizes = [500, 3, 40, 6]
    for row in stats.values():
        got = [row[f"q_a{a}y{y}"] for a, y in s.STRATA]
        assert got == [min(q, n) for q, n in zip(quotas, sizes)]
        assert row["delta"] == max(0, row["n0"] - row["n1"])
    again = s.draw_minibatch(df.repartition(7), 1, rounds=6, clients=1)
    assert batch.select("round", "row_id", "pos").exceptAll(again.select("round", "row_id", "pos")).isEmpty()


def test_sample_takes_the_smallest_draws_of_a_hot_client(spark):
    """Brute force over all rows of a skewed table."""
    from evenhand.functions.draws import round_digests, round_draws
    from pyspark.sql import Window

    df = _client(spark, 3000, 400, 800, 90).unionByName(_client(spark, 30, 10, 10, 10, client=1))
    drawn = df.withColumns(round_digests(4, "batch", 5, "row_id")).select("*", F.posexplode(round_draws(5)).alias("round", "h"))
    rank = F.row_number().over(Window.partitionBy("round", "client_id", "a", "y").orderBy("h", "row_id"))
    quotas = s.batch_quotas(s.client_profile(df)).select("client_id", *[f"q_a{a}y{y}" for a, y in s.STRATA])
    brute = drawn.withColumn("rank", rank).join(quotas, "client_id").filter(F.col("rank") <= s.per_stratum("q"))
    got = s.draw_minibatch(df, 4, rounds=5)
    columns = ["round", "client_id", "a", "y", "row_id"]
    assert got.select(columns).exceptAll(brute.select(columns)).isEmpty()
    assert brute.select(columns).exceptAll(got.select(columns)).isEmpty()


def test_last_positives_and_fill(spark):
    rows = [(0, a, 1, i) for a in (0, 1) for i in range(80)] + [(0, 0, 0, 999)]
    history = spark.createDataFrame(rows, "client_id int, a int, y int, t int")
    kept = s.last_positives(history, ["t"], size=50)
    got = {(r.a, r.lo, r.hi, r.n) for r in kept.groupBy("a").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).collect()}
    assert got == {(0, 30, 79, 50), (1, 30, 79, 50)}
    batch = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 0, 2)], "client_id int, a int, y int, t int")
    filled = s.fill_missing_positives(batch, kept.select("client_id", "a", "y", "t"))
    assert {(r.a, r["count"]) for r in filled.filter("filled = 1").groupBy("a").count().collect()} == {(1, 50)}


def test_importance_weights_by_hand(spark):
    rows = [(0, 0, 1)] * 1 + [(0, 1, 1)] * 3 + [(0, 1, 0)] * 2 + [(1, 1, 1)] * 40 + [(1, 0, 1)] * 1
    df = spark.createDataFrame(rows, "client_id int, a int, y int")
    got = {(r.client_id, r.a, r.y, round(r.weight, 6)) for r in s.importance_weights(df).collect()}
    assert got == {(0, 0, 1, 4.0), (0, 1, 1, 1.333333), (0, 1, 0, 1.0), (1, 1, 1, 1.025), (1, 0, 1, 10.0)}


def _stats(spark, *q):
    cells = {f"q_a{a}y{y}": v for (a, y), v in zip(s.STRATA, q)}
    n0, n1 = q[0] + q[2], q[1] + q[3]
    row = {"round": 0, "client_id": 0, **cells, "n0": n0, "n1": n1, "delta": max(0, n0 - n1)}
    types = ", ".join(f"{k} {'int' if k in ('round', 'client_id') else 'bigint'}" for k in row)
    return spark.createDataFrame([tuple(row.values())], types)


def test_synthetic_quotas_by_hand(spark):
    # 64 rows halved: 20, 5, 5 -> 2.5 (even 2), 2.
    row = e.synthetic_quotas(_stats(spark, 40, 10, 5, 9)).first()
    assert [row[f"q_a{a}y{y}"] for a, y in s.STRATA] == [21, 5, 2, 4]
    assert row["ds_size"] == 32 and row["delta_s"] == 14
    # The floors alone exceed the target of one row.
    row = e.synthetic_quotas(_stats(spark, 1, 0, 0, 0)).first()
    assert row["ds_size"] == 4 and row["ds_target"] == 1 and row["delta_s"] == 0
    # An empty batch gives nothing, not a division by zero.
    assert e.synthetic_quotas(_stats(spark, 0, 0, 0, 0)).count() == 0


def test_moment_fallbacks(spark):
    batch = _client(spark, 4, 1, 0, 2).withColumn("round", F.lit(0))
    got = {(r.a, r.y, r.j): (r.mean, r["std"]) for r in e.stratum_moments(batch).collect()}
    xs = [0.0, 1.0, 2.0, 3.0, 0.0, 0.0, 1.0]
    mean = sum(xs) / 7
    std = (sum((x - mean) ** 2 for x in xs) / 7) ** 0.5
    assert got[(0, 0, 0)] == (pytest.approx(1.5), pytest.approx(1.25**0.5))
    assert got[(0, 1, 0)] == (0.0, pytest.approx(std))  # one row: spread of the batch
    assert got[(1, 0, 0)] == (pytest.approx(mean), pytest.approx(std))  # no row: the batch
    assert got[(1, 1, 2)] == (7.0, 1.0)  # flat feature


def test_universum_balance_and_fallback(spark):
    batch = s.draw_minibatch(_client(spark, 60, 0, 20, 9), 3)
    stats = s.minibatch_stats(batch)
    quotas = e.synthetic_quotas(stats)
    slots = e.universum_slots(quotas, stats)
    groups = {r.a: r["count"] for r in slots.groupBy("a").count().collect()}
    assert groups[1] - groups[0] in (0, 1)
    rows = e.universum_rows(slots, batch, 3, 3)
    assert rows.count() == slots.count() and rows.filter("y <> 1").isEmpty()
    # Group 0 has no positives, so its points start from positives of group 1 (second feature 1).
    own = rows.filter("a = 0").select((F.col("x")[1]).alias("v")).distinct().collect()
    assert {r.v for r in own} == {1.0}  # positive and negative both have a = 1
    lonely = batch.filter("y = 0")
    noise_rows = e.universum_rows(slots.withColumns({"n1": F.lit(0).cast("bigint"), "q_a0y1": F.lit(0).cast("bigint"), "q_a1y1": F.lit(0).cast("bigint")}), lonely, 3, 3)
    assert noise_rows.filter("size(x) <> 3 OR x IS NULL").isEmpty() and noise_rows.count() == slots.count()
    assert e.universum_slots(quotas.withColumn("delta_s", F.lit(0).cast("bigint")), stats).count() == 0


def test_noise_settings():
    assert noise.noise_config(False, 1.0, "both").variant == "none"
    assert not noise.NoiseConfig("both", 0.0).before_union and not noise.NoiseConfig("none").after_union
    both = noise.noise_config(True, 0.5, " BOTH ")
    assert both.before_union and both.after_union
    with pytest.raises(ValueError):
        noise.noise_config(False, 1.0, "everywhere")


def test_noise_leaves_labels_and_follows_sigma(spark):
    df = spark.range(4000).select(
        F.lit(0).alias("round"), F.lit(0).alias("client_id"), F.col("id").cast("string").alias("pt_id"),
        F.lit(1).alias("a"), F.lit(0).alias("y"), F.array(F.lit(5.0), F.lit(-0.25)).alias("x"),
    )
    assert noise.release(df, noise.NoiseConfig("none"), 1) is df
    out = noise.release(df, noise.NoiseConfig("post_server", 0.5), 1)
    row = out.agg(F.avg(F.col("x")[0]), F.stddev_pop(F.col("x")[0]), F.avg(F.col("x")[1]), F.min("a"), F.max("y")).first()
    assert abs(row[0] - 1.0) < 0.05 and abs(row[1] - 0.5) < 0.05 and abs(row[2] + 0.25) < 0.05 and (row[3], row[4]) == (1, 0)
