import math
import random

import pytest
from pyspark.sql import functions as F

from evenhand.functions import draws, values, vectors


def test_text_label_and_matches(spark):
    rows = [(" >50K. ", 1), ("> 50K", 1), (">50K", 1), ("<=50K.", 0), (None, 0), ("", 0)]
    df = spark.createDataFrame(rows, "raw string, want int")
    assert df.filter(values.text_label("raw", ">50K") != F.col("want")).count() == 0
    df = spark.createDataFrame([(" Male ", 1), ("MALE", 1), ("female", 0), (None, 0)], "raw string, want int")
    assert df.filter(values.matches("raw", "male") != F.col("want")).count() == 0


def test_numeric_codes_and_recodes(spark):
    df = spark.createDataFrame([("1",), ("1.0",), ("x",), (None,), (" 2 ",)], "raw string")
    got = [tuple(r) for r in df.select(values.numeric("raw"), values.coded("raw")).collect()]
    assert got == [(1.0, 1), (1.0, 1), (None, 0), (None, 0), (2.0, 0)]
    df = spark.createDataFrame([(1.0,), (-1.0,)], "s double")
    assert [r[0] for r in df.select(values.to_zero_one("s")).collect()] == [1, 0]


def test_signed_log_and_finite(spark):
    df = spark.createDataFrame([(-math.e + 1,), (0.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    logs = [r[0] for r in df.limit(2).select(values.signed_log("v")).collect()]
    assert logs == pytest.approx([-1.0, 0.0])
    assert [r[0] for r in df.select(values.finite_or_zero("v")).collect()][1:] == [0.0, 0.0, 0.0, 0.0]


def test_fixed_rounds_like_exact_binary_formatting(spark):
    rng = random.Random(3)
    cases = [0.40625, 0.73725, 0.00005, 0.12345, 0.99995, 0.0, 1.0, 0.5, 2.00015, 12.34565]
    cases += [k / 20000 for k in rng.sample(range(20000), 400)] + [rng.random() for _ in range(300)]
    df = spark.createDataFrame([(c,) for c in cases], "v double")
    got = [(r.v, r.t) for r in df.select("v", values.fixed(F.col("v")).alias("t")).collect()]
    assert [(v, t) for v, t in got if t != f"{v:.4f}"] == []
    row = df.limit(1).select(values.mean_and_spread(F.lit(0.73725), F.lit(0.40625))).first()
    assert row[0] == f"{0.73725:.4f} +/- {0.40625:.4f}"


def test_score_predict_and_sigmoid(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1, 0.0), ([0.0, -100.0], 0, 0.0)], "x array<double>, a int, z double")
    f = vectors.score("x", "a", [1.0, 0.5, -2.0])
    got = df.select(f.alias("f"), vectors.predict(f).alias("p"), vectors.sigmoid(f * 10).alias("s")).collect()
    assert [(r.f, r.p) for r in got] == [(0.0, 0), (-50.0, 0)]
    assert got[0].s == 0.5 and got[1].s == pytest.approx(1 / (1 + math.exp(50)))
    with pytest.raises(ValueError):
        vectors.score_columns(["x"], "a", [1.0])


def test_draws_are_uniform_and_partition_free(spark):
    ids = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    h = draws.draw_hash(1, "t", "k")
    stats = ids.agg(
        F.avg(draws.uniform(h)), F.min(draws.uniform(h)), F.max(draws.uniform(h)),
        F.avg(draws.gaussian(h)), F.stddev_pop(draws.gaussian(h)),
    ).first()
    assert abs(stats[0] - 0.5) < 0.01 and 0 < stats[1] and stats[2] < 1
    assert abs(stats[3]) < 0.03 and abs(stats[4] - 1) < 0.03
    one = ids.select("k", h.alias("h")).orderBy("k")
    other = ids.repartition(13).select("k", h.alias("h")).orderBy("k")
    assert one.exceptAll(other).isEmpty()


def test_draw_levels_follow_the_draw(spark):
    df = spark.createDataFrame([("00ff", 2), ("0fff", 1), ("ffff", 0), ("0000", 4)], "h string, want int")
    assert df.filter(draws.draw_level(F.col("h")) != F.col("want")).count() == 0
    index = spark.createDataFrame([(0,), (None,), (3,)], "n int").select(
        draws.draw_index(F.md5(F.lit("x")), F.col("n")).alias("i")
    )
    got = [r.i for r in index.collect()]
    assert got[0] is None and got[1] is None and 0 <= got[2] < 3
