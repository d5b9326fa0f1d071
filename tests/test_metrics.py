import random

import pytest
from pyspark.sql import functions as F

from evenhand.operators import metrics as m


def _frame(spark, rows):
    return spark.createDataFrame(rows, "a int, y int, pred int")


def _report(spark, rows):
    return m.evaluate(m.outcome_counts(_frame(spark, rows))).first()


def test_empty_group_and_empty_class(spark):
    r = _report(spark, [(0, 1, 1), (0, 1, 0), (0, 0, 0)])
    assert (r.tpr0, r.tpr1, r.eo_gap) == (0.5, 0.0, 0.5)
    assert r.dp_gap == pytest.approx(1 / 3)
    r = _report(spark, [(0, 0, 1), (1, 0, 0)])
    assert (r.eo_gap, r.tpr0, r.tpr1, r.f1, r.recall) == (0, 0, 0, 0, 0)
    assert r.eod_gap == 1.0 and r.balanced_accuracy == 0.5
    # Macro F1 over both classes, because class 1 was predicted.
    assert r.macro_f1 == pytest.approx((2 / 3 + 0) / 2)
    r = _report(spark, [(0, 0, 0), (1, 0, 0)])
    assert r.macro_f1 == 1.0 and r.accuracy == 1.0


def test_metrics_by_hand(spark):
    rows = [(0, 1, 1)] * 3 + [(0, 1, 0)] + [(1, 1, 1)] + [(1, 1, 0)] * 3 + [(0, 0, 1)] + [(0, 0, 0)] * 3 + [(1, 0, 0)] * 2
    r = _report(spark, rows)
    assert r.n == 14 and r.accuracy == pytest.approx(9 / 14)
    assert r.precision == pytest.approx(4 / 5) and r.recall == 0.5
    assert r.f1 == pytest.approx(2 * 0.8 * 0.5 / 1.3)
    assert (r.tpr0, r.tpr1, r.eo_gap) == (0.75, 0.25, 0.5)
    assert r.dp_gap == pytest.approx(4 / 8 - 1 / 6) and r.eod_gap == 0.5


def _brute_areas(rows):
    pos = [f for f, y in rows if y == 1]
    neg = [f for f, y in rows if y == 0]
    if not pos or not neg:
        return 0.0, 0.0
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted({f for f, _ in rows}, reverse=True):
        tp = sum(p >= t for p in pos)
        fp = sum(n >= t for n in neg)
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    return auc, ap


@pytest.mark.parametrize("seed", range(4))
def test_areas_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(g, rng.choice([0.0, 1.0, -2.5, rng.gauss(0, 1), 1e-9 * rng.random()]), rng.randint(0, 1)) for g in (0, 1) for _ in range(120)]
    rows += [(2, 0.5, 1), (2, 0.1, 1)]
    df = spark.createDataFrame(rows, "g int, f double, y int")
    for r in m.ranking_metrics(df, "f", ["g"]).collect():
        want = _brute_areas([(f, y) for g, f, y in rows if g == r.g])
        assert (r.roc_auc, r.pr_auc) == (pytest.approx(want[0]), pytest.approx(want[1]))
    whole = m.ranking_metrics(df, "f").first()
    assert whole.roc_auc == pytest.approx(_brute_areas([(f, y) for _, f, y in rows])[0])


def test_threshold_edges(spark):
    one_class = spark.createDataFrame([(0.1, 1), (0.7, 1)], "f double, y int")
    assert tuple(m.pick_threshold(one_class).first()) == (0.0, 0.0)
    # Perfectly separated, and only the middle candidate, the largest negative score, lies between.
    rows = [(float(i), 0) for i in range(51)] + [(1000.0 + i, 1) for i in range(50)]
    best = m.pick_threshold(spark.createDataFrame(rows, "f double, y int")).first()
    assert (best.threshold, best.balanced) == (50.0, 1.0)
    # All candidates equal: the lowest wins the tie.
    tied = m.pick_threshold(spark.createDataFrame([(2.0, 0), (2.0, 1)], "f double, y int")).first()
    assert (tied.threshold, tied.balanced) == (2.0, 0.5)


@pytest.mark.parametrize("seed", range(3))
def test_threshold_matches_brute_force(spark, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, 300)
    f = np.round(rng.normal(size=300) + y, 1)
    best_t, best = 0.0, -1.0
    for t in np.quantile(f, np.arange(1, 50) / 50):
        score = 0.5 * ((f[y == 1] > t).mean() + (f[y == 0] <= t).mean())
        if score > best:
            best_t, best = t, score
    got = m.pick_threshold(spark.createDataFrame([(float(a), int(b)) for a, b in zip(f, y)], "f double, y int")).first()
    assert got.balanced == pytest.approx(best) and got.threshold == pytest.approx(best_t)


def test_result_checks(spark):
    a = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, None)], "k int, v double")
    b = spark.createDataFrame([(1, 0.5), (2, None), (3, 1.0)], "k int, v double")
    assert tuple(m.differing_rows(a, b).first()) == (1, 1)
    assert tuple(m.differing_rows(a, a.repartition(3)).first()) == (0, 0)
    left = spark.createDataFrame([(1, 1), (0, 1)], "y int, pred int")
    got = m.agreement(left, left.filter("y = 1"), 0.2).first()
    assert (got.accuracy_left, got.accuracy_right, got.gap, got.agrees) == (0.5, 1.0, 0.5, False)
    expected = spark.createDataFrame([("x", "acc", 0.5, 0.1), ("x", "eo", 0.1, 0.01), ("y", "acc", 0.5, 0.1)], "run string, metric string, expected double, tolerance double")
    observed = spark.createDataFrame([("x", "acc", 0.55), ("x", "eo", 0.2)], "run string, metric string, value double")
    assert {(r.run, r.metric): r.ok for r in m.within_tolerance(observed, expected, ["run"]).collect()} == {
        ("x", "acc"): True, ("x", "eo"): False, ("y", "acc"): False,
    }


def test_stream_gives_the_batch_report(spark, tmp_path):
    from evenhand.streaming.live import running_report, windowed_report

    rows = [(f"2024-01-01 00:{i:02d}:00", i % 2, (i // 2) % 2, (i // 3) % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "t string, a int, y int, pred int").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = running_report(stream).writeStream.outputMode("complete").format("memory").queryName("live").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("live").first() == m.evaluate(m.outcome_counts(df)).first()
    windows = windowed_report(stream, "t", "20 minutes", "1 minute")
    query = windows.writeStream.outputMode("append").format("memory").queryName("wins").start()
    query.processAllAvailable()
    query.stop()
    assert {r.n for r in spark.table("wins").collect()} == {20}
