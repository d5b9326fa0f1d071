"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.llm import hard_negatives as hard

SCHEMA = "vec_id long, label long, embedding array<double>, slot string, bounds int"


def table(spark, rows):
    return spark.createDataFrame([(i, y, v, "clash", 1) for i, y, v in rows], SCHEMA)


def asked():
    return F.col("vec_id") % 10 == 0


def brute(rows, positives=5, negatives=10, low=30, high=90):
    out = []
    for a, label, v in rows:
        if a % 10:
            continue
        scores = sorted((-sum(int(x) * int(y) for x, y in zip(v, w)), i, y) for i, y, w in rows if i != a)
        for p, positive, _ in [s for s in scores if s[2] == label][:positives]:
            fits = [s for s in scores if s[2] != label and low * -p <= 100 * -s[0] <= high * -p]
            out += [(a, positive, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(fits[:negatives])]
    return sorted(out)


def found(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def made(n, width, labels, seed=1, spread=4.0):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(labels)), [float(round(spread * x)) for x in rng.normal(size=width)]) for i in range(n)]


@pytest.mark.parametrize(("positives", "negatives", "low", "high"), [(5, 10, 30, 90), (1, 3, 0, 100), (40, 500, 10, 50)])
def test_all_against_brute_force(spark, positives, negatives, low, high):
    rows = made(150, 6, 3)  # many ties
    got = found(hard.mine(table(spark, rows), asked(), positives, negatives, low, high))
    assert got == brute(rows, positives, negatives, low, high)


def test_small_blocks_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(hard, "BLOCK_BYTES", 1)
    monkeypatch.setattr(hard, "PRODUCTS", 256)
    monkeypatch.setattr(hard, "FAN_IN", 2)
    monkeypatch.setattr(hard, "SHARES", (0.05, 0.3, 0.6))
    rows = made(700, 5, 4, 2)
    assert found(hard.mine(table(spark, rows), asked(), clusters=3)) == brute(rows)


def test_walks_end_early_on_clusters(spark, monkeypatch):
    """Anchors near each other, rows of falling length: the first part certifies all results."""
    rng = np.random.default_rng(7)
    rows = [(i, i % 3, [float(x) for x in np.rint(1e6 / (1 + i) * (np.eye(8)[0] + 0.02 * rng.normal(size=8)))]) for i in range(600)]
    ended = []
    plain = hard.walk

    def walk(*args, **named):
        state = plain(*args, **named)
        ended.append(state.agg(F.max("walked")).first()[0])
        return state

    monkeypatch.setattr(hard, "walk", walk)
    assert found(hard.mine(table(spark, rows), asked())) == brute(rows)
    assert ended[0] == 1


def test_bounds_hold():
    rng = np.random.default_rng(3)
    anchors, rows = rng.normal(size=(40, 5)) + 1.0, rng.normal(size=(300, 5)) * rng.exponential(size=(300, 1))
    centres = hard.directions(anchors, 4)
    assert centres.shape == (4, 5) and np.allclose(np.linalg.norm(centres, axis=1), 1)
    angles = hard._angles(anchors, centres)
    own = angles.argmin(axis=1)
    radius = np.array([angles[own == c, c].max(initial=0.0) for c in range(4)])
    bound = np.linalg.norm(rows, axis=1)[:, None] * np.cos(np.maximum(hard._angles(rows, centres) - radius, 0))
    assert (hard._unit(anchors) @ rows.T <= bound[:, own].T + 1e-9).all()


BAD = [(1000, 1, None), (1010, 1, []), (1020, 1, [1.0, None]), (1030, 2, [math.nan, 1.0]), (1040, 2, [math.inf, 1.0]), (None, 1, [1.0, 1.0]), (1050, None, [3.0, 3.0])]


def test_odd_rows_take_no_part(spark):
    rows = made(80, 2, 3, 4)
    assert found(hard.mine(table(spark, rows + BAD), asked())) == brute(rows)


def test_zeros_short_vectors_and_repeats(spark):
    rows = made(60, 3, 2, 5) + [(100, 0, [0.0, 0.0, 0.0]), (110, 1, [2.0]), (121, 0, [0.0])]
    filled = [(i, y, v + [0.0] * (3 - len(v))) for i, y, v in rows]
    again = rows + [(7, 9, [50.0, 50.0, 50.0])] + rows  # the least label counts
    assert found(hard.mine(table(spark, again), asked())) == brute(filled)


def test_one_common_vector_and_label(spark):
    rows = [(i, 0 if i % 3 else i % 5, [3.0, 1.0] if i % 3 else [float(i % 7), 2.0]) for i in range(300)]
    assert found(hard.mine(table(spark, rows), asked())) == brute(rows)


def test_scores_beyond_the_exact_range_of_doubles(spark):
    rows = [(i, i % 2, [float(2**28 + 32 * i), float(i), 1.0]) for i in range(45)]
    assert found(hard.mine(table(spark, rows), asked(), low=0, high=100)) == brute(rows, low=0, high=100)


@pytest.mark.parametrize("rows", [[], BAD, [(0, 1, [1.0])], [(1, 1, [1.0]), (2, 2, [1.0])], [(0, 1, [0.0]), (10, 1, [0.0]), (20, 2, [0.0])]])
def test_little_to_find(spark, rows):
    good = [r for r in rows if r not in BAD]
    assert found(hard.mine(table(spark, rows), asked())) == brute(good)
