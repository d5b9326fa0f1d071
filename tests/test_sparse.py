"""Sparse inputs against the dense ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.operators import prepare, sparse, training
from evenhand.plans import datasets


def _rows(spark, n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        c, d = rng.choice(["p", "q", "r", "s", None]), rng.choice("uv")
        v = rng.gauss(3, 2)
        rows.append((i, c, d, v, 1.0, i % 2, int(rng.random() < 0.3 + 0.4 * (c == "q") + 0.2 * (v > 3))))
    return spark.createDataFrame(rows, "row_id int, c string, d string, v double, flat double, a int, y int")


def _dense(df):
    """The same inputs as columns: standardised numbers, categories over their spread."""
    wide = prepare.standardize(df, ["v", "flat"])
    for c in ("c", "d"):
        names = prepare.categories_of(c, df)
        wide = prepare.one_hot(wide, c, names)
        for name in names[1:]:
            column = f"{c}_{name}"
            spread = df.select(F.stddev_pop((F.coalesce(F.col(c) == name, F.lit(False))).cast("int"))).first()[0]
            wide = wide.withColumn(column, F.col(column) / F.lit(spread))
    features = [c for c in wide.columns if c not in ("row_id", "a", "y")]
    return wide.select("row_id", "a", "y", F.array(*features).alias("x")), len(features)


def _filled(x, width):
    out = np.zeros(width)
    out[x.idx] = x.val
    return out


def test_rows_fits_and_scores_are_those_of_the_dense_form(spark):
    df = _rows(spark)
    coding = sparse.encoding(df, ["v", "flat"], ["c", "d"])
    rows = sparse.sparse_rows(df, coding)
    dense, width = _dense(df)
    assert coding.width == width == 6 and rows.columns == ["row_id", "a", "y", "x"]
    plain = {r.row_id: np.array(r.x) for r in dense.collect()}
    for r in rows.collect():
        assert list(r.x.idx) == sorted(r.x.idx) and _filled(r.x, width) == pytest.approx(plain[r.row_id])
    fit = sparse.fit_sparse(rows, width, 0.5)
    assert fit.converged
    assert fit.weights == pytest.approx(training.fit_anchored(dense, width, 0.5, [0.0] * (width + 1)).weights, abs=1e-5)
    scored = sparse.score_sparse(rows.withColumn("f", F.lit("clash")), fit.weights)
    assert scored.columns == ["row_id", "a", "y", "x", "f"]
    for r in scored.collect():
        assert r.f == pytest.approx(plain[r.row_id] @ fit.weights[:-1] + fit.weights[-1] * r.a)


def test_unknown_categories_and_nulls_have_no_place(spark):
    coding = sparse.encoding(_rows(spark), ["v"], ["c"])
    odd = spark.createDataFrame([("new", None), (None, None), ("p", 0.0)], "c string, v double")
    assert [len(r.x.idx) for r in sparse.sparse_rows(odd, coding).collect()] == [0, 0, 1]


def test_no_rows_give_the_anchor(spark):
    rows = spark.createDataFrame([], f"a int, y int, x {sparse.INPUTS}")
    assert sparse.fit_sparse(rows, 2, 0.1, [0.3, 0.2, 0.1]) == training.Fit([0.3, 0.2, 0.1], 0, True)


def test_many_categories_stay_off_the_driver(spark, monkeypatch):
    n = 60_000
    df = spark.range(n).select(
        F.col("id").alias("row_id"), F.concat(F.lit("c"), F.col("id") % (n // 2)).alias("c"), (F.col("id") % 3 == 0).cast("int").alias("a"),
        (F.crc32(F.col("id").cast("string")) % 2).cast("int").alias("y"), (F.col("id") % 7).cast("double").alias("v"),
    )
    sizes, plain = [], type(df).collect

    def collect(self):
        out = plain(self)
        sizes.append(len(out))
        return out

    monkeypatch.setattr(type(df), "collect", collect)
    coding = sparse.encoding(df, ["v"], ["c"])
    assert coding.width == n // 2
    rows = sparse.sparse_rows(df, coding)
    fit = sparse.fit_sparse(rows, coding.width, 1e9, max_steps=20)
    assert len(fit.weights) == n // 2 + 1 and np.isfinite(fit.weights).all()
    assert max(sizes, default=0) < 50


def test_census_loader(spark, tmp_path):
    rng = random.Random(5)

    def lines(n, end=""):
        return [f"{rng.randint(20, 60)},{rng.choice(['Private', '?', 'State-gov'])},{rng.choice(['HS', 'BA', ''])},White,{rng.choice(['Male', 'Female'])},{rng.choice(['>50K', '<=50K'])}{end}" for _ in range(n)]

    header = "age,workclass,education,race,sex,income"
    (tmp_path / "train.csv").write_text("\n".join([header, *lines(40)]) + "\n")
    (tmp_path / "test.csv").write_text("\n".join([header, *lines(12, "."), "33,Never,BA,White,Male,>50K"]) + "\n")
    data = datasets.adult_csv_sparse(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"))
    wide = datasets.adult_csv(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"))
    assert (data.train.count(), data.test.count()) == (40, 13) and data.width == len(wide.features)
    labels = {r.row_id: (r.a, r.y) for r in wide.train.collect()}
    assert {r.row_id: (r.a, r.y) for r in data.train.collect()} == labels
    assert sparse.fit_sparse(data.train, data.width, 0.1).converged
