"""Every record of a file is kept or listed."""

import json

import pytest
from pyspark.sql import functions as F

from evenhand.plans import datasets
from evenhand.sources import quarantine, readers, schemas


def _listed(checked):
    return sorted((r.file.rsplit("/", 1)[1], r.record, r.reason, r.content) for r in checked.rejected.collect())


def test_header_csv(spark, tmp_path):
    good = [f"{i}.5,{-i},{i % 2},1,c{i % 3}" for i in range(200)]
    bad = {3: "1,2", 50: "a,b,1,1,c", 120: "1,2,3,4,c,6", 199: "1,2,x,1,c"}
    lines = [bad.get(i, line) for i, line in enumerate(good)]
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("x1,x2,s,y,client\n" + "\n\n".join(lines if k == 1 else good) + "\n")
    expected = [("1.csv", i + 2, reason, bad[i]) for i, reason in ((3, "width: 2 of 5"), (50, "type: x1, x2"), (120, "width: 6 of 5"), (199, "type: s"))]
    for size in ("128m", "512"):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = quarantine.header_csv(spark, str(tmp_path), schemas.TWO_D)
            assert _listed(found) == expected
            assert found.rows.count() + found.rejected.count() == 600
            plain = readers.header_csv(spark, str(tmp_path / "0.csv"), schemas.TWO_D)
            own = quarantine.header_csv(spark, str(tmp_path / "0.csv"), schemas.TWO_D)
            assert own.rows.schema == plain.schema and own.rejected.isEmpty()
            assert sorted(own.rows.collect()) == sorted(plain.collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found.rejected.dtypes == [("file", "string"), ("record", "bigint"), ("reason", "string"), ("content", "string")]


def test_quoted_cells_and_missing_values(spark, tmp_path):
    rows = ['"a, b",,"say ""no"""', "x,y,z", ',"",', '"open,2,3', '"a,b",c', "q\\,r,s,t"]
    (tmp_path / "t.csv").write_text("u,v,w\n" + "\n".join(rows) + "\n")
    found = quarantine.text_columns(spark, str(tmp_path / "t.csv"))
    assert found.rows.count() + found.rejected.count() == 6
    assert ("t.csv", 6, "width: 2 of 3", '"a,b",c') in _listed(found)
    plain = {tuple(r) for r in readers.text_columns(spark, str(tmp_path / "t.csv")).collect()}
    assert {tuple(r) for r in found.rows.collect()} <= plain


def test_empty_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("u,v\n")
    found = quarantine.text_columns(spark, str(tmp_path / "t.csv"))
    assert found.rows.columns == ["u", "v"] and found.rows.isEmpty() and found.rejected.isEmpty()


@pytest.mark.parametrize("described", [False, True])
def test_described_csv(spark, tmp_path, described):
    rows = [f"{i},{i}000,{1 + i % 2},{20 + i},{i % 2}" for i in range(50)]
    rows[7], rows[9] = "7,7000", "9,9000,1,29,1,extra"
    top = ["X1,X2,X3"] if described else []
    path = str(tmp_path / "credit.csv")
    (tmp_path / "credit.csv").write_text("\n".join([*top, "ID,LIMIT_BAL,SEX,AGE,default", *rows]) + "\n")
    found = quarantine.described_csv(spark, path)
    first = 2 + described
    assert [r[1:3] for r in _listed(found)] == [(7 + first, "width: 2 of 5"), (9 + first, "width: 6 of 5")]
    assert found.rows.count() == 48
    data = datasets.credit(spark, path, rejects=str(tmp_path / "rejects"))
    assert data.train.count() + data.test.count() == 48
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 2
    # A file that was mended leaves nothing behind.
    (tmp_path / "credit.csv").write_text("\n".join([*top, "ID,LIMIT_BAL,SEX,AGE,default", *rows[10:]]) + "\n")
    datasets.credit(spark, path, rejects=str(tmp_path / "rejects"))
    assert spark.read.parquet(str(tmp_path / "rejects")).isEmpty()


def test_adult_files(spark, tmp_path):
    line = "39, State-gov, 77516, Bachelors, 13, Never-married, ?, Not-in-family, White, Male, 2174, 0, 40, Cuba, <=50K"
    (tmp_path / "adult.data").write_text("\n".join([line, "", line.replace("39", "old"), line, "39, State-gov"]) + "\n\n")
    (tmp_path / "adult.test").write_text("\n".join(["|1x3 Cross validator", line + ".", "|1x3 Cross validator"]) + "\n")
    train, test = quarantine.adult_files(spark, str(tmp_path))
    assert [r[:3] for r in _listed(train)] == [("adult.data", 2, "type: age"), ("adult.data", 4, "width: 2 of 15")]
    assert [r[:3] for r in _listed(test)] == [("adult.test", 3, "width: 1 of 15")]
    plain = readers.adult_files(spark, str(tmp_path))
    assert train.rows.collect() == plain[0].where("income is not null and age is not null").collect()
    assert test.rows.collect() == plain[1].collect() and test.rows.first().occupation is None
    both = [(train, 4), (test, 2)]
    assert all(c.rows.count() + c.rejected.count() == n for c, n in both)


def test_run_results(spark, tmp_path):
    one = {"accuracy": 0.5, "EO_gap": 0.1}
    texts = {"draft_results_a": json.dumps({"baseline": one, "dataset": "toy"}, indent=1), "b": "{\"dataset\": ", "c": "{}", "empty": "", "draft_results_e": json.dumps({"dataset": "law"})}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = quarantine.run_results(spark, str(tmp_path / "*.json"))
    plain = readers.run_results(spark, str(tmp_path / "*.json"))
    assert found.rows.columns == plain.columns and sorted(found.rows.collect(), key=str) == sorted(plain.collect(), key=str)
    assert [r[:3] for r in _listed(found)] == [("b.json", 1, "not JSON"), ("c.json", 1, "no run")]
    assert found.rows.where(F.col("label") == "a").first().baseline.accuracy == 0.5
