import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from evenhand.operators import prepare, refine, splits
from evenhand.plans import datasets, sweeps
from evenhand.plans.rounds import RunConfig, buffered_positives, run_experiment, run_settings
from evenhand.sources import ledger, readers, schemas, writers


def test_resolving_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "ID int, `default.payment.next.month` int, Sex int, AGE int")
    assert prepare.resolve_column(df, "sex") == "Sex"
    assert prepare.resolve_column(df, "Y", "default") == "default.payment.next.month"
    with pytest.raises(KeyError):
        prepare.resolve_column(df, "nothing")
    assert prepare.feature_columns(df, "id", "SEX") == ["default.payment.next.month", "AGE"]


def test_modes_ties_and_one_hot(spark):
    df = spark.createDataFrame([("b", "?"), ("a", "x"), (None, "x"), ("b", "?"), ("a", None)], "c string, d string")
    assert {r.column: r["mode"] for r in prepare.column_modes(df, ["c", "d"], missing="?").collect()} == {"c": "a", "d": "x"}
    filled = prepare.impute_modes(df, ["c", "d"], missing="?")
    assert [tuple(x) for x in filled.collect()] == [("b", "x"), ("a", "x"), ("a", "x"), ("b", "x"), ("a", "x")]
    nothing = prepare.impute_modes(df.filter("c IS NULL").select("c"), ["c"])
    assert nothing.first().c == ""
    sparse = prepare.one_hot_vector(df.select("c"), "c", "v").orderBy("c").collect()
    assert [(x.c, x.v.toArray().tolist()) for x in sparse] == [(None, [0.0]), ("a", [0.0]), ("a", [0.0]), ("b", [1.0]), ("b", [1.0])]
    wide = prepare.one_hot(df.select("c"), "c", prepare.categories_of("c", df))
    assert wide.columns == ["c_b"] and [x.c_b for x in wide.collect()] == [1.0, 0.0, 0.0, 1.0, 0.0]


def test_scaling_is_population_and_keeps_flat_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "u double, v double")
    assert [tuple(x) for x in prepare.standardize(df, ["u", "v"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


@pytest.fixture
def census(tmp_path):
    rng = random.Random(1)
    def line(end=""):
        cells = [
            str(rng.randint(20, 60)), rng.choice(["Private", "?", "State-gov"]), str(rng.randint(1, 9999)), "HS-grad", "9", "Married", "Sales",
            "Husband", rng.choice(["White", "Black"]), rng.choice(["Male", "Female"]), "0", str(rng.choice([0, 10])), "40", "Cuba",
        ]
        return ", ".join(cells) + ", " + rng.choice([">50K", "<=50K"]) + end
    (tmp_path / "adult.data").write_text("\n".join(line() for _ in range(120)) + "\n")
    test = [line(".") for _ in range(40)]
    test[0] = test[0].replace("Cuba", "Peru")
    (tmp_path / "adult.test").write_text("|1x3 Cross validator\n" + "\n".join(test) + "\n")
    return str(tmp_path)


def test_census_files(spark, census):
    train, test = readers.adult_files(spark, census)
    assert (train.count(), test.count()) == (120, 40)
    assert train.filter("workclass = '?'").isEmpty() and not train.filter("workclass IS NULL").isEmpty()
    data = datasets.adult(spark, census)
    assert (data.train.count(), data.test.count()) == (120, 40)
    # Six numbers, one workclass dummy (of two) and the country that only the test file has.
    assert len(data.features) == 8 and data.train.columns == data.test.columns
    published = datasets.adult(spark, census, as_published=True)
    none = published.train.filter(F.col(published.features[6]) == 0).count()
    imputed = data.train.filter(F.col(data.features[6]) == 0).count()
    assert none != imputed or train.filter("workclass IS NULL").isEmpty()
    assert not datasets.adult(spark, census, "race").train.filter("a = 1").isEmpty()
    with pytest.raises(ValueError):
        datasets.adult(spark, census, "age")
    table = datasets.census_table(spark, census)
    assert table.columns[-2:] == ["sex", "income"] and table.count() == 160
    assert dict(table.dtypes)["workclass"] == "bigint" and table.filter("workclass IS NULL").isEmpty()
    assert table.select("income").distinct().count() == 2


@pytest.mark.parametrize("described", [False, True])
def test_credit_file(spark, tmp_path, described):
    rng = random.Random(2)
    header = "ID,LIMIT_BAL,SEX,AGE,BILL_AMT1,PAY_AMT1,default payment next month"
    rows = [f"{i},{rng.randint(1, 99)}000,{rng.randint(1, 2)},{20 + i},{rng.choice(['-500', 'bad', '700'])},{i},{i % 2}" for i in range(50)]
    top = ["X1,X2,X3,X4,X5,X6,Y"] if described else []
    (tmp_path / "credit.csv").write_text("\n".join(top + [header] + rows) + "\n")
    path = str(tmp_path / "credit.csv")
    (tmp_path / "later.csv").write_text("not read")
    data = datasets.credit_folder(spark, str(tmp_path))
    assert data.features == ["LIMIT_BAL", "AGE", "BILL_AMT1", "PAY_AMT1"]
    assert data.train.count() == 40 and data.test.count() == 10
    assert data.train.filter("BILL_AMT1 IS NULL").isEmpty()
    by_age = datasets.credit(spark, path, sensitive="age")
    assert by_age.train.unionByName(by_age.test).agg(F.sum("a")).first()[0] == 25
    table = datasets.credit_table(spark, path)
    assert table.columns == ["LIMIT_BAL", "AGE", "BILL_AMT1", "PAY_AMT1", "SEX", "default"]
    assert table.agg(F.min("BILL_AMT1")).first()[0] == pytest.approx(-6.2166061)


def test_compas_file(spark, tmp_path):
    columns = "id,sex,age,age_cat,priors_count,c_charge_degree,juv_fel_count,juv_misd_count,juv_other_count,race,days_b_screening_arrest,is_recid,score_text,two_year_recid"
    good = lambda i, days="0", recid="1", degree="F", score="Low", race="Caucasian": (
        f"{i},Male,{20 + i},25 - 45,{i},{degree},0,0,0,{race},{days},{recid},{score},{i % 2}"
    )
    rows = [good(i, race="Caucasian" if i % 2 else "African-American") for i in range(20)]
    rows += [good(90, days=d) for d in ("", "-31", "31")] + [good(91, recid="-1"), good(92, degree="O"), good(93, race="Other")]
    rows += [good(94, score="N/A"), good(95, score=""), good(96, recid=""), good(97, days="-30"), good(98, days="30")]
    (tmp_path / "c.csv").write_text("\n".join([columns] + rows) + "\n")
    intended = datasets.compas(spark, str(tmp_path / "c.csv"))
    published = datasets.compas(spark, str(tmp_path / "c.csv"), as_published=True)
    assert intended.train.count() + intended.test.count() == 23
    assert published.train.count() + published.test.count() == 25
    assert len(intended.features) == 5  # constant categories leave no dummy


def test_law_and_two_d(spark, tmp_path):
    header = ",".join([*schemas.LAW_FEATURES, "race", "pass_bar"])
    rows = [",".join([str(i)] * 10 + [" White " if i % 3 else "black", "1" if i % 4 else "0"]) for i in range(40)]
    (tmp_path / "law.csv").write_text("\n".join([header] + rows) + "\n")
    law = datasets.law(spark, str(tmp_path / "law.csv"))
    assert law.features == list(schemas.LAW_FEATURES) and law.train.count() == 32
    small = [",".join([str(i)] * 10 + [str(float(i % 2)), "1" if i % 3 else "-1"]) for i in range(10)]
    (tmp_path / "small.csv").write_text("\n".join([header] + small) + "\n")
    sample = datasets.law_sample(spark, str(tmp_path / "small.csv"), str(tmp_path / "small.csv"))
    assert {(r.a, r.y) for r in sample.train.select("a", "y").collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    lines = [f"{i}.5,{-i}.0,{i % 2},{1.0 if i % 3 else -1.0},Client {'ABC'[i % 3]}" for i in range(30)]
    (tmp_path / "2d.csv").write_text("\n".join(["x1,x2,s,y,client"] + lines) + "\n")
    data = datasets.two_d(spark, str(tmp_path / "2d.csv"))
    assert (data.train.count(), data.test.count()) == (24, 6)
    wide = datasets.two_d_as_law(readers.header_csv(spark, str(tmp_path / "2d.csv"), schemas.TWO_D))
    assert wide.columns == [*schemas.LAW_FEATURES, "race", "pass_bar"]
    assert wide.agg(F.sum("lsat"), F.max("pass_bar"), F.min("pass_bar")).first() == (0.0, 1.0, -1.0)
    sources = [(("/nowhere/x.csv",), None), ((str(tmp_path / "2d.csv"),), lambda s, p: readers.header_csv(s, p, schemas.TWO_D))]
    assert readers.first_source(spark, sources).count() == 30
    with pytest.raises(FileNotFoundError):
        readers.first_source(spark, sources[:1])


def _prepared(spark, n=900, seed=0):
    """A small table with signal, and groups that differ in it."""
    base = spark.range(n).select(F.col("id").cast("string").alias("row_id"), F.rand(seed).alias("u"), F.rand(seed + 1).alias("v"), F.rand(seed + 2).alias("w"))
    rows = base.select(
        "row_id", (F.col("u") > 0.6).cast("int").alias("a"), ((F.col("v") + 0.4 * F.col("u")) > 0.75).cast("int").alias("y"),
        (F.col("v") * 10).alias("x1"), F.col("w").alias("x2"),
    )
    from evenhand.operators.sizes import cut_lineage

    kept = cut_lineage(rows.withColumn("client", F.when(F.col("a") == 1, 0).otherwise(F.crc32("row_id") % 3).cast("int")))
    return datasets.Prepared(kept.filter("crc32(row_id) % 5 > 0"), kept.filter("crc32(row_id) % 5 = 0"), ["x1", "x2"])


CONFIG = RunConfig(
    clients=3, rounds=2, seed=1, intercept=True, tune_threshold=True, noise_enabled=False, solver=refine.RefineConfig(inner_steps=30)
)


def test_run_end_to_end(spark, tmp_path):
    data = _prepared(spark)
    result = run_experiment(data, CONFIG, "toy")
    row = result.first()
    assert row.baseline.accuracy > 0.85 and row.pipeline.accuracy > 0.6
    assert row.baseline.extended_metrics.ROC_AUC > 0.9
    assert [log.round for log in row.round_logs] == [0, 1]
    assert row.pipeline.num_clients == 3 and row.pipeline.dp_variant == "none"
    again = run_experiment(data, CONFIG, "toy").first()
    assert again.pipeline.accuracy == row.pipeline.accuracy and again.baseline.accuracy == row.baseline.accuracy
    writers.write_runs(result, str(tmp_path / "out"))
    back = spark.read.schema(schemas.RUN).json(str(tmp_path / "out")).first()
    assert back.pipeline == row.pipeline and back.dataset == "toy"


@pytest.mark.parametrize(
    "change",
    [
        {"partition": "dirichlet", "dirichlet_alpha": 0.3, "min_rows": 20, "buffer": True},
        {"partition": "natural", "universum": False, "refine_features": False},
        {"noise_enabled": True, "noise_variant": "both", "noise_sigma": 0.1, "fairness": False, "scale": False, "intercept": False},
    ],
)
def test_run_variants(spark, change):
    row = run_experiment(_prepared(spark, 600, 5), dataclasses.replace(CONFIG, **change), "toy").first()
    assert 0.3 < row.pipeline.accuracy <= 1.0 and len(row.round_logs) == 2


def test_bad_partition_is_refused():
    with pytest.raises(ValueError):
        RunConfig(partition="random")


def test_buffer_only_fills_missing_groups_with_earlier_positives(spark):
    rows = [(0, 0, 0, 1, "a"), (0, 0, 1, 1, "b"), (1, 0, 0, 1, "c"), (1, 0, 1, 0, "d"), (2, 0, 1, 1, "e")]
    batch = spark.createDataFrame(rows, "round int, client_id int, a int, y int, row_id string").withColumns(
        {"pos": F.lit(1), "x": F.array(F.lit(1.0))}
    )
    got = {(r["round"], r.a, r.row_id) for r in buffered_positives(batch, 3).collect()}
    assert got == {(1, 1, "b"), (2, 0, "a"), (2, 0, "c")}


def test_sweep_resumes(spark, tmp_path):
    calls = []

    def fake(data, configs, name):
        calls.append(sorted((c.universum, c.solver.rho, c.seed) for c in configs.values()))
        log = {"round": 0, "val_accuracy": 0.6, "val_EO_gap": 0.05}
        documents = []
        for setting, config in configs.items():
            one = {"accuracy": 0.5 + config.seed / 10, "EO_gap": config.solver.rho}
            documents.append({"setting": setting, "baseline": one, "pipeline": one, "dataset": name, "round_logs": [log]})
        return spark.createDataFrame(documents, f"setting STRING, {schemas.RUN}")

    folder = str(tmp_path / "sweep")
    first = sweeps.run_sweep(spark, {"toy": None}, folder, [0.1], [1, 2], CONFIG, fake)
    assert first.count() == 4 and calls == [[(u, 0.1, seed) for u in (False, True)] for seed in (1, 2)]
    second = sweeps.run_sweep(spark, {"toy": None}, folder, [0.1], [1, 2, 3], CONFIG, fake)
    assert second.count() == 6 and len(calls) == 3
    assert all(r.pipeline.EO_gap == r.rho and r.pipeline.accuracy == 0.5 + r.seed / 10 for r in second.collect())


def _runs(spark, *accuracies):
    """Runs of so many labels."""
    rows = [({"accuracy": a}, {"accuracy": a}, "toy", [], f"run{i}") for i, a in enumerate(accuracies)]
    return spark.createDataFrame(rows, f"{schemas.RUN}, label STRING")


def test_a_run_written_twice_reads_once(spark, tmp_path):
    folder = str(tmp_path / "runs")
    assert readers.written_runs(spark, folder).count() == 0
    for accuracy in (0.5, 0.6, 0.7):
        writers.write_runs(_runs(spark, accuracy).drop("label"), folder, "seed1")
    writers.write_runs(_runs(spark, 0.9).drop("label"), folder, "seed2")
    assert sorted((r.label, r.pipeline.accuracy) for r in readers.written_runs(spark, folder).collect()) == [("seed1", 0.7), ("seed2", 0.9)]
    assert ledger.commits(spark, folder) == [1, 2, 3, 4]


def test_a_killed_write_leaves_the_old_result(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "runs")
    writers.write_runs(_runs(spark, 0.5, 0.6), folder, F.col("label"))

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(ledger, "_renamed", killed)
        with pytest.raises(KeyboardInterrupt):
            writers.write_runs(_runs(spark, 0.1, 0.1), folder, F.col("label"))
    assert sorted(r.pipeline.accuracy for r in readers.written_runs(spark, folder).collect()) == [0.5, 0.6]


def test_writers_at_once_take_different_numbers(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "runs")
    writers.write_runs(_runs(spark, 0.5), folder, F.col("label"))
    with monkeypatch.context() as patch:
        patch.setattr(ledger, "commits", lambda *args: [])  # another writer took number 1 meanwhile
        assert writers.write_runs(_runs(spark, 0.6), folder, F.col("label")) == 2
    assert [r.pipeline.accuracy for r in readers.written_runs(spark, folder).collect()] == [0.6]


def test_compacted_results_stay(spark, tmp_path):
    folder = str(tmp_path / "runs")
    for accuracy in (0.5, 0.6):
        writers.write_runs(_runs(spark, accuracy, 0.8), folder, F.col("label"))
    assert ledger.compact(spark, folder, f"{schemas.RUN}, label STRING", writers.RUN_KEYS) == 3
    assert ledger.commits(spark, folder) == [3]
    assert sorted(r.pipeline.accuracy for r in readers.written_runs(spark, folder).collect()) == [0.6, 0.8]
    with pytest.raises(ValueError, match="several rows"):
        writers.write_runs(_runs(spark, 0.5, 0.6), folder, "same")


def test_settings_in_one_program_give_what_single_runs_give(spark):
    data = _prepared(spark, 500, 3)
    configs = {
        f"{rho}{off}": dataclasses.replace(CONFIG, universum=not off, solver=dataclasses.replace(CONFIG.solver, rho=rho))
        for rho, off in ((0.05, False), (5.0, True))
    }
    configs["still"] = dataclasses.replace(CONFIG, refine_features=False)
    together = {r.setting: r for r in run_settings(data, configs, "toy").collect()}
    assert set(together) == set(configs)
    for name in ("5.0True", "still"):
        alone = run_experiment(data, configs[name], "toy").first()
        assert together[name].pipeline == alone.pipeline and together[name].baseline == alone.baseline
        assert together[name].round_logs == alone.round_logs


def test_client_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "train" if i % 4 else "test", i % 5) for i in range(40)], "v int, split string, client_id int")
    writers.write_client_files(df.repartition(16), str(tmp_path), "toy", file_rows=4)
    assert spark.read.parquet(str(tmp_path / "toy")).filter("split = 'train' AND client_id = 2").count() == 6
    # 30 training rows of 5 clients, 6 each: two files at most; 10 test rows, 2 each: one file.
    files = list((tmp_path / "toy").glob("split=*/client_id=*/*.parquet"))
    assert len(files) <= 15 and len(list((tmp_path / "toy" / "split=test").glob("client_id=*/*.parquet"))) == 5


def test_census_sources_by_priority(spark, tmp_path):
    def rows(n, seed, end=""):
        rng = random.Random(seed)
        return [
            f"{rng.randint(20, 60)},{rng.choice(['Private', '?', 'State-gov'])},{rng.choice(['HS', 'BA', ''])},{rng.choice(['White', 'Black'])},{rng.choice(['Male', 'Female'])},{rng.choice(['>50K', '<=50K'])}{end}"
            for _ in range(n)
        ]

    header = "age,workclass,education,race,sex,income"
    (tmp_path / "adult_all.csv").write_text("\n".join([header, *rows(50, 1)]) + "\n")
    one = datasets.census(spark, str(tmp_path))
    assert (one.train.count(), one.test.count()) == (40, 10)
    (tmp_path / "adult_train.csv").write_text("\n".join([header, *rows(30, 2)]) + "\n")
    (tmp_path / "adult_test.csv").write_text("\n".join([header, *rows(12, 3, "."), "33,Never,BA,White,Male,>50K"]) + "\n")
    two = datasets.census(spark, str(tmp_path), "race")
    assert (two.train.count(), two.test.count()) == (30, 13)
    # age, two of three or more work classes, one of two educations; the test-only class is a column of both.
    assert two.train.columns == two.test.columns and len(two.features) == 4
    with pytest.raises(FileNotFoundError):
        datasets.census(spark, str(tmp_path / "none"))


def test_row_ids_do_not_depend_on_the_files(spark, tmp_path):
    lines = [f"{i % 37},{i % 5}" for i in range(400)]
    for name, parts in (("a", 1), ("b", 4)):
        (tmp_path / name).mkdir()
        order = lines if parts == 1 else lines[::-1]
        for k in range(parts):
            (tmp_path / name / f"{k}.csv").write_text("\n".join(["u,v", *order[k::parts]]) + "\n")
    found = []
    for name, size in (("a", "128m"), ("a", "256"), ("b", "512")):
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = datasets.with_row_id(readers.header_csv(spark, str(tmp_path / name), "u INT, v INT"))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        found.append(sorted(tuple(r) for r in splits.split_by_count(rows, "row_id", 3, 0.25).collect()))
    assert found[0] == found[1] == found[2] and len({r[2] for r in found[0]}) == 400


def test_common_rows_are_numbered_in_many_tasks(spark):
    rows = spark.range(0, 3000, 1, 12).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("v"), F.lit("x").alias("w"))
    keyed = datasets.with_row_id(rows)
    ids = [r.row_id.split(":") for r in keyed.where("v = 0").collect()]
    assert len({i for i, _ in ids}) == 1 and sorted(int(n) for _, n in ids) == list(range(1, 1001))
    assert keyed.columns == ["v", "w", "row_id"] and keyed.select("row_id").distinct().count() == 3000
    assert set(keyed.where("v <> 0").select(F.split("row_id", ":")[1].alias("n")).distinct().toPandas().n) == {"1"}


def test_published_winner(spark, tmp_path):
    one = {"accuracy": 0.5, "EO_gap": 0.1}
    document = {"baseline": one, "pipeline": one, "dataset": "toy", "round_logs": []}
    rows = spark.createDataFrame([document], schemas.RUN)
    for rho in (0.1, 0.5):
        for seed in (1, 2):
            made = rows.withColumns({"universum_off": F.lit(False), "rho": F.lit(rho), "seed": F.lit(seed)})
            made.write.mode("append").partitionBy("dataset").json(str(tmp_path / "sweep"))
    chosen = spark.createDataFrame([("toy", False, 0.5)], "dataset string, universum_off boolean, rho double")
    final = sweeps.promote(spark, str(tmp_path / "sweep"), chosen, str(tmp_path / "final"))
    assert sorted((r.label, r.rho) for r in final.collect()) == [("toy_final_seed1", 0.5), ("toy_final_seed2", 0.5)]
