import json

import pytest
from pyspark.sql import functions as F

from evenhand.operators import runs as r
from evenhand.sources import readers, writers

# Published means of a sweep, as (universum_off, rho, val_acc, val_eo, test_acc, test_eo).
# Law has the same values with and without pseudo-positives.
CREDIT = [
    (False, 0.01, 0.6013, 0.0785, 0.7371, 0.0672), (False, 0.05, 0.6013, 0.0789, 0.7372, 0.0675),
    (False, 0.1, 0.6013, 0.0789, 0.7371, 0.0672), (False, 0.5, 0.6015, 0.0782, 0.7374, 0.0678),
    (False, 1.0, 0.6012, 0.0782, 0.7372, 0.0666), (True, 0.01, 0.6896, 0.0247, 0.7679, 0.0347),
    (True, 0.05, 0.6649, 0.0421, 0.7615, 0.0352), (True, 0.1, 0.6717, 0.0174, 0.7552, 0.0332),
    (True, 0.5, 0.6570, 0.0357, 0.7557, 0.0133), (True, 1.0, 0.6624, 0.0277, 0.7630, 0.0241),
]
ADULT = [
    (False, 0.01, 0.6896, 0.0932, 0.6860, 0.0939), (False, 0.05, 0.6920, 0.1230, 0.6887, 0.1180),
    (False, 0.1, 0.6985, 0.0640, 0.6962, 0.0687), (False, 0.5, 0.6908, 0.0943, 0.6870, 0.0731),
    (False, 1.0, 0.6981, 0.0740, 0.6974, 0.0756), (True, 0.01, 0.7486, 0.0843, 0.7471, 0.0728),
    (True, 0.05, 0.7466, 0.0689, 0.7443, 0.0764), (True, 0.1, 0.7431, 0.0962, 0.7440, 0.1128),
    (True, 0.5, 0.7425, 0.0622, 0.7429, 0.0768), (True, 1.0, 0.7398, 0.0672, 0.7403, 0.0618),
]
LAW = [
    (0.01, 0.8121, 0.1833, 0.6927, 0.2599), (0.05, 0.8123, 0.1847, 0.6981, 0.2638),
    (0.1, 0.8123, 0.1865, 0.6999, 0.2624), (0.5, 0.8080, 0.1774, 0.6763, 0.2405), (1.0, 0.8090, 0.1733, 0.6872, 0.2402),
]
# Published single-run points of another method, (accuracy, gap).
POINTS = [("adult", 0.7738, 0.1192), ("credit", 0.7445, 0.0098), ("law", 0.8438, 0.0849)]
# Accuracy and gap of five published runs per model.
COMPAS_RUNS = {
    "baseline": [(0.634470, 0.282191), (0.643939, 0.264058), (0.641098, 0.256773), (0.639205, 0.290880), (0.640152, 0.286418)],
    "pipeline": [(0.652462, 0.254434), (0.639205, 0.129718), (0.637311, 0.127595), (0.625000, 0.097320), (0.607008, 0.219842)],
}
ADULT_RUNS = {
    "baseline": [(0.845218, 0.020876), (0.845280, 0.019181), (0.844973, 0.020410), (0.845587, 0.019955), (0.845157, 0.014097)],
    "pipeline": [(0.696456, 0.063458), (0.696456, 0.097174), (0.681838, 0.046589), (0.708249, 0.000254), (0.697930, 0.135997)],
}


@pytest.fixture(scope="module")
def grid(spark):
    rows = [("credit", *x) for x in CREDIT] + [("adult", *x) for x in ADULT]
    rows += [("law", off, *x) for off in (False, True) for x in LAW]
    schema = "dataset string, universum_off boolean, rho double, val_acc_mean double, val_eo_mean double, test_acc_mean double, test_eo_mean double"
    return spark.createDataFrame(rows, schema).cache()


def test_published_selection(grid):
    chosen = r.select_config(grid)
    want = {("adult", True, 0.01), ("credit", True, 0.01), ("law", False, 1.0)}
    assert {(c.dataset, c.universum_off, c.rho) for c in chosen.collect()} == want
    flagged = r.flag_selected(grid, chosen, ["dataset", "universum_off", "rho"])
    assert flagged.count() == 30
    assert {(c.dataset, c.universum_off, c.rho) for c in flagged.filter("selected").collect()} == want


@pytest.mark.parametrize("salts", [1, 32])
def test_published_frontier(grid, salts):
    got = {(c.dataset, c.universum_off, c.rho) for c in r.pareto_frontier(grid, salts=salts).collect()}
    want = {("adult", True, 1.0), ("adult", True, 0.01), ("credit", True, 0.5), ("credit", True, 1.0), ("credit", True, 0.01)}
    want |= {("law", off, rho) for off in (False, True) for rho in (1.0, 0.01, 0.1)}
    assert got == want


def test_published_matched_points(spark, grid):
    reference = spark.createDataFrame(POINTS, "dataset string, ref_acc double, ref_eo double")
    got = {c.dataset: c for c in r.matched_points(r.pareto_frontier(grid), reference).collect()}
    adult, credit, law = got["adult"], got["credit"], got["law"]
    assert (adult.acc_match_acc, adult.acc_match_eo, adult.acc_match_reached) == (0.7471, 0.0728, False)
    assert (adult.eo_match_acc, adult.eo_match_eo, adult.eo_match_verdict) == (0.7471, 0.0728, "lower")
    assert (credit.acc_match_rho, credit.acc_match_acc, credit.acc_match_verdict) == (0.5, 0.7557, "less fair")
    assert (credit.eo_match_eo, credit.eo_match_reached, credit.eo_match_verdict) == (0.0133, False, "higher")
    assert (law.acc_match_rho, law.acc_match_acc, law.eo_match_eo, law.eo_match_acc) == (0.1, 0.6999, 0.2402, 0.6872)


def test_no_feasible_row_takes_the_fairest(spark):
    rows = [("d", False, 0.1, 0.9, 0.5), ("d", True, 0.2, 0.8, 0.3), ("d", True, 0.1, 0.8, 0.3)]
    df = spark.createDataFrame(rows, "dataset string, universum_off boolean, rho double, val_acc_mean double, val_eo_mean double")
    chosen = r.select_config(df).first()
    assert (chosen.universum_off, chosen.rho) == (True, 0.1)


def _nested(spark, tmp_path):
    folder = tmp_path / "runs"
    folder.mkdir()
    for dataset, models in (("compas", COMPAS_RUNS), ("adult", ADULT_RUNS)):
        for seed in range(1, 6):
            doc = {
                m: {"accuracy": v[seed - 1][0], "F1_score": 0.5, "EO_gap": v[seed - 1][1], "extended_metrics": {"PR_AUC": 0.1, "ROC_AUC": 0.2, "macro_F1": 0.3, "balanced_accuracy": 0.4, "DP_gap": 0.0, "EOD_gap": 0.0}}
                for m, v in models.items()
            }
            logs = [{"round": t, "val_accuracy": 0.5 + t / 10, "val_EO_gap": 0.1 * t} for t in range(3)]
            doc |= {"dataset": dataset, "round_logs": logs if seed > 1 else []}
            (folder / f"draft_results_{dataset}_final_seed{seed}.json").write_text(json.dumps(doc, indent=2))
    (folder / "draft_results_broken.json").write_text("{ not json")
    return str(folder)


def test_published_tables_from_nested_files(spark, tmp_path):
    runs = readers.run_results(spark, _nested(spark, tmp_path) + "/*.json")
    assert runs.count() == 10
    named = runs.select("label", *r.run_fields(F.col("label")), "baseline", "pipeline", "round_logs")
    assert {(x.dataset, x.seed, x.final) for x in named.collect()} == {(d, s, True) for d in ("adult", "compas") for s in range(1, 6)}
    table = {(x.dataset, x.model): x for x in r.performance_table(r.by_model(named, ["dataset", "seed"])).collect()}
    assert table[("compas", "baseline")].accuracy == "0.6398 +/- 0.0031"
    assert table[("compas", "pipeline")].accuracy == "0.6322 +/- 0.0153"
    assert table[("adult", "baseline")].accuracy == "0.8452 +/- 0.0002"
    assert table[("adult", "pipeline")].accuracy == "0.6962 +/- 0.0084"
    gaps = {(x.dataset, x.model): x.eo_gap for x in r.fairness_table(r.by_model(named, ["dataset"])).collect()}
    assert gaps[("compas", "baseline")] == "0.2761 +/- 0.0133" and gaps[("adult", "pipeline")] == "0.0687 +/- 0.0459"
    points = r.sweep_points(named, ["dataset", "seed"])
    assert points.count() == 8 and {x.val_acc for x in points.collect()} == {0.7}
    assert r.convergence(named, ["dataset", "seed"]).count() == 24
    cut = {x.dataset: x.eo_gap_cut_pct for x in r.relative_change(r.by_model(named, ["dataset"]), ["dataset"], ["eo_gap"]).collect()}
    assert round(cut["compas"]) == 40
    assert r.nan_counts(named, ["label"], [F.array("baseline.accuracy", F.lit(float("nan")))]).filter("n_nan <> 1").isEmpty()


def test_run_fields_from_names(spark):
    names = [
        "credit_pre_server_rho0.05_eps0.25", "adult_dirichlet_alpha0.5", "law_rho1.0_nouniversum_seed3", "credit_ablation_nointercept",
    ]
    rows = spark.createDataFrame([(n,) for n in names], "label string").select(*r.run_fields(F.col("label"))).collect()
    assert [(x.dataset, x.rho, x.eps, x.alpha, x.seed, x.ablation, x.universum_off) for x in rows] == [
        ("credit", 0.05, 0.25, None, None, None, False),
        ("adult", None, None, 0.5, None, None, False),
        ("law", 1.0, None, None, 3, None, True),
        ("credit", None, None, None, None, "nointercept", False),
    ]


def test_report_tables(spark, tmp_path):
    runs = spark.createDataFrame(
        [("a", "iid", 0.71051, 0.082, "a_none_rho0.1_eps0.1", "none", 0.1, 0.1, 0.44), ("b", "iid", 0.5, 0.1, "b_winner_rho0.1_eps0.1", "none", 0.1, 0.1, 0.4)],
        "dataset string, partition string, accuracy double, eo_gap double, label string, variant string, rho double, eps double, f1 double",
    )
    expected = spark.createDataFrame([("c", "iid"), ("a", "alpha=0.1"), ("a", "alpha=0.5"), ("a", "iid"), ("c", "alpha=0.5")], "dataset string, partition string")
    got = [(x.dataset, x.partition, x.accuracy, x.eo_gap) for x in r.skew_table(expected, runs).collect()]
    assert got == [
        ("a", "iid", "0.7105", "0.0820"), ("a", "alpha=0.5", "FAILED", r.STARVED), ("a", "alpha=0.1", "FAILED", r.STARVED),
        ("c", "alpha=0.5", "FAILED", r.STARVED),
    ]
    kept = r.sensitivity_table(runs)
    assert [x.dataset for x in kept.collect()] == ["a"]
    writers.write_table(kept, str(tmp_path / "table"))
    assert spark.read.option("header", True).csv(str(tmp_path / "table")).first().accuracy == "0.7105"
    # The order is that of the printed accuracy: 0.71051 and 0.71049 are 0.7105 both, so the name decides.
    close = runs.limit(1).union(runs.limit(1).withColumns({"label": F.lit("Z_rho0.1_eps0.1"), "accuracy": F.lit(0.71052)}))
    assert [x.rho for x in r.sensitivity_table(close.withColumn("rho", F.when(F.col("label") < "a", 1.0).otherwise(2.0))).collect()] == [1.0, 2.0]
    base = spark.createDataFrame(
        [("d", "x", 0.70001, 0.1, 0.5), ("d", "w", 0.70004, 0.2, 0.5), ("d", "a", 0.70004, 0.9, None), ("d", "z", None, 0.3, 0.5)],
        "dataset string, label string, base_acc double, base_eo double, pipe_acc double",
    )
    only = r.distinct_baselines(base).collect()
    assert [(x.label, x.base_eo) for x in only] == [("w", 0.2)]


def test_grid_pending_and_coverage(spark):
    grid = r.config_grid(spark, {"dataset": ["a", "b"], "rho": [0.1, 0.5]})
    done = spark.createDataFrame([("a", 0.1, 1), ("a", 0.1, 2), ("b", 0.5, 1)], "dataset string, rho double, seed int")
    keys = ["dataset", "rho"]
    assert {tuple(x) for x in r.pending(grid, done, keys).collect()} == {("a", 0.5), ("b", 0.1)}
    assert {tuple(x) for x in r.coverage(grid, done, keys, 2).collect()} == {("a", 0.5, 0), ("b", 0.1, 0), ("b", 0.5, 1)}
    chosen = spark.createDataFrame([("a", 0.1)], "dataset string, rho double")
    assert r.promoted(done, chosen, keys).count() == 2
