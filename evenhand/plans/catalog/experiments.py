"""Queries for run bookkeeping and analytics, over a sweep of fixed scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.operators import metrics, runs as r
from evenhand.plans import oracle as o, views
from evenhand.plans.catalog import register
from evenhand.plans.views import RHOS, SEEDS

KEYS = ["dataset", "universum_off", "rho"]
RUN = [*KEYS, "seed"]
MEANS = [f"{m}_{s}" for m in r.SWEEP_METRICS for s in ("mean", "std")]
# Gap that a configuration may have on validation rows, and reference points to be matched.
TARGET = 0.012
REFERENCE = [(f"client{i}", 0.5 + 0.02 * i, 0.008 + 0.002 * i) for i in range(views.CLIENTS)]


def sweep_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation and test metrics of every run of the sweep, one row per run."""
    by = [*RUN, "part"]
    rated = metrics.outcome_counts(views.sweep_scores(spark, sf_dir), by).select(
        *by, metrics.accuracy().alias("acc"), metrics.eo_gap().alias("eo")
    )
    return rated.groupBy(*RUN).agg(
        *[
            F.max(F.when(F.col("part") == part, F.col(m))).alias(f"{part}_{m}")
            for part in ("val", "test")
            for m in ("acc", "eo")
        ]
    )


def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aggregated sweep, with means that do not depend on the order of summation."""
    grid = r.sweep_grid(sweep_points(spark, sf_dir), KEYS)
    return grid.select(*KEYS, *[F.round(c, 9).alias(c) for c in MEANS], "n")


def nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep in the shape of run results: line numbers as rounds, the last one as the test."""
    points = sweep_points(spark, sf_dir)
    log = F.struct(
        F.col("seed").alias("round"), F.col("val_acc").alias("val_accuracy"), F.col("val_eo").alias("val_EO_gap")
    )
    return points.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(log)).alias("round_logs"),
        F.struct(
            F.max_by("test_acc", "seed").alias("accuracy"), F.max_by("test_eo", "seed").alias("EO_gap")
        ).alias("pipeline"),
    )


def full_grid(spark: SparkSession, *extra: str) -> DataFrame:
    axes = {"dataset": [f"client{i}" for i in range(views.CLIENTS)], "universum_off": [False, True], "rho": RHOS}
    if "seed" in extra:
        axes["seed"] = [*SEEDS, 8]
    return r.config_grid(spark, axes)


_GRID_SQL = (
    f"(SELECT 'client' || unnest(range({views.CLIENTS})) AS dataset), (VALUES (false), (true)) u(universum_off), (VALUES "
    + ", ".join(f"({o.dbl(x)})" for x in RHOS)
    + ") r(rho)"
)
_SEED_SQL = f"{_GRID_SQL}, (VALUES {', '.join(f'({s})' for s in [*SEEDS, 8])}) s(seed)"


@register(
    "a9_pending_runs",
    o.query(f"SELECT g.* FROM (SELECT * FROM {_SEED_SQL}) g ANTI JOIN (SELECT * FROM points WHERE test_acc > 0.55::DOUBLE) p USING (dataset, universum_off, rho, seed)", "points"),
)
def pending_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid points to run again: no result, or one that is not accurate enough."""
    done = sweep_points(spark, sf_dir).filter(F.col("test_acc") > 0.55)
    return r.pending(full_grid(spark, "seed"), done, RUN)


_ORDER = (
    f"CASE WHEN val_eo_mean <= {o.dbl(TARGET)} THEN 0 ELSE 1 END, CASE WHEN val_eo_mean <= {o.dbl(TARGET)} THEN -val_acc_mean ELSE val_eo_mean END, "
    "-val_acc_mean, universum_off, rho"
)
_SELECTED = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {_ORDER}) AS place FROM grid) WHERE place = 1"


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.select_config(sweep_grid(spark, sf_dir), TARGET)


@register(
    "a10_promoted_runs",
    o.query(
        f"SELECT p.dataset, p.universum_off, p.rho, p.seed, p.dataset || '_final_seed' || p.seed AS label, {o.rnd('test_acc')} AS test_acc, {o.rnd('test_eo')} AS test_eo FROM points p SEMI JOIN chosen c USING (dataset, universum_off, rho)",
        "grid",
        chosen=_SELECTED,
    ),
)
def promoted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = r.promoted(sweep_points(spark, sf_dir), _chosen(spark, sf_dir), KEYS)
    label = F.concat(F.col("dataset"), F.lit("_final_seed"), F.col("seed").cast("string")).alias("label")
    return kept.select(*RUN, label, *[F.round(c, 6).alias(c) for c in ("test_acc", "test_eo")])


@register(
    "h1_config_grid",
    o.query(f"SELECT g.dataset, g.universum_off, g.rho, count(p.seed) AS n_runs FROM (SELECT * FROM {_GRID_SQL}) g LEFT JOIN points p USING (dataset, universum_off, rho) GROUP BY ALL", "points"),
)
def config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid, with the number of runs that each point has."""
    counts = sweep_points(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("n_runs"))
    return full_grid(spark).join(counts, KEYS, "left").withColumn("n_runs", F.coalesce("n_runs", F.lit(0).cast("bigint")))


def _grid_columns(source: str = "grid", extra: str = "") -> str:
    return f"SELECT dataset, universum_off, rho, {', '.join(f'{o.rnd(c)} AS {c}' for c in MEANS)}, n{extra} FROM {source}"


def _rounded(grid: DataFrame, *extra: str) -> DataFrame:
    return grid.select(*KEYS, *[F.round(c, 6).alias(c) for c in MEANS], "n", *extra)


@register("h2_seed_summary", o.query(_grid_columns(), "grid"))
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sweep_grid(spark, sf_dir))


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of both models per dataset and seed."""
    by = ["dataset", "model", "seed"]
    scored = views.model_scores(spark, sf_dir)
    report = metrics.evaluate(metrics.outcome_counts(scored, by), by)
    areas = metrics.ranking_metrics(scored, "f", by)
    return report.join(areas, by)


def _table_sql(names: list[str], areas: bool) -> str:
    cells = ", ".join(f"printf('%.4f +/- %.4f', avg({m}), stddev_pop({m})) AS {m}" for m in names)
    source = "model_metrics JOIN model_rows_areas USING (dataset, model, seed)" if areas else "model_metrics"
    needs = ["model_metrics", "model_rows_areas"] if areas else ["model_metrics"]
    return o.query(f"SELECT dataset, model, {cells} FROM {source} GROUP BY dataset, model", *needs)


@register(
    "h3_performance_table",
    _table_sql(["accuracy", "f1", "macro_f1", "balanced_accuracy", "roc_auc", "pr_auc"], True),
)
def performance_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.performance_table(model_metrics(spark, sf_dir))


@register("h4_fairness_table", _table_sql(["dp_gap", "eo_gap", "eod_gap"], False))
def fairness_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["dataset", "model", "seed"]
    report = metrics.evaluate(metrics.outcome_counts(views.model_scores(spark, sf_dir), by), by)
    return r.fairness_table(report)


_FOUR = "printf('%.4f', {0})"


def _labelled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep runs with a name that carries their settings, as files of results have."""
    points = sweep_points(spark, sf_dir)
    label = F.concat(
        F.col("dataset"), F.when(F.col("seed") == 2, "_winner").when(F.col("seed") == 3, "_dirichlet").otherwise("_none"),
        F.when(F.col("seed") != 4, F.concat(F.lit("_rho"), F.col("rho").cast("string"))).otherwise(""),
        F.lit("_eps0.1_seed"), F.col("seed").cast("string"),
    )
    return points.withColumn("label", label)


@register(
    "h5_sensitivity_table",
    o.query(
        "SELECT dataset, CASE WHEN universum_off THEN 'no_universum' ELSE 'universum' END AS variant, rho, 0.1::DOUBLE AS eps, "
        f"{_FOUR.format('test_acc')} AS accuracy, {_FOUR.format('test_eo')} AS eo_gap, {_FOUR.format('val_acc')} AS f1 FROM points WHERE seed NOT IN (2, 3, 4)",
        "points",
    ),
)
def sensitivity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings are read back from the names; winner, skewed and rho-less runs are left out."""
    named = _labelled_runs(spark, sf_dir)
    parsed = named.select(
        "label", *r.run_fields(F.col("label"))[:3],
        F.when(F.col("universum_off"), "no_universum").otherwise("universum").alias("variant"),
        F.col("test_acc").alias("accuracy"), F.col("test_eo").alias("eo_gap"), F.col("val_acc").alias("f1"),
    )
    return r.sensitivity_table(parsed)


@register(
    "h6_skew_table",
    o.query(
        "SELECT e.dataset, e.partition, coalesce(" + _FOUR.format("test_acc") + ", 'FAILED') AS accuracy, coalesce(" + _FOUR.format("test_eo") + f", '{r.STARVED}') AS eo_gap "
        f"FROM (SELECT 'client' || unnest(range({views.CLIENTS})) AS dataset, p.* FROM (VALUES ('iid', 0.01::DOUBLE), ('alpha=1.0', 1.0::DOUBLE), ('alpha=0.5', 0.5::DOUBLE), ('alpha=0.25', 0.25::DOUBLE)) p(partition, rho)) e "
        "LEFT JOIN (SELECT * FROM points WHERE seed = 1 AND NOT universum_off AND NOT (dataset = 'client1' AND rho = 0.01)) t ON t.dataset = e.dataset AND t.rho = e.rho "
        "WHERE t.rho IS NOT NULL OR e.partition <> 'iid'",
        "points",
    ),
)
def skew_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions are matched by name; one skewed partition has no run, and one client has none for the even one."""
    partitions = ["iid", "alpha=1.0", "alpha=0.5", "alpha=0.25"]
    expected = r.config_grid(spark, {"dataset": [f"client{i}" for i in range(views.CLIENTS)], "partition": partitions})
    known = sweep_points(spark, sf_dir).filter("seed = 1 AND NOT universum_off AND NOT (dataset = 'client1' AND rho = 0.01)")
    found = known.select(
        "dataset",
        F.when(F.col("rho") == 0.01, "iid").otherwise(F.concat(F.lit("alpha="), F.col("rho").cast("string"))).alias("partition"),
        F.col("test_acc").alias("accuracy"),
        F.col("test_eo").alias("eo_gap"),
    )
    return r.skew_table(expected, found)


_VARIANTS = [("full (winner)", "rho0.05", 1), ("no_universum", "rho0.05_nouniversum", 1), ("fairness_off", "rho0.01", 2), ("missing", "rho9", 1)]


@register(
    "h7_ablation_table",
    o.query(
        "SELECT p.dataset, v.variant, p.seed, "
        + ", ".join(f"{_FOUR.format(c)} AS {n}" for n, c in (("accuracy", "test_acc"), ("eo_gap", "test_eo"), ("f1", "val_acc"), ("dp_gap", "val_eo"), ("eod_gap", "greatest(val_eo, test_eo)")))
        + " FROM points p JOIN (VALUES ('full (winner)', 0.05::DOUBLE, false, 1), ('no_universum', 0.05::DOUBLE, true, 1), ('fairness_off', 0.01::DOUBLE, false, 2)) v(variant, rho, off, seed) "
        "ON p.rho = v.rho AND p.universum_off = v.off AND p.seed = v.seed",
        "points",
    ),
)
def ablation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named variants keyed by run label and seed; the one without a run is skipped."""
    label = F.concat(F.lit("rho"), F.col("rho").cast("string"), F.when(F.col("universum_off"), "_nouniversum").otherwise(""))
    points = sweep_points(spark, sf_dir).select(
        "dataset", label.alias("label"), "seed", F.col("test_acc").alias("accuracy"), F.col("test_eo").alias("eo_gap"),
        F.col("val_acc").alias("f1"), F.col("val_eo").alias("dp_gap"), F.greatest("val_eo", "test_eo").alias("eod_gap"),
    )
    names = F.array(
        *[F.struct(F.lit(v).alias("variant"), F.lit(l).alias("label"), F.lit(s).alias("seed")) for v, l, s in _VARIANTS]
    )
    variants = r.config_grid(spark, {"dataset": [f"client{i}" for i in range(views.CLIENTS)]}).select("dataset", F.inline(names))
    return r.ablation_table(variants, points)


@register(
    "h8_sweep_grid",
    o.query(
        "SELECT dataset, universum_off, "
        + ", ".join(f"{o.rnd(f'avg({m})')} AS {m}_mean, {o.rnd(f'stddev_pop({m})')} AS {m}_std" for m in r.SWEEP_METRICS)
        + ", count(*) AS n FROM (SELECT dataset, universum_off, rho, max_by(val_acc, seed) AS val_acc, max_by(val_eo, seed) AS val_eo, max_by(test_acc, seed) AS test_acc, max_by(test_eo, seed) AS test_eo FROM points GROUP BY ALL) GROUP BY ALL",
        "points",
    ),
)
def sweep_grid_from_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested results: the last log of each run, summarised over the rhos of a dataset."""
    nested = nested_results(spark, sf_dir)
    grid = r.sweep_grid(r.sweep_points(nested, KEYS), ["dataset", "universum_off"])
    return grid.select("dataset", "universum_off", *[F.round(c, 6).alias(c) for c in MEANS], "n")


@register(
    "h9_coverage",
    o.query(
        f"SELECT * FROM (SELECT g.dataset, g.universum_off, g.rho, count(p.seed) AS n FROM (SELECT * FROM {_GRID_SQL}) g LEFT JOIN (SELECT * FROM points WHERE test_eo < 0.03::DOUBLE) p USING (dataset, universum_off, rho) GROUP BY ALL) WHERE n < 7",
        "points",
    ),
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations short of results when only the fair runs count."""
    return r.coverage(full_grid(spark), sweep_points(spark, sf_dir).filter(F.col("test_eo") < 0.03), KEYS, len(SEEDS))


@register("h10_selected_config", o.query(_grid_columns("chosen"), "grid", chosen=_SELECTED))
def selected_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_chosen(spark, sf_dir))


_FRONTIER = (
    "SELECT g.* FROM grid g WHERE NOT EXISTS (SELECT 1 FROM grid h WHERE h.dataset = g.dataset AND h.test_eo_mean <= g.test_eo_mean AND h.test_acc_mean >= g.test_acc_mean "
    "AND (h.test_eo_mean < g.test_eo_mean OR h.test_acc_mean > g.test_acc_mean))"
)


@register("h11_pareto_frontier", o.query(_grid_columns("frontier"), "grid", frontier=_FRONTIER))
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(r.pareto_frontier(sweep_grid(spark, sf_dir)))


def _matched_sql() -> str:
    reference = ", ".join(f"('{d}', {o.dbl(acc)}, {o.dbl(eo)})" for d, acc, eo in REFERENCE)
    by_acc = "CASE WHEN test_acc_mean >= ref_acc THEN 0 ELSE 1 END, CASE WHEN test_acc_mean >= ref_acc THEN test_acc_mean ELSE -test_acc_mean END, test_eo_mean, universum_off, rho"
    by_eo = "CASE WHEN test_eo_mean <= ref_eo THEN 0 ELSE 1 END, CASE WHEN test_eo_mean <= ref_eo THEN -test_eo_mean ELSE test_eo_mean END, universum_off, rho"
    return o.query(
        "SELECT a.dataset, "
        + ", ".join(
            f"{t}.universum_off AS {n}_match_universum_off, {t}.rho AS {n}_match_rho, {o.rnd(f'{t}.test_acc_mean')} AS {n}_match_acc, {o.rnd(f'{t}.test_eo_mean')} AS {n}_match_eo"
            for t, n in (("a", "acc"), ("e", "eo"))
        )
        + ", a.test_acc_mean >= a.ref_acc AS acc_match_reached, CASE WHEN a.test_eo_mean < a.ref_eo THEN 'fairer' ELSE 'less fair' END AS acc_match_verdict"
        ", e.test_eo_mean <= e.ref_eo AS eo_match_reached, CASE WHEN e.test_acc_mean > e.ref_acc THEN 'higher' ELSE 'lower' END AS eo_match_verdict "
        "FROM ranked a JOIN ranked e ON a.dataset = e.dataset AND a.by_acc = 1 AND e.by_eo = 1",
        "grid",
        frontier=_FRONTIER,
        ranked=f"SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {by_acc}) AS by_acc, row_number() OVER (PARTITION BY dataset ORDER BY {by_eo}) AS by_eo "
        f"FROM frontier JOIN (VALUES {reference}) f(dataset, ref_acc, ref_eo) USING (dataset)",
    )


@register("h12_matched_points", _matched_sql())
def matched_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = spark.createDataFrame(REFERENCE, "dataset string, ref_acc double, ref_eo double")
    matched = r.matched_points(r.pareto_frontier(sweep_grid(spark, sf_dir)), reference)
    numbers = [f"{n}_match_{c}" for n in ("acc", "eo") for c in ("acc", "eo")]
    return matched.withColumns({c: F.round(c, 6) for c in numbers})


@register(
    "h13_selected_flag",
    o.query(
        _grid_columns("(SELECT g.*, c.dataset IS NOT NULL AS selected FROM grid g LEFT JOIN chosen c USING (dataset, universum_off, rho))", ", selected"),
        "grid",
        chosen=_SELECTED,
    ),
)
def selected_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = sweep_grid(spark, sf_dir)
    return _rounded(r.flag_selected(grid, r.select_config(grid, TARGET), KEYS), "selected")


@register(
    "h14_convergence",
    o.query(
        f"SELECT dataset, universum_off, rho, seed AS round, CASE WHEN seed = 5 THEN NULL ELSE {o.rnd('val_acc * 100')} END AS accuracy_pct, {o.rnd('val_eo * 100')} AS eo_gap_pct FROM points",
        "points",
    ),
)
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table of the logs; an accuracy that is missing in a log stays null."""
    holed = nested_results(spark, sf_dir).withColumn(
        "round_logs",
        F.transform(
            "round_logs", lambda log: log.withField("val_accuracy", F.when(log["round"] != 5, log["val_accuracy"]))
        ),
    )
    long = r.convergence(holed, KEYS)
    return long.select(*KEYS, "round", *[F.round(c, 6).alias(c) for c in ("accuracy_pct", "eo_gap_pct")])


@register(
    "h15_distinct_baselines",
    o.query(
        f"SELECT dataset, round(round(base_acc, 2), 4) + 0.0::DOUBLE AS base_acc_key, min(label) AS label, min_by(round(base_acc, 2), label) AS base_acc, {o.rnd('min_by(base_eo, label)')} AS base_eo FROM "
        "(SELECT dataset, test_acc AS base_acc, test_eo AS base_eo, concat_ws(':', dataset, universum_off, rho, seed) AS label FROM points WHERE seed <> 3) GROUP BY dataset, round(round(base_acc, 2), 4)",
        "points",
    ),
)
def distinct_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat_ws(":", *[F.col(c).cast("string") for c in RUN])
    # Runs of seed 3 stand for runs without a result of the fair model.
    rows = sweep_points(spark, sf_dir).select(
        "dataset", label.alias("label"), F.round("test_acc", 2).alias("base_acc"), F.col("test_eo").alias("base_eo"),
        F.when(F.col("seed") != 3, F.col("test_acc")).alias("pipe_acc"),
    )
    return r.distinct_baselines(rows).withColumn("base_eo", F.round("base_eo", 6))


def _cut_sql(m: str) -> str:
    b, p = (f"avg(CASE WHEN model = '{model}' THEN {m} END)" for model in ("baseline", "pipeline"))
    ratio = o.ratio(f"({b} - {p})", b)
    return f"{o.rnd(f'100.0::DOUBLE * {ratio}', 4)} AS {m}_cut_pct"


@register(
    "h16_relative_change",
    o.query(
        f"SELECT dataset, {', '.join(_cut_sql(m) for m in ('dp_gap', 'eo_gap', 'eod_gap'))} FROM model_metrics GROUP BY dataset",
        "model_metrics",
    ),
)
def relative_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["dataset", "model", "seed"]
    report = metrics.evaluate(metrics.outcome_counts(views.model_scores(spark, sf_dir), by), by)
    change = r.relative_change(report, ["dataset"], ["dp_gap", "eo_gap", "eod_gap"])
    return change.select("dataset", *[F.round(c, 4).alias(c) for c in change.columns if c != "dataset"])


@register(
    "g12_ablation_check",
    o.query(
        f"SELECT f.dataset, f.rho, f.seed, {o.rnd('f.test_eo')} AS full_gap, {o.rnd('n.test_eo')} AS ablated_gap, n.test_eo > f.test_eo AS ok "
        "FROM points f JOIN points n USING (dataset, rho, seed) WHERE NOT f.universum_off AND n.universum_off",
        "points",
    ),
)
def ablation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether runs without pseudo-positives have the wider gap."""
    points = sweep_points(spark, sf_dir)
    checked = metrics.raises_gap(points.filter("NOT universum_off"), points.filter("universum_off"), ["dataset", "rho", "seed"], "test_eo")
    return checked.withColumns({c: F.round(c, 6) for c in ("full_gap", "ablated_gap")})
