"""Queries for metrics, threshold choice and result checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.functions import vectors
from evenhand.operators import metrics as m
from evenhand.operators.splits import split_by_count
from evenhand.plans import oracle as o, views
from evenhand.plans.catalog import register
from evenhand.plans.catalog.fitting import FIT_ANCHOR, SCALED, exact_fit, newton, scaled_lines
from evenhand.plans.views import CLIENTS, SEED


def _report(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> DataFrame:
    report = m.evaluate(m.outcome_counts(views.predicted_lines(spark, sf_dir), ["client_id"]), ["client_id"])
    return report.select("client_id", *[F.col(c) if c == "n" else F.round(c, 6).alias(c) for c in names])


def _report_sql(*names: str) -> str:
    return o.query(
        f"SELECT client_id, {o.metrics(*names)} FROM (SELECT client_id, {o.outcome_cells()} FROM predicted GROUP BY client_id)",
        "predicted",
    )


_CONFUSION = ["n", "accuracy", "precision", "recall", "f1"]


@register("g1_confusion_metrics", _report_sql(*_CONFUSION))
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, _CONFUSION)


@register("g2_eo_gap", _report_sql("tpr0", "tpr1", "eo_gap"))
def eo_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, ["tpr0", "tpr1", "eo_gap"])


@register("g3_dp_gap", _report_sql("dp_gap"))
def dp_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, ["dp_gap"])


@register("g4_eod_gap", _report_sql("eod_gap"))
def eod_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, ["eod_gap"])


def _areas(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Per client, and over all rows as client -1."""
    scored = views.scored_lines(spark, sf_dir).select("client_id", "y", "f")
    clients = m.ranking_metrics(scored, "f", ["client_id"])
    whole = m.ranking_metrics(scored, "f").withColumn("client_id", F.lit(-1))
    return clients.unionByName(whole).select("client_id", F.round(name, 6).alias(name))


def _areas_sql(name: str) -> str:
    expressions = {k: body for k, (_, body) in o.auc("tagged", "client_id").items()}
    return o.query(
        f"SELECT client_id, {o.rnd(name)} AS {name} FROM tagged_areas",
        "scored",
        tagged="SELECT client_id, y, f FROM scored UNION ALL SELECT -1 AS client_id, y, f FROM scored",
        **expressions,
    )


@register("g5_roc_auc", _areas_sql("roc_auc"))
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _areas(spark, sf_dir, "roc_auc")


@register("g6_average_precision", _areas_sql("pr_auc"))
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _areas(spark, sf_dir, "pr_auc")


@register("g7_macro_and_balanced", _report_sql("macro_f1", "balanced_accuracy"))
def macro_and_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, ["macro_f1", "balanced_accuracy"])


@register(
    "g8_threshold",
    o.query(
        f"SELECT client_id, {o.rnd('t', 9)} AS threshold, {o.rnd('balanced', 9)} AS balanced FROM "
        "(SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY balanced DESC, i) AS place FROM judged) WHERE place = 1",
        "scored",
        tagged="SELECT client_id, y, f FROM scored UNION ALL SELECT -1 AS client_id, y, f FROM scored",
        ordered="SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY f) - 1 AS rk, count(*) OVER (PARTITION BY client_id) AS n FROM tagged",
        wanted="SELECT client_id, i, (n - 1) * i::DOUBLE / 50.0::DOUBLE AS p FROM (SELECT DISTINCT client_id, n FROM ordered), (SELECT unnest(range(1, 50)) AS i)",
        candidates="SELECT w.client_id, i, l.f + (h.f - l.f) * (p - floor(p)) AS t FROM wanted w "
        "JOIN ordered l ON l.client_id = w.client_id AND l.rk = CAST(floor(p) AS BIGINT) "
        "JOIN ordered h ON h.client_id = w.client_id AND h.rk = CAST(ceil(p) AS BIGINT)",
        judged="SELECT c.client_id, i, t, 0.5::DOUBLE * (sum(CASE WHEN y = 1 AND f > t THEN 1 ELSE 0 END)::DOUBLE / sum(y) "
        "+ sum(CASE WHEN y = 0 AND f <= t THEN 1 ELSE 0 END)::DOUBLE / sum(1 - y)) AS balanced FROM candidates c JOIN tagged USING (client_id) GROUP BY c.client_id, i, t",
    ),
)
def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per client, and over all rows as client -1."""
    scored = views.scored_lines(spark, sf_dir)
    # The whole table is one more group of the same histogram.
    grouped = scored.select(F.explode(F.array("client_id", F.lit(-1))).alias("client_id"), "y", "f")
    return m.pick_threshold(grouped, "f", ["client_id"], groups=CLIENTS + 1).select(
        "client_id", F.round("threshold", 9).alias("threshold"), F.round("balanced", 9).alias("balanced")
    )


def _held_out_share(weights: str) -> str:
    return f"SELECT avg(CAST(CAST(t0 * x + t1 * a > 0 AS INT) = y AS INT)::DOUBLE) FROM scaled, {weights} WHERE client_id = 0"


@register(
    "g11_model_agreement",
    o.query(
        f"SELECT {o.rnd('l')} AS accuracy_left, {o.rnd('r')} AS accuracy_right, {o.rnd('abs(l - r)')} AS gap, abs(l - r) <= 0.02::DOUBLE AS agrees "
        f"FROM (SELECT ({_held_out_share('first')}) AS l, ({_held_out_share('second')}) AS r)",
        "lines",
        scaled=SCALED,
        seen="SELECT x, a, y FROM scaled WHERE client_id <> 0",
        **newton("seen", 1e-4, [0.0, 0.0], "first"),
        **newton("seen", 1e-4, FIT_ANCHOR, "second"),
    ),
)
def model_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain fit against the anchored solver, on a client that neither has seen."""
    rows = scaled_lines(spark, sf_dir)
    seen, held_out = rows.filter("client_id <> 0"), rows.filter("client_id = 0")
    first, second = exact_fit(seen, 1e-4, [0.0, 0.0]), exact_fit(seen, 1e-4, FIT_ANCHOR)

    def judged(theta: Sequence[float]) -> DataFrame:
        return held_out.select("y", vectors.predict(vectors.score("x", "a", theta)).alias("pred"))

    return m.agreement(judged(first), judged(second), 0.02).select(
        *[F.round(c, 6).alias(c) for c in ("accuracy_left", "accuracy_right", "gap")], "agrees"
    )


_EXPECTED = [("accuracy", 0.6, 0.1), ("eo_gap", 0.0, 0.02), ("dp_gap", 0.5, 0.02)]


@register(
    "g12_regression_check",
    o.query(
        "SELECT client_id, metric, expected, tolerance, CASE metric "
        + " ".join(f"WHEN '{name}' THEN {o.rnd(o.METRIC[name])}" for name, _, _ in _EXPECTED)
        + " END AS value, abs(CASE metric "
        + " ".join(f"WHEN '{name}' THEN {o.METRIC[name]}" for name, _, _ in _EXPECTED)
        + f" END - expected) <= tolerance AS ok FROM (SELECT client_id, {o.outcome_cells()} FROM predicted GROUP BY client_id), (VALUES "
        + ", ".join(f"('{name}', {o.dbl(value)}, {o.dbl(tol)})" for name, value, tol in _EXPECTED)
        + ") e(metric, expected, tolerance)",
        "predicted",
    ),
)
def regression_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = m.evaluate(m.outcome_counts(views.predicted_lines(spark, sf_dir), ["client_id"]), ["client_id"])
    observed = report.unpivot(["client_id"], [name for name, _, _ in _EXPECTED], "metric", "value")
    expected = spark.range(CLIENTS).select(
        F.col("id").cast("int").alias("client_id"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("metric"), F.lit(v).alias("expected"), F.lit(t).alias("tolerance"))
                    for n, v, t in _EXPECTED
                ]
            )
        ),
    )
    checked = m.within_tolerance(observed, expected, ["client_id"])
    return checked.withColumn("value", F.round("value", 6))


# About how many rows a part of a scattered table holds at most, and the parts of a smaller table.
PART_ROWS = 1_000_000
LEAST_PARTS = 5


def _parts(rows: DataFrame) -> int:
    """To how many parts rows are dealt out, so that parts do not grow with the table."""
    return max(LEAST_PARTS, -(-rows.count() // PART_ROWS))


@register(
    "g13_two_run_equality",
    o.query(
        "SELECT 'same seed' AS runs, 0::BIGINT AS only_left, 0::BIGINT AS only_right UNION ALL "
        "SELECT 'other seed', (SELECT count(*) FROM (SELECT row_id, split FROM first EXCEPT ALL SELECT row_id, split FROM second)), "
        "(SELECT count(*) FROM (SELECT row_id, split FROM second EXCEPT ALL SELECT row_id, split FROM first))",
        "lines",
        **{
            name: f"SELECT row_id, CASE WHEN row_number() OVER (ORDER BY {o.draw('split', 'row_id', seed=seed)}) <= floor(count(*) OVER () * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM lines"
            for name, seed in (("first", SEED), ("second", SEED + 1))
        },
    ),
)
def two_run_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same split on differently partitioned rows, and a split with another seed."""
    rows = views.line_columns(spark, sf_dir).select("row_id")
    parts = _parts(rows)
    # Nearly all rows differ, so what a task counts grows with its rows: all sides come in such parts, whatever the files hold.
    first = split_by_count(rows, "row_id", SEED, 0.2).repartition(parts)
    again = split_by_count(rows.repartition(parts), "row_id", SEED, 0.2)
    other = split_by_count(rows, "row_id", SEED + 1, 0.2).repartition(parts)
    same = m.differing_rows(first, again).withColumn("runs", F.lit("same seed"))
    return same.unionByName(m.differing_rows(first, other).withColumn("runs", F.lit("other seed")))
