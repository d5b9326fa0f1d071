"""Queries for splits, client partitions and stratified sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from evenhand.functions.vectors import spread
from evenhand.operators import sampling as s, splits, synthesis
from evenhand.operators.sizes import cut_lineage
from evenhand.plans import oracle as o, views
from evenhand.plans.catalog import register
from evenhand.plans.views import CLIENTS, SEED, WIDTH, table

ROUNDS = 2
PI_DIGITS = 9


def batch_of(spark: SparkSession, sf_dir: str, rounds: int = ROUNDS) -> DataFrame:
    return s.draw_minibatch(views.labelled_lines(spark, sf_dir), SEED, rounds, clients=CLIENTS)


def _ranked(salt: str, partition: str = "") -> str:
    over = f"{partition} ORDER BY {o.draw(salt, 'row_id')}"
    total = f"count(*) OVER ({partition})"
    return f"SELECT *, row_number() OVER ({over}) - 1 AS rk, {total} AS n FROM lines"


@register(
    "d1_split_by_count",
    o.query(
        "SELECT row_id, CASE WHEN rk < CAST(floor(n * 0.2::DOUBLE) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM ranked",
        "lines",
        ranked=_ranked("split"),
    ),
)
def split_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.line_columns(spark, sf_dir).select("row_id")
    return splits.split_by_count(rows, "row_id", SEED, 0.2)


@register(
    "d2_stratified_split",
    o.query(
        "SELECT row_id, y, CASE WHEN rk < c.n - n_train THEN 'test' ELSE 'train' END AS split FROM ranked r JOIN counts c USING (y)",
        "lines",
        ranked=_ranked("strat", "PARTITION BY y"),
        shares="SELECT *, n::DOUBLE / total * target AS exact, CAST(floor(n::DOUBLE / total * target) AS BIGINT) AS low FROM "
        "(SELECT y, n, total, total - CAST(ceil(total * 0.2::DOUBLE) AS BIGINT) AS target FROM "
        "(SELECT y, count(*) AS n, (SELECT count(*) FROM lines) AS total FROM lines GROUP BY y))",
        counts="SELECT y, n, low + CAST(row_number() OVER (ORDER BY exact - low DESC, y) <= target - sum(low) OVER () AS BIGINT) AS n_train FROM shares",
    ),
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.line_columns(spark, sf_dir).select("row_id", "y")
    return splits.stratified_split(rows, "row_id", SEED)


@register(
    "a8_client_layout",
    o.query(
        "SELECT split, CAST(CASE WHEN rk < (n % c) * (n // c + 1) THEN rk // (n // c + 1) ELSE (rk - n % c) // (n // c) END AS INT) AS client_id, count(*) AS n FROM ranked GROUP BY ALL",
        "lines",
        ranked=f"SELECT split, {CLIENTS} AS c, row_number() OVER (PARTITION BY split ORDER BY {o.draw('share', 'row_id')}) - 1 AS rk, count(*) OVER (PARTITION BY split) AS n "
        "FROM (SELECT row_id, CASE WHEN l_linenumber = 1 THEN 'test' ELSE 'train' END AS split FROM lines)",
    ),
)
def client_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per client and split of five equal shares."""
    rows = views.line_columns(spark, sf_dir, "l_linenumber").select("row_id", F.when(F.col("l_linenumber") == 1, "test").otherwise("train").alias("split"))
    return splits.client_shares(rows, "row_id", SEED, CLIENTS).groupBy("split", "client_id").agg(F.count("*").alias("n"))


@register(
    "d3_given_split",
    "SELECT o_orderkey, o_totalprice, 'train' AS split FROM orders WHERE o_orderstatus = 'F' "
    "UNION ALL SELECT o_orderkey, o_totalprice, 'test' AS split FROM orders WHERE o_orderstatus <> 'F'",
)
def given_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    columns = ["o_orderkey", "o_totalprice"]
    return splits.given_split(
        orders.filter("o_orderstatus = 'F'").select(*columns), orders.filter("o_orderstatus <> 'F'").select(*columns)
    )


@register(
    "d4_iid_clients",
    o.query(
        # Rows before client k: k times the small size, plus one for each of the first n % K clients.
        "SELECT row_id, CAST(("
        + " + ".join(f"CAST(rk >= {k} * (n // {CLIENTS}) + least({k}, n % {CLIENTS}) AS INT)" for k in range(1, CLIENTS))
        + ") AS INT) AS client_id FROM ranked",
        "lines",
        ranked=_ranked("iid"),
    ),
)
def iid_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.line_columns(spark, sf_dir).select("row_id")
    return splits.partition_iid(rows, "row_id", SEED, CLIENTS)


SHARES = splits.dirichlet_shares([0, 1], CLIENTS, 0.5, SEED)
# One client gets next to nothing of either class.
STARVING = {0: [0.4, 0.3, 0.2, 0.0999, 0.0001], 1: [0.1, 0.2, 0.3, 0.4, 0.0]}


def _skewed(shares: dict[int, list[float]]) -> str:
    cuts = {
        y: [f"floor({o.dbl(u)} * n)" for u in np.cumsum(class_shares)[:-1]] for y, class_shares in shares.items()
    }
    part = {y: " + ".join(f"CAST(rk >= {c} AS INT)" for c in found) for y, found in cuts.items()}
    return f"SELECT row_id, y, CAST(CASE y WHEN 0 THEN {part[0]} ELSE {part[1]} END AS INT) AS client_id FROM ranked"


@register(
    "d5_skewed_clients",
    o.query(_skewed(SHARES), "lines", ranked=_ranked("skew", "PARTITION BY y")),
)
def skewed_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.line_columns(spark, sf_dir).select("row_id", "y")
    return splits.partition_by_shares(rows, "row_id", SEED, SHARES)


@register(
    "d6_min_rows",
    o.query(
        "SELECT k AS client_id, CAST(count(p.row_id) AS BIGINT) AS n, CASE WHEN count(p.row_id) >= 50 THEN 'kept' ELSE 'starved' END AS state "
        f"FROM (SELECT CAST(unnest(range({CLIENTS})) AS INT) AS k) LEFT JOIN parted p ON p.client_id = k GROUP BY k",
        "lines",
        ranked=_ranked("skew", "PARTITION BY y"),
        parted=_skewed(STARVING),
    ),
)
def min_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.line_columns(spark, sf_dir).select("row_id", "y")
    parted = splits.partition_by_shares(rows, "row_id", SEED, STARVING)
    kept = splits.client_sizes(splits.with_enough_rows(parted, 50, CLIENTS)).withColumn("state", F.lit("kept"))
    return kept.unionByName(splits.starved_clients(parted, 50, CLIENTS).withColumn("state", F.lit("starved")))


@register(
    "d7_natural_clients",
    "SELECT source AS client_id, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source",
)
def natural_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = splits.natural_partition(table(spark, sf_dir, "documents"), "source")
    return documents.groupBy("client_id").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


_PROFILE_COLUMNS = [f"n_a{a}y{y}" for a, y in s.STRATA]
_PI_COLUMNS = [f"pi_a{a}y{y}" for a, y in s.STRATA] + ["pi_plus"]


def _profile_select(source: str) -> str:
    return (
        f"SELECT client_id, n, {', '.join(_PROFILE_COLUMNS)}, "
        + ", ".join(f"{o.rnd(c, PI_DIGITS)} AS {c}" for c in _PI_COLUMNS)
        + f" FROM {source}"
    )


@register("d8_client_profile", o.query(_profile_select("profile"), "profile"))
def client_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = s.client_profile(views.labelled_lines(spark, sf_dir))
    return profile.select(
        "client_id", "n", *_PROFILE_COLUMNS, *[F.round(c, PI_DIGITS).alias(c) for c in _PI_COLUMNS]
    )


_QUOTAS = [f"q_a{a}y{y}" for a, y in s.STRATA]


@register(
    "d9_batch_quotas",
    o.query(
        f"SELECT client_id, size, {', '.join(_QUOTAS)} FROM q UNION ALL SELECT CAST(client_id AS VARCHAR), size, {', '.join(_QUOTAS)} FROM quotas",
        "docs",
        "quotas",
        p=o.profile_body("docs", "client_id"),
        q=o.quota_body("p", "client_id"),
    ),
)
def batch_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(rows: DataFrame) -> DataFrame:
        return s.batch_quotas(s.client_profile(rows)).select(F.col("client_id").cast("string").alias("client_id"), "size", *_QUOTAS)

    return of(views.labelled_documents(spark, sf_dir)).unionByName(of(views.labelled_lines(spark, sf_dir)))


@register("d10_stratified_sample", o.query("SELECT round, client_id, a, y, row_id, pos FROM batch", "batch"))
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_of(spark, sf_dir).select("round", "client_id", "a", "y", "row_id", "pos")


_STATS = [*_QUOTAS, "n0", "n1", "delta"]


@register(
    "d11_batch_stats",
    o.query(f"SELECT round, client_id, {', '.join(f'{o.big(c)} AS {c}' for c in _STATS)} FROM stats", "stats"),
)
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.minibatch_stats(batch_of(spark, sf_dir)).select("round", "client_id", *_STATS)


@register(
    "d12_positive_slice",
    o.query(
        "SELECT round, client_id, a, row_id, " + ", ".join(f"x[{i + 1}] AS x{i}" for i in range(WIDTH)) + " FROM batch WHERE y = 1",
        "batch",
    ),
)
def positive_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.positive_slice(batch_of(spark, sf_dir)).select("round", "client_id", "a", "row_id", *spread("x", WIDTH))


@register(
    "d13_last_positives",
    o.query(
        "SELECT client_id, a, row_id, CAST(back AS INT) AS back FROM (SELECT *, row_number() OVER (PARTITION BY client_id, a ORDER BY l_shipdate DESC, row_id DESC) AS back FROM lines WHERE y = 1) WHERE back <= 50",
        "lines",
    ),
)
def last_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = views.line_columns(spark, sf_dir, "l_shipdate").select("client_id", "a", "y", "row_id", "l_shipdate")
    return s.last_positives(history, ["l_shipdate", "row_id"]).select("client_id", "a", "row_id", "back")


@register(
    "d14_fill_groups",
    o.query(
        "SELECT client_id, a, y, row_id, 0 AS filled FROM doc_batch "
        "UNION ALL SELECT client_id, a, y, row_id, 1 AS filled FROM buffer JOIN missing USING (client_id, a)",
        "docs",
        p=o.profile_body("docs", "client_id"),
        q=o.quota_body("p", "client_id", group_floor=0),
        doc_batch=o.batch_body("docs", "q", 1),
        buffer="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, a ORDER BY row_id DESC) AS back FROM docs WHERE y = 1) WHERE back <= 50",
        missing="SELECT client_id, g.a FROM (SELECT DISTINCT client_id FROM doc_batch) c, (VALUES (0), (1)) g(a) EXCEPT SELECT client_id, a FROM doc_batch WHERE y = 1",
    ),
)
def fill_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a floor of positives some batches lack a group, which the rows seen before then fill."""
    documents = views.labelled_documents(spark, sf_dir)
    batch = s.draw_minibatch(documents, SEED, rule=s.BatchRule(group_floor=0)).select("client_id", "a", "y", "row_id")
    buffer = s.last_positives(documents, ["row_id"]).select("client_id", "a", "y", "row_id")
    return s.fill_missing_positives(batch, buffer)


@register(
    "d15_importance_weights",
    o.query(
        f"SELECT round, client_id, pt_id, a, y, {o.rnd('greatest(1.0::DOUBLE, least(10.0::DOUBLE, w))', 9)} AS weight FROM ("
        "SELECT *, CASE WHEN y = 1 THEN 1.0::DOUBLE / greatest(1e-6::DOUBLE, least(1.0::DOUBLE, CASE WHEN a = 1 THEN p1 ELSE 1.0::DOUBLE - p1 END)) ELSE 1.0::DOUBLE END AS w FROM "
        "(SELECT DISTINCT round, client_id, pt_id, a, y FROM syn) JOIN "
        "(SELECT round, client_id, sum(CASE WHEN y = 1 AND a = 1 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(y), 0) AS p1 FROM syn GROUP BY ALL) USING (round, client_id))",
        "syn",
    ),
)
def importance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = cut_lineage(batch_of(spark, sf_dir))
    quotas = synthesis.synthetic_quotas(s.minibatch_stats(batch))
    rows = synthesis.synthetic_rows(quotas, synthesis.stratum_moments(batch), SEED)
    weighted = s.importance_weights(rows, ["round", "client_id"])
    return weighted.select("round", "client_id", "pt_id", "a", "y", F.round("weight", 9).alias("weight"))
