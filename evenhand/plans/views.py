"""Labelled views of the given tables, and the literals that the catalogue's queries use.

Every view reads whole tables. Broken inputs (blanks, unreadable text, nulls, infinities) are made
from column values, so that the same expression in SQL makes the same inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenhand.functions.vectors import assemble, predict, score, score_columns

SEED = 7
CLIENTS = 5
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WIDTH = len(LINE_FEATURES)

# Weights of a fixed scorer over [quantity, price, discount, tax; a], raw and standardised inputs.
THETA = [0.02, -0.00001, 3.0, -2.0, 0.1]
THETA_SCALED = [0.3, -0.2, 0.15, -0.1, 0.25]
ANCHOR = [0.01, 0.0, 1.0, -1.0, 0.0]

# A sweep of fixed scorers that plays the part of training runs: ten configurations, whose runs are
# (client as dataset, line number as seed).
RHOS = [0.01, 0.05, 0.1, 0.5, 1.0]
SWEEP = [
    (
        off,
        rho,
        [
            round(0.02 + 0.003 * i, 6),
            -0.00001,
            round(3.0 - 0.4 * i, 6),
            round(-2.0 + 0.3 * i, 6),
            round(0.1 * (i % 4) - 0.1, 6),
        ],
    )
    for i, (off, rho) in enumerate((off, rho) for off in (False, True) for rho in RHOS)
]
SEEDS = [1, 2, 3, 4, 5, 6, 7]
# Scorers that play baseline and fair model.
MODELS = {"baseline": [0.02, -0.00001, 3.0, -2.0, 0.4], "pipeline": [0.025, -0.000012, 2.0, -1.0, 0.05]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_key() -> Column:
    return F.concat_ws(
        ":",
        F.col("l_orderkey").cast("string"),
        F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"),
        F.col("l_quantity").cast("int").cast("string"),
        F.col("l_shipdate").cast("date").cast("string"),
    )


def line_columns(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Line items with key, client, group and label beside their named features."""
    return table(spark, sf_dir, "lineitem").select(
        line_key().alias("row_id"),
        F.pmod("l_suppkey", F.lit(CLIENTS)).cast("int").alias("client_id"),
        (F.col("l_linestatus") == "F").cast("int").alias("a"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        *LINE_FEATURES,
        *extra,
    )


def labelled_lines(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return line_columns(spark, sf_dir, *extra).withColumn("x", assemble(LINE_FEATURES)).drop(*LINE_FEATURES)


def scored_lines(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return line_columns(spark, sf_dir, *extra).withColumn("f", score_columns(LINE_FEATURES, "a", THETA))


def predicted_lines(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return scored_lines(spark, sf_dir, *extra).withColumn("pred", predict(F.col("f")))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged documents: sparse cells, because bad (y) toxic (a) documents are few."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("row_id"),
        F.col("source").alias("client_id"),
        F.col("toxic").cast("int").alias("a"),
        (F.lit(1) - F.col("quality")).cast("int").alias("y"),
        F.array(F.col("n_chars").cast("double"), F.size(F.split("text", " ", -1)).cast("double")).alias("x"),
    )


def sweep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items scored by all ten configurations."""
    configs = F.array(
        *[
            F.struct(
                F.lit(off).alias("universum_off"),
                F.lit(rho).alias("rho"),
                F.array(*[F.lit(t) for t in theta]).alias("theta"),
            )
            for off, rho, theta in SWEEP
        ]
    )
    rows = labelled_lines(spark, sf_dir, "l_linenumber", "l_orderkey")
    return (
        rows.withColumn("_c", F.explode(configs))
        .select(
            F.concat(F.lit("client"), F.col("client_id").cast("string")).alias("dataset"),
            F.col("_c.universum_off").alias("universum_off"),
            F.col("_c.rho").alias("rho"),
            F.col("l_linenumber").alias("seed"),
            F.when(F.pmod("l_orderkey", F.lit(2)) == 0, "val").otherwise("test").alias("part"),
            "a",
            "y",
            predict(score("x", "a", F.col("_c.theta"), WIDTH)).alias("pred"),
        )
    )


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items scored by the two models."""
    models = F.array(
        *[F.struct(F.lit(m).alias("model"), F.array(*[F.lit(t) for t in theta]).alias("theta")) for m, theta in MODELS.items()]
    )
    rows = labelled_lines(spark, sf_dir, "l_linenumber")
    scored = rows.withColumn("_m", F.explode(models)).withColumn(
        "f", score("x", "a", F.col("_m.theta"), WIDTH)
    )
    return scored.select(
        F.concat(F.lit("client"), F.col("client_id").cast("string")).alias("dataset"),
        F.col("_m.model").alias("model"),
        F.col("l_linenumber").alias("seed"),
        "a",
        "y",
        "f",
        predict(F.col("f")).alias("pred"),
    )

