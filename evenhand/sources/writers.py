"""Sinks for runs, tables and client partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evenhand.sources import ledger


RUN_KEYS = ("dataset", "label")


def write_runs(results: DataFrame, folder: str, label: str | Column = "run") -> int:
    """Commit run results as JSON under their dataset and label; a run that is there already is replaced."""
    label = F.lit(label) if isinstance(label, str) else label
    return ledger.commit(results.withColumn("label", label), folder, RUN_KEYS)


def write_table(table: DataFrame, folder: str) -> None:
    """A report table as CSV with a header."""
    table.write.mode("overwrite").option("header", True).csv(folder)


def write_rejected(rejected: DataFrame, folder: str) -> None:
    """The records that a scan set aside (``quarantine``), in place of those of the scan before."""
    rejected.write.mode("overwrite").parquet(folder)


# Rows of a client that one file holds.
FILE_ROWS = 1_000_000


def write_client_files(rows: DataFrame, folder: str, name: str, file_rows: int = FILE_ROWS) -> None:
    """Rows with ``split`` and ``client_id`` as a named set: one directory per split and client.

    A client's rows go to as many files as its size asks for, whatever the number of tasks; a large
    client is dealt out by a hash, so none is gathered.
    """
    sizes = rows.groupBy("split", "client_id").agg(F.ceil(F.count("*") / file_rows).cast("int").alias("_files"))
    dealt = rows.join(sizes, ["split", "client_id"])
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.col("_files"))
    placed = dealt.repartition("split", "client_id", salt).drop("_files")
    placed.write.mode("overwrite").partitionBy("split", "client_id").parquet(f"{folder}/{name}")


def write_final_runs(results: DataFrame, folder: str) -> None:
    """Republish the chosen configuration's runs under final names: ``{dataset}_final_seed{seed}``."""
    label = F.concat(F.col("dataset"), F.lit("_final_seed"), F.col("seed").cast("string"))
    results.withColumn("label", label).write.mode("overwrite").partitionBy("label").json(folder)
