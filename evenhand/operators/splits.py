"""Exact random splits and client partitions, without shuffling the table.

Each of them cuts the rows, in the order of a keyed hash, after given counts. The cut hashes are
found by ``ranks.shuffle_cuts``; a row then only compares its own hash with them. They are found when
the operator is called and written as a small table, so however often a result is read, the ranks
are selected once and a split is a projection.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from evenhand.functions.draws import draw_hash, hex_word
from evenhand.operators.ranks import part_of, shuffle_cuts
from evenhand.operators.sizes import cut_lineage, small_side


def _cut_globally(df: DataFrame, h: Column, counts: Column, cuts: int, output: str) -> DataFrame:
    """Number the parts of the whole table; ``counts`` is an array of so many ``cuts``, of its row count ``total``."""
    cut_hashes = cut_lineage(shuffle_cuts(df, h, counts, bound=cuts).select("cut_hashes")).scalar()
    # A table whose cuts all lie at its end has no cut row at all.
    found = F.coalesce(cut_hashes, F.array().cast("array<string>"))
    return df.withColumn("_cuts", found).withColumn(output, part_of(h, F.col("_cuts"), cuts)).drop("_cuts")


def _cut_by_stratum(df: DataFrame, h: Column, counts: DataFrame, stratum: str, strata: int, cuts: int, output: str) -> DataFrame:
    bound = strata * cuts
    hashes = cut_lineage(shuffle_cuts(df, h, counts, [stratum], bound=bound))
    joined = df.join(small_side(hashes, bound), stratum, "left")
    found = F.coalesce("cut_hashes", F.array().cast("array<string>"))
    return joined.withColumn(output, part_of(h, found, cuts)).drop("cut_hashes")


def split_by_count(
    df: DataFrame,
    key: str,
    seed: int,
    fraction: float,
    names: tuple[str, str] = ("val", "train"),
    at_least: int = 0,
    salt: str = "split",
) -> DataFrame:
    """Column ``split``: the first ``int(n * fraction)`` rows, and the rest."""
    first = F.greatest(F.lit(at_least), F.floor(F.col("total") * F.lit(float(fraction)))).cast("bigint")
    parts = _cut_globally(df, draw_hash(seed, salt, key), F.array(first), 1, "_part")
    return parts.withColumn("split", F.when(F.col("_part") == 0, names[0]).otherwise(names[1])).drop("_part")


def stratified_counts(df: DataFrame, label: str, test_share: float) -> DataFrame:
    """``(label, n, n_train, n_test)``: ``ceil(n * share)`` test rows, spread by largest remainder."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(whole)
    target = (total - F.ceil(total * F.lit(float(test_share)))).cast("bigint")
    shares = sizes.withColumn("_target", target).withColumn(
        "_exact", F.col("n") / F.sum("n").over(whole) * F.col("_target")
    )
    floors = shares.withColumn("_floor", F.floor("_exact").cast("bigint"))
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("_exact") - F.col("_floor")).desc(), F.col(label).asc())
    extra = (F.row_number().over(order) <= F.col("_target") - F.sum("_floor").over(whole)).cast("bigint")
    return floors.withColumn("n_train", F.col("_floor") + extra).select(
        label, "n", "n_train", (F.col("n") - F.col("n_train")).alias("n_test")
    )


def stratified_split(
    df: DataFrame, key: str, seed: int, label: str = "y", test_share: float = 0.2, classes: int = 2
) -> DataFrame:
    """Column ``split`` (train or test) with the class shares kept."""
    cuts = stratified_counts(df, label, test_share).select(label, F.array("n_test").alias("counts"))
    h = draw_hash(seed, "strat", key)
    parts = _cut_by_stratum(df, h, cuts, label, classes, 1, "_part")
    return parts.withColumn("split", F.when(F.col("_part") == 0, "test").otherwise("train")).drop("_part")


def given_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """Two tables that are already split, as one with column ``split``."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def even_counts(rows: Column, parts: int, offset: Column | None = None) -> Column:
    """Where to cut ``rows`` rows into parts that differ by at most one row, larger ones first: an array."""
    start = F.lit(0).cast("bigint") if offset is None else offset
    if parts < 2:
        return F.array().cast("array<bigint>")
    return F.transform(
        F.sequence(F.lit(1).cast("bigint"), F.lit(parts - 1).cast("bigint")),
        lambda k: (start + k * F.floor(rows / parts) + F.least(k, rows % parts)).cast("bigint"),
    )


def partition_iid(df: DataFrame, key: str, seed: int, clients: int, exact: bool = True) -> DataFrame:
    """Column ``client_id``: shuffled parts whose sizes differ by at most one, larger ones first.

    ``exact=False`` takes the draw modulo the number of clients instead: sizes are only equal on
    average, but a row costs the same for any number of clients, and nothing is counted.
    """
    h = draw_hash(seed, "iid", key)
    if not exact:
        return df.withColumn("client_id", F.pmod(hex_word(h), F.lit(clients)).cast("int"))
    return _cut_globally(df, h, even_counts(F.col("total"), clients), clients - 1, "client_id")


def split_and_partition(df: DataFrame, key: str, seed: int, fraction: float, clients: int) -> DataFrame:
    """Columns ``split`` (val, train) and ``client_id`` in one go: the first ``int(n * fraction)`` rows in
    hash order are for validation (no client), the others are cut evenly."""
    held_out = F.floor(F.col("total") * F.lit(float(fraction))).cast("bigint")
    counts = F.concat(F.array(held_out), even_counts(F.col("total") - held_out, clients, held_out))
    parts = _cut_globally(df, draw_hash(seed, "split", key), counts, clients, "_part")
    held = F.col("_part") == 0
    return parts.withColumns(
        {"split": F.when(held, "val").otherwise("train"), "client_id": F.when(~held, F.col("_part") - 1)}
    ).drop("_part")


def client_shares(df: DataFrame, key: str, seed: int, clients: int = 5) -> DataFrame:
    """Column ``client_id`` for rows with ``split``: equal shares of the training rows and of the test rows.

    Both splits are cut by the same clients, so each client has its own training and test set.
    """
    counts = df.groupBy("split").agg(F.count("*").alias("total"))
    counts = counts.select("split", even_counts(F.col("total"), clients).alias("counts"))
    return _cut_by_stratum(df, draw_hash(seed, "share", key), counts, "split", 2, max(1, clients - 1), "client_id")


def dirichlet_shares(classes: Sequence[int], clients: int, alpha: float, seed: int) -> dict[int, list[float]]:
    """Client shares per class, one symmetric Dirichlet draw each (a table of clients x classes)."""
    rng = np.random.default_rng(seed)
    return {int(c): [float(s) for s in rng.dirichlet(np.full(clients, alpha))] for c in classes}


def partition_by_shares(
    df: DataFrame, key: str, seed: int, shares: dict[int, Sequence[float]], label: str = "y"
) -> DataFrame:
    """Column ``client_id``: each class is cut at ``int(cumulative share * class size)``."""
    clients = len(next(iter(shares.values())))
    # Shares are a small table and reach the plan as data, however many clients there are.
    uptos = [(value, [float(u) for u in np.cumsum(own)[:-1]]) for value, own in shares.items()]
    table = df.sparkSession.createDataFrame(uptos, f"{label} {df.schema[label].dataType.simpleString()}, uptos array<double>")
    sizes = df.groupBy(label).agg(F.count("*").alias("total"))
    upto = F.transform("uptos", lambda u: F.floor(u * F.col("total")).cast("bigint"))
    counts = sizes.join(table, label).select(label, upto.alias("counts"))
    return _cut_by_stratum(df, draw_hash(seed, "skew", key), counts, label, len(shares), max(1, clients - 1), "client_id")


def natural_partition(df: DataFrame, column: str) -> DataFrame:
    """Column ``client_id`` from a column that the table already has."""
    return df.withColumn("client_id", F.col(column))


def client_sizes(df: DataFrame, clients: int | None = None) -> DataFrame:
    """``(client_id, n)``; with a number of clients also those that got no row."""
    sizes = df.groupBy("client_id").agg(F.count("*").alias("n"))
    if clients is None:
        return sizes
    expected = df.sparkSession.range(clients).select(F.col("id").cast("int").alias("client_id"))
    return expected.join(sizes, "client_id", "left").select("client_id", F.coalesce("n", F.lit(0)).alias("n"))


def with_enough_rows(df: DataFrame, min_rows: int, clients: int | None = None) -> DataFrame:
    """Rows of the clients that have at least ``min_rows``."""
    kept = client_sizes(df).filter(F.col("n") >= min_rows).select("client_id")
    return df.join(small_side(kept, clients), "client_id", "left_semi")


def starved_clients(df: DataFrame, min_rows: int, clients: int) -> DataFrame:
    """The clients below the minimum, with their row counts."""
    return client_sizes(df, clients).filter(F.col("n") < min_rows)
