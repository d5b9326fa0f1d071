"""Client profiles, minibatch design and stratified sampling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenhand.functions.draws import draw_level, round_digests, round_draws
from evenhand.operators.sizes import small_side

STRATA = ((0, 0), (0, 1), (1, 0), (1, 1))


@dataclass(frozen=True)
class BatchRule:
    """Fixed values of the minibatch design."""

    smallest: int = 32
    largest: int = 128
    positives: int = 8
    group_floor: int = 5


def stratum_name(prefix: str, a: int, y: int) -> str:
    return f"{prefix}_a{a}y{y}"


def per_stratum(value: str) -> Column:
    """Pick the column ``value_a?y?`` that belongs to the row's own ``a`` and ``y``."""
    out = None
    for a, y in STRATA:
        here = (F.col("a") == a) & (F.col("y") == y)
        column = F.col(stratum_name(value, a, y))
        out = F.when(here, column) if out is None else out.when(here, column)
    return out


def _counts(weight: Column, prefix: str) -> list[Column]:
    return [
        F.sum(F.when((F.col("a") == a) & (F.col("y") == y), weight).otherwise(0)).cast("bigint").alias(stratum_name(prefix, a, y))
        for a, y in STRATA
    ]


def _with_rates(profile: DataFrame) -> DataFrame:
    base = F.greatest(F.lit(1), F.col("n"))
    rates = [(F.col(stratum_name("n", a, y)) / base).alias(stratum_name("pi", a, y)) for a, y in STRATA]
    plus = ((F.col("n_a0y1") + F.col("n_a1y1")) / base).alias("pi_plus")
    return profile.select("*", *rates, plus)


def client_profile(df: DataFrame, by: Sequence[str] = ("client_id",)) -> DataFrame:
    """Rows, the four stratum counts, their shares and the positive rate per client."""
    return _with_rates(df.groupBy(*by).agg(F.count("*").alias("n"), *_counts(F.lit(1), "n")))


def batch_quotas(profile: DataFrame, rule: BatchRule = BatchRule()) -> DataFrame:
    """Batch size and the four quotas, from a profile.

    Shares are rounded half to even; each group gets a floor of positives, paid for by its own
    negatives; what is missing or too much goes to (0, 0).
    """
    # No positives: a null rate, and greatest and least skip nulls, so the case is told apart first.
    wanted = F.ceil(F.lit(float(rule.positives)) / F.nullif(F.col("pi_plus"), F.lit(0.0)))
    clipped = F.greatest(F.lit(rule.smallest), F.least(F.lit(rule.largest), wanted))
    size = F.when(F.col("pi_plus") > 0, clipped).otherwise(F.lit(rule.smallest))
    out = profile.withColumn("size", size.cast("bigint"))
    for a, y in STRATA:
        share = F.col(stratum_name("pi", a, y)) * F.col("size")
        out = out.withColumn(stratum_name("q", a, y), F.rint(share).cast("bigint"))
    floor = F.least(F.lit(rule.group_floor), F.col("n_a0y1"), F.col("n_a1y1")).cast("bigint")
    return floor_positives(out.withColumn("_floor", floor), F.col("_floor"), F.col("size")).drop("_floor")


def floor_positives(quotas: DataFrame, floor: Column, target: Column) -> DataFrame:
    """Raise the positives of both groups to the floor, then let (0, 0) absorb the difference."""
    out = quotas
    for a in (0, 1):
        pos, neg = stratum_name("q", a, 1), stratum_name("q", a, 0)
        need = F.greatest(floor - F.col(pos), F.lit(0))
        out = out.withColumns({neg: F.when(need > 0, F.greatest(F.lit(0), F.col(neg) - need)).otherwise(F.col(neg)), pos: F.col(pos) + need})
    total = sum((F.col(stratum_name("q", a, y)) for a, y in STRATA[1:]), F.col("q_a0y0"))
    return out.withColumn("q_a0y0", F.greatest(F.lit(0), F.col("q_a0y0") + target - total).cast("bigint"))


def draw_minibatch(
    df: DataFrame,
    seed: int,
    rounds: int = 1,
    key: str = "row_id",
    rule: BatchRule = BatchRule(),
    clients: int | None = None,
) -> DataFrame:
    """Stratified sample without replacement for every round and client, in one program.

    Adds ``round`` and ``pos`` (1-based place of the row in its stratum); a stratum gives
    ``min(quota, its size)`` rows, those with the smallest draws.

    Only candidates are shuffled: the draws fall into levels of which each holds about a sixteenth of
    the rows of the one before, the counts per level are a small table, and rows below the level that
    is needed to fill the quota are dropped where they are read. A stratum of any size therefore
    sends at most some sixteen quotas' worth of rows to its task.
    """
    drawn = df.withColumns(round_digests(seed, "batch", rounds, key)).select(*df.columns, round_draws(rounds).alias("_draws"))
    # The first pass only carries the stratum of a row and its levels.
    counted = drawn.select("client_id", "a", "y", F.posexplode(F.transform("_draws", draw_level)).alias("round", "_level"))
    group = ["round", "client_id", "a", "y"]
    levels = counted.groupBy(*group, "_level").agg(F.count("*").alias("_n"))
    profile = _with_rates(
        levels.groupBy("round", "client_id").agg(F.sum("_n").alias("n"), *_counts(F.col("_n"), "n"))
    )
    quota_columns = [stratum_name("q", a, y) for a, y in STRATA]
    quotas = batch_quotas(profile, rule).select("round", "client_id", *quota_columns)
    down = Window.partitionBy(*group).orderBy(F.col("_level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    needed = (
        levels.withColumn("_upto", F.sum("_n").over(down))
        .join(quotas, ["round", "client_id"])
        .withColumn("_quota", per_stratum("q"))
        .filter(F.col("_quota") > 0)
        .groupBy(*group)
        .agg(
            F.first("_quota").alias("_quota"),
            F.coalesce(F.max(F.when(F.col("_upto") >= F.col("_quota"), F.col("_level"))), F.lit(0)).alias("_cut"),
        )
    )
    # One row per stratum with its cuts by round: a row of the table meets them once, and only the rounds that it
    # survives become rows.
    stratum = ["client_id", "a", "y"]
    entry = F.struct("round", F.struct("_cut", "_quota").alias("_limits"))
    cuts = needed.groupBy(*stratum).agg(F.map_from_entries(F.collect_list(entry)).alias("_cuts"))
    bound = None if clients is None else clients * len(STRATA)
    met = drawn.join(small_side(cuts, bound), stratum)

    def draw(h: Column, i: Column) -> Column:
        return F.struct(i.alias("round"), h.alias("_h"), F.try_element_at("_cuts", i).alias("_limits"))

    survived = F.filter(F.transform("_draws", draw), lambda d: draw_level(d["_h"]) >= d["_limits"]["_cut"])
    candidates = met.select(*df.columns, F.inline(survived)).select(*df.columns, "round", "_h", F.col("_limits._quota").alias("_quota"))
    order = Window.partitionBy(*group).orderBy("_h", key)
    return (
        candidates.withColumn("pos", F.row_number().over(order).cast("bigint"))
        .filter(F.col("pos") <= F.col("_quota"))
        .drop("_h", "_quota")
    )


def minibatch_stats(batch: DataFrame, by: Sequence[str] = ("round", "client_id")) -> DataFrame:
    """Realised quotas, negatives ``n0``, positives ``n1`` and ``delta = max(0, n0 - n1)``."""
    counts = batch.groupBy(*by).agg(*_counts(F.lit(1), "q"))
    n0, n1 = F.col("q_a0y0") + F.col("q_a1y0"), F.col("q_a0y1") + F.col("q_a1y1")
    return counts.withColumns({"n0": n0, "n1": n1}).withColumn(
        "delta", F.greatest(F.lit(0), F.col("n0") - F.col("n1")).cast("bigint")
    )


def positive_slice(df: DataFrame) -> DataFrame:
    return df.filter(F.col("y") == 1)


def last_positives(
    history: DataFrame,
    order: Sequence[str],
    size: int = 50,
    by: Sequence[str] = ("client_id", "a"),
    salts: int = 32,
) -> DataFrame:
    """The last ``size`` positives per group, in the order of the given (unique) columns.

    The literal limit is applied within salted parts of each group first (where Spark also prunes
    before the shuffle), so the last step sees at most ``salts * size`` rows per group.
    """
    latest = [F.col(c).desc() for c in order]
    salted = positive_slice(history).withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    within = Window.partitionBy(*by, "_salt").orderBy(*latest)
    few = salted.withColumn("_rn", F.row_number().over(within)).filter(F.col("_rn") <= size).drop("_salt", "_rn")
    return (
        few.withColumn("back", F.row_number().over(Window.partitionBy(*by).orderBy(*latest)))
        .filter(F.col("back") <= size)
    )


def fill_missing_positives(batch: DataFrame, buffer: DataFrame) -> DataFrame:
    """Add the buffered positives of every (client, group) that has no positive in the batch.

    Both sides are bounded samples. ``filled`` tells the added rows.
    """
    clients = batch.select("client_id").distinct()
    groups = clients.withColumn("a", F.explode(F.array(F.lit(0), F.lit(1))))
    missing = groups.join(positive_slice(batch).select("client_id", "a").distinct(), ["client_id", "a"], "left_anti")
    added = buffer.join(missing, ["client_id", "a"], "left_semi")
    columns = batch.columns
    return (
        batch.withColumn("filled", F.lit(0))
        .unionByName(added.select(*columns).withColumn("filled", F.lit(1)))
    )


def importance_weights(df: DataFrame, by: Sequence[str] = ("client_id",), cap: float = 10.0) -> DataFrame:
    """Column ``weight``: positives weigh 1 / P(a | y=1) of their client, within 1 and the cap."""
    positives = F.sum(F.when(F.col("y") == 1, 1).otherwise(0))
    group_one = F.sum(F.when((F.col("y") == 1) & (F.col("a") == 1), 1).otherwise(0))
    rates = df.groupBy(*by).agg((group_one / F.nullif(positives, F.lit(0))).alias("_p1"))
    share = F.when(F.col("a") == 1, F.col("_p1")).otherwise(F.lit(1.0) - F.col("_p1"))
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1.0), share))
    raw = F.when(F.col("y") == 1, F.lit(1.0) / clipped).otherwise(F.lit(1.0))
    weight = F.greatest(F.lit(1.0), F.least(F.lit(float(cap)), raw))
    return df.join(rates, list(by)).withColumn("weight", weight).drop("_p1")
