"""Accuracy, ranking and group-fairness metrics.

All threshold metrics come from eight counts (a, y, prediction), so one map-side combined
aggregate serves them whatever the grouping.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenhand.functions.values import ratio
from evenhand.operators.ranks import exact_quantiles
from evenhand.operators.sizes import cut_lineage, small_side

# Number of threshold candidates: the quantiles 1/50, 2/50, ... 49/50 of the score.
CANDIDATES = 49


def _cell(a: int, y: int, p: int) -> str:
    return f"c_a{a}y{y}p{p}"


def outcome_counts(df: DataFrame, by: Sequence[str] = (), prediction: str = "pred") -> DataFrame:
    """``(by..., c_a?y?p?)``: rows per group, label and prediction."""
    cells = [
        F.sum(F.when((F.col("a") == a) & (F.col("y") == y) & (F.col(prediction) == p), 1).otherwise(0))
        .cast("bigint")
        .alias(_cell(a, y, p))
        for a in (0, 1)
        for y in (0, 1)
        for p in (0, 1)
    ]
    return df.groupBy(*by).agg(*cells)


def _total(groups: Sequence[int] = (0, 1), labels: Sequence[int] = (0, 1), predictions: Sequence[int] = (0, 1)) -> Column:
    cells = [F.col(_cell(a, y, p)) for a in groups for y in labels for p in predictions]
    return reduce(lambda left, right: left + right, cells)


def true_positives() -> Column:
    return _total(labels=(1,), predictions=(1,))


def false_positives() -> Column:
    return _total(labels=(0,), predictions=(1,))


def true_negatives() -> Column:
    return _total(labels=(0,), predictions=(0,))


def false_negatives() -> Column:
    return _total(labels=(1,), predictions=(0,))


def accuracy() -> Column:
    return ratio(true_positives() + true_negatives(), _total())


def precision() -> Column:
    return ratio(true_positives(), true_positives() + false_positives())


def recall() -> Column:
    return ratio(true_positives(), true_positives() + false_negatives())


def f1() -> Column:
    return ratio(F.lit(2.0) * precision() * recall(), precision() + recall())


def group_rate(a: int, labels: Sequence[int]) -> Column:
    """Share of positive predictions among the rows of a group that have one of the labels."""
    return ratio(_total((a,), labels, (1,)), _total((a,), labels))


def group_gap(labels: Sequence[int]) -> Column:
    return F.abs(group_rate(1, labels) - group_rate(0, labels))


def eo_gap() -> Column:
    """Difference of the true-positive rates; a group without positives has rate 0."""
    return group_gap((1,))


def dp_gap() -> Column:
    return group_gap((0, 1))


def eod_gap() -> Column:
    """The larger of the rate differences among negatives and among positives."""
    return F.greatest(group_gap((0,)), group_gap((1,)))


def macro_f1() -> Column:
    """Mean F1 over the classes that occur as a label or as a prediction."""
    tp, fp, tn, fn = true_positives(), false_positives(), true_negatives(), false_negatives()
    one = ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn)
    zero = ratio(F.lit(2.0) * tn, F.lit(2.0) * tn + fp + fn)
    classes = F.when(tp + fp + fn > 0, 1).otherwise(0) + F.when(tn + fp + fn > 0, 1).otherwise(0)
    return ratio(one + zero, classes)


def balanced_accuracy() -> Column:
    """Mean recall over the classes that occur as a label."""
    positives, negatives = _total(labels=(1,)), _total(labels=(0,))
    classes = F.when(positives > 0, 1).otherwise(0) + F.when(negatives > 0, 1).otherwise(0)
    return ratio(recall() + ratio(true_negatives(), negatives), classes)


def evaluate(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every threshold metric from the counts."""
    return counts.select(
        *by,
        _total().alias("n"),
        accuracy().alias("accuracy"),
        precision().alias("precision"),
        recall().alias("recall"),
        f1().alias("f1"),
        group_rate(0, (1,)).alias("tpr0"),
        group_rate(1, (1,)).alias("tpr1"),
        eo_gap().alias("eo_gap"),
        dp_gap().alias("dp_gap"),
        eod_gap().alias("eod_gap"),
        macro_f1().alias("macro_f1"),
        balanced_accuracy().alias("balanced_accuracy"),
    )


def ranking_metrics(
    df: DataFrame,
    score: str = "f",
    by: Sequence[str] = (),
) -> DataFrame:
    """``(by..., roc_auc, pr_auc)``, exact, ties grouped; 0 where a class is missing.

    Rows are first counted per distinct score. The scores are range-partitioned, which takes its borders
    from the data, and written with their range; cumulative counts then run inside ranges, on top of the
    totals of the ranges before, so no score, group or crowd of scores meets one task.
    """
    by = list(by)
    counted = df.groupBy(*by, F.col(score).alias("_f")).agg(
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("_p"),
        F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("_n"),
    )
    counted = cut_lineage(counted.repartitionByRange(*by, "_f").withColumn("_bucket", F.spark_partition_id()))
    totals = counted.groupBy(*by, "_bucket").agg(F.sum("_p").alias("_bp"), F.sum("_n").alias("_bn"))
    keys = by if by else [F.lit(0)]
    higher = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    starts = totals.select(
        *by,
        "_bucket",
        F.coalesce(F.sum("_bp").over(higher), F.lit(0)).alias("_p_above"),
        F.coalesce(F.sum("_bn").over(higher), F.lit(0)).alias("_n_above"),
        F.sum("_bp").over(whole).alias("_all_p"),
        F.sum("_bn").over(whole).alias("_all_n"),
    )
    down = (
        Window.partitionBy(*by, "_bucket").orderBy(F.col("_f").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        counted.withColumns({"_tp_in": F.sum("_p").over(down), "_fp_in": F.sum("_n").over(down)})
        .join(starts, [*by, "_bucket"])
        .withColumns({"_tp": F.col("_p_above") + F.col("_tp_in"), "_fp": F.col("_n_above") + F.col("_fp_in")})
    )
    # A positive beats the negatives below its score and half of those at its score.
    beaten = F.col("_p") * (F.col("_all_n") - F.col("_fp") + F.col("_n") * F.lit(0.5))
    step = F.col("_p") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))
    sums = placed.groupBy(*by).agg(
        F.sum(beaten).alias("_beaten"),
        F.sum(step).alias("_steps"),
        F.max("_all_p").alias("_all_p"),
        F.max("_all_n").alias("_all_n"),
    )
    both = (F.col("_all_p") > 0) & (F.col("_all_n") > 0)
    return sums.select(
        *by,
        F.when(both, ratio(F.col("_beaten"), F.col("_all_p") * F.col("_all_n"))).otherwise(F.lit(0.0)).alias("roc_auc"),
        F.when(both, ratio(F.col("_steps"), F.col("_all_p"))).otherwise(F.lit(0.0)).alias("pr_auc"),
    )


def two_predictions(df: DataFrame, by: Sequence[str], first: str, second: str) -> DataFrame:
    """``(by..., which, c_a?y?p?)``: the counts of two prediction columns from one pass."""
    both = df.select(
        *by, "a", "y",
        F.explode(
            F.array(
                F.struct(F.lit(first).alias("which"), F.col(first).alias("pred")),
                F.struct(F.lit(second).alias("which"), F.col(second).alias("pred")),
            )
        ).alias("_p"),
    ).select(*by, "a", "y", "_p.which", "_p.pred")
    return outcome_counts(both, [*by, "which"])


def pick_threshold(df: DataFrame, score: str = "f", by: Sequence[str] = (), groups: int | None = 1) -> DataFrame:
    """``(by..., threshold, balanced)``: the score quantile with the best mean of TPR and TNR.

    The lowest one wins a tie; 0 where a class is missing. Each row is counted once, by the number of
    candidates below its score, instead of once per candidate.
    """
    by = list(by)
    candidates = cut_lineage(exact_quantiles(df, score, range(1, CANDIDATES + 1), CANDIDATES + 1, by, groups))
    if by:
        met = df.join(small_side(candidates, groups), by)
    else:
        met = df.withColumn("quantiles", candidates.select("quantiles").scalar())
    # The candidates ascend. Halving steps as projections stay in generated code; a function over the array would be interpreted for every row.
    met = met.withColumn("_k", F.lit(0))
    for step in (1 << k for k in reversed(range(CANDIDATES.bit_length()))):
        met = met.withColumn("_k", F.col("_k") + F.when(F.get("quantiles", F.col("_k") + (step - 1)) < F.col(score), step).otherwise(0))
    counted = met.groupBy(*by, "_k").agg(
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("_p"),
        F.sum(F.when(F.col("y") == 1, 0).otherwise(1)).alias("_n"),
    )
    # A row that is above k candidates is predicted positive by the first k of them.
    cells = counted.groupBy(*by).agg(
        F.sum("_p").alias("_all_p"),
        F.sum("_n").alias("_all_n"),
        F.collect_list(F.struct("_k", "_p", "_n")).alias("_cells"),
    )
    # The candidates join again, as an array among the sums would have every row sorted.
    cells = cells.join(small_side(candidates, groups), by) if by else cells.withColumn("quantiles", candidates.select("quantiles").scalar())

    def above(i: Column, field: str) -> Column:
        return F.aggregate("_cells", F.lit(0).cast("bigint"), lambda s, c: s + F.when(c["_k"] > i, c[field]).otherwise(0))

    candidates_row = F.transform(
        F.sequence(F.lit(0), F.lit(CANDIDATES - 1)),
        lambda i: F.struct(
            (
                F.lit(0.5)
                * (above(i, "_p") / F.col("_all_p") + (F.col("_all_n") - above(i, "_n")) / F.col("_all_n"))
            ).alias("balanced"),
            (-i).alias("first"),
        ),
    )
    both = (F.col("_all_p") > 0) & (F.col("_all_n") > 0)
    best = cells.withColumn("_best", F.when(both, F.array_max(candidates_row)))
    return best.select(
        *by,
        F.when(both, F.element_at("quantiles", 1 - F.col("_best.first"))).otherwise(F.lit(0.0)).alias("threshold"),
        F.coalesce(F.col("_best.balanced"), F.lit(0.0)).alias("balanced"),
    )


def agreement(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """Compare the accuracies of two scored tables (columns ``y`` and ``pred``), in one aggregate."""
    hit = (F.col("pred") == F.col("y")).cast("double").alias("hit")
    both = left.select(F.lit("left").alias("side"), hit).unionByName(right.select(F.lit("right").alias("side"), hit))
    sides = {side: F.avg(F.when(F.col("side") == side, F.col("hit"))) for side in ("left", "right")}
    shares = both.agg(sides["left"].alias("accuracy_left"), sides["right"].alias("accuracy_right"))
    gap = F.abs(F.col("accuracy_left") - F.col("accuracy_right"))
    return shares.withColumn("gap", gap).withColumn("agrees", F.col("gap") <= F.lit(float(tolerance)))


def within_tolerance(observed: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join ``(keys..., metric, value)`` with ``(keys..., metric, expected, tolerance)`` and compare."""
    joined = expected.join(observed, [*keys, "metric"], "left")
    return joined.withColumn(
        "ok", F.coalesce(F.abs(F.col("value") - F.col("expected")) <= F.col("tolerance"), F.lit(False))
    )


def raises_gap(full: DataFrame, ablated: DataFrame, keys: Sequence[str], gap: str = "eo_gap") -> DataFrame:
    """Whether leaving a part out widens the gap: ``(keys..., full_gap, ablated_gap, ok)``, runs that both have."""
    pairs = full.select(*keys, F.col(gap).alias("full_gap")).join(ablated.select(*keys, F.col(gap).alias("ablated_gap")), list(keys))
    return pairs.withColumn("ok", F.col("ablated_gap") > F.col("full_gap"))


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(only_left, only_right)``: rows that the other side lacks, with multiplicity."""
    tagged = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(-1)))
    columns = left.columns
    balance = tagged.groupBy(*columns).agg(F.sum("_side").alias("_d"))
    return balance.agg(
        F.coalesce(F.sum(F.greatest(F.col("_d"), F.lit(0))), F.lit(0)).cast("bigint").alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).cast("bigint").alias("only_right"),
    )
