"""Scores of predictions, and the rules that compare experiments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_RANGE = 1_000_000


def classification_metrics(
    df: DataFrame, label: str, prediction: str, groups: Sequence[str] = ()
) -> DataFrame:
    """Accuracy and macro F1 per group.

    The rows are reduced to a confusion table at once. The macro average runs over
    the classes that occur as label or as prediction; an undefined F1 counts as 0.
    """
    confusion = df.groupBy(
        *groups, F.col(label).alias("actual"), F.col(prediction).alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    hit = F.when(F.col("actual").eqNullSafe(F.col("predicted")), n).otherwise(0)
    sides = confusion.select(
        *groups,
        F.inline(
            F.array(
                F.struct(F.col("actual").alias("cls"), hit.alias("hits"), n.alias("uses"), n.alias("rows")),
                F.struct(F.col("predicted").alias("cls"), F.lit(0).alias("hits"), n.alias("uses"), F.lit(0).alias("rows")),
            )
        ),
    )
    per_class = sides.groupBy(*groups, "cls").agg(
        F.sum("hits").alias("hits"), F.sum("uses").alias("uses"), F.sum("rows").alias("rows")
    )
    return per_class.groupBy(*groups).agg(
        F.sum("rows").alias("row_count"),
        F.round(F.try_divide(F.sum("hits"), F.sum("rows")), 6).alias("accuracy"),
        F.round(F.avg(2 * F.col("hits") / F.col("uses")), 6).alias("f1_macro"),
    )


def regression_metrics(
    df: DataFrame, label: str, prediction: str, groups: Sequence[str] = ()
) -> DataFrame:
    """MAE, RMSE and R2 per group. A constant target scores 1 if met, else 0."""
    y = F.col(label).cast("double")
    error = y - F.col(prediction)
    squares = F.sum(error * error)
    spread = F.count(y) * F.var_pop(y)
    r2 = F.when(spread > 0, 1 - squares / F.nullif(spread, F.lit(0.0))).otherwise(
        F.when(squares == 0, 1.0).otherwise(0.0)
    )
    return df.groupBy(*groups).agg(
        F.count(y).alias("row_count"),
        F.round(F.avg(F.abs(error)), 6).alias("mae"),
        F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"),
        F.round(F.when(F.count(y) > 1, r2), 6).alias("r2"),
    )


def roc_auc(
    df: DataFrame,
    score: str,
    is_positive: str,
    groups: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Area under the ROC curve per group; tied scores count half.

    The area is a rank statistic, and ranking by score is a running sum over all
    rows. Rows are first merged per distinct score. Score ranges of about
    `rows_per_range` rows then get their totals summed up, and only inside a range
    are scores put in order, so no task sees more than its range of a group. The driver
    holds one bound per range. Rows whose score is null or NaN are left out.
    """
    scored = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    merged = scored.groupBy(*groups, score).agg(
        F.count_if(F.col(is_positive)).alias("pos"), F.count_if(~F.col(is_positive)).alias("neg")
    )
    return _areas(merged, score, groups, _range_bounds(scored, score, rows_per_range))


def _range_bounds(scored: DataFrame, score: str, rows_per_range: int) -> list[float] | None:
    """Bounds between score ranges of about rows_per_range rows; None if one range will do."""
    ranges = math.ceil(scored.count() / rows_per_range)
    if ranges <= 1:
        return None
    cuts = [i / ranges for i in range(1, ranges)]
    found = scored.agg(F.percentile_approx(score, cuts, max(1000, 4 * ranges))).first()[0]
    return [-math.inf, *sorted(set(found)), math.inf]


#: Up to so many ranges of all groups their offsets, a short row each, are broadcast.
BROADCAST_RANGES = 100_000


def _areas(
    merged: DataFrame, score: str, groups: Sequence[str], bounds: list[float] | None, most_groups: int | None = None
) -> DataFrame:
    """Areas per group from (group, score, pos, neg), one row per distinct score.

    If there are at most most_groups groups and few ranges, the scores aren't moved to meet
    the totals of their ranges.
    """
    if bounds is None:
        placed = merged.withColumn("range", F.lit(0.0))
    else:
        placed = Bucketizer(splits=bounds, inputCol=score, outputCol="range").transform(merged)
    totals = placed.groupBy(*groups, "range").agg(F.sum("neg").alias("range_neg"))
    # One row per range.
    earlier = W.partitionBy(*groups, F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, "range", F.coalesce(F.sum("range_neg").over(earlier), F.lit(0)).alias("offset")
    )
    if bounds is not None and most_groups is not None and most_groups * len(bounds) <= BROADCAST_RANGES:
        offsets = F.broadcast(offsets)
    joined = placed.withColumn("offset", F.lit(0)) if bounds is None else _joined(placed, offsets, [*groups, "range"])
    inside = W.partitionBy(*groups, "range").orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    lower = F.col("offset") + F.coalesce(F.sum("neg").over(inside), F.lit(0))
    ranked = joined.withColumn("wins", F.col("pos") * (lower + F.col("neg") / 2.0))
    return ranked.groupBy(*groups).agg(
        F.round(
            F.try_divide(F.sum("wins"), F.sum("pos").cast("double") * F.sum("neg").cast("double")), 6
        ).alias("roc_auc")
    )


def multiclass_roc_auc(
    df: DataFrame, label: str, scores: str, classes: int, groups: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Macro average of the one-against-rest areas; null if a class has no row.

    `scores` is an array with one score per class, `label` the class number. Only scores that
    are not zero are listed and ranked; the zeros of a class are the rest of its rows, which
    are counted. Rows without a label and scores that are null or NaN are left out.
    """
    rows = df.where(F.col(label).isNotNull())
    known = rows.select(*groups, F.col(label).cast("int").alias("actual"), F.transform(scores, lambda s, i: F.struct(i.alias("cls"), s.cast("double").alias("score"))).alias("all"))
    absent = lambda s: s.isNull() | F.isnan(s)
    listed = F.filter("all", lambda e: absent(e["score"]) | (e["score"] != 0))
    entries = known.select(*groups, "actual", F.explode(listed).alias("entry")).select(
        *groups, (F.col("actual") == F.col("entry.cls")).alias("is_cls"), "entry.cls",
        F.when(~absent(F.col("entry.score")), F.col("entry.score")).alias("score"),
    )
    merged = entries.groupBy(*groups, "cls", "score").agg(
        F.count_if("is_cls").alias("pos"), F.count_if(~F.col("is_cls")).alias("neg")
    )
    # Rows per group and class, and what is left of them for a score of zero: a few numbers each.
    by_class = known.groupBy(*groups, F.col("actual").alias("cls")).agg(F.count(F.lit(1)).alias("own"))
    whole = known.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("all")).alias("width"))
    every = whole.select(*groups, "rows", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("cls"))
    told = merged.groupBy(*groups, "cls").agg(F.sum("pos").alias("listed_pos"), F.sum("neg").alias("listed_neg"))
    both = [*groups, "cls"]
    zeros = _joined(_joined(every, by_class, both), told, both)
    own, count = F.coalesce("own", F.lit(0)), lambda c: F.coalesce(c, F.lit(0))
    zeros = zeros.select(
        *both, F.lit(0.0).alias("score"), (own - count("listed_pos")).alias("pos"),
        (F.col("rows") - own - count("listed_neg")).alias("neg"),
    ).where("pos + neg > 0")
    present = merged.where(F.col("score").isNotNull()).select(*both, "score", "pos", "neg").unionByName(zeros)
    bounds = _range_bounds(entries.where(F.col("score").isNotNull()), "score", rows_per_range)
    # Training and test rows, or whatever few groups there are, times classes.
    most_groups = None
    if bounds is not None:
        most_groups = classes * (known.select(*groups).distinct().limit(BROADCAST_RANGES).count() if groups else 1)
    per_class = _areas(present, "score", both, bounds, most_groups)
    return per_class.groupBy(*groups).agg(
        F.round(F.when(F.count("roc_auc") == classes, F.avg("roc_auc")), 6).alias("roc_auc")
    )


def _joined(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Left join by columns where null equals null."""
    renamed = right.withColumnsRenamed({n: f"__{n}" for n in names})
    same = [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names]
    return left.join(renamed, same, "left").drop(*[f"__{n}" for n in names])


def generalization_gap(train: Column, test: Column, higher_is_better: Column) -> Column:
    """How much worse the test score is: absolute, or relative for error measures."""
    relative = F.coalesce(F.try_divide(test - train, F.abs(train)), test - train)
    return F.round(F.when(higher_is_better, train - test).otherwise(relative), 6)


def overfitting_risk(gap: Column, higher_is_better: Column) -> Column:
    high = F.when(higher_is_better, 0.15).otherwise(0.30)
    medium = F.when(higher_is_better, 0.07).otherwise(0.15)
    return (
        F.when(gap.isNull() | F.isnan(gap), "unknown")
        .when(gap <= 0, "low")
        .when(gap >= high, "high")
        .when(gap >= medium, "medium")
        .otherwise("low")
    )


def best_experiment(experiments: DataFrame) -> DataFrame:
    """The successful experiment with the best primary test score; ties go to the earlier."""
    score = F.col("primary_metric_value")
    better = F.when(F.col("higher_is_better"), -score).otherwise(score)
    usable = experiments.where((F.col("status") == "success") & score.isNotNull() & ~F.isnan(score))
    return usable.orderBy(better, "seq").limit(1)


def run_status(experiments: DataFrame) -> DataFrame:
    """One row: the status of a run and how many experiments ended how."""
    succeeded = F.count_if(F.col("status") == "success")
    return experiments.agg(
        F.when(succeeded == 0, "failed")
        .when(succeeded == F.count(F.lit(1)), "completed")
        .otherwise("completed_with_failures")
        .alias("run_status"),
        F.count(F.lit(1)).alias("experiments"),
        succeeded.alias("succeeded"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )
