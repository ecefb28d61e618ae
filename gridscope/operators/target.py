"""Target profile: summary, class distribution, numeric summary, issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscope.config import AnalysisConfig
from gridscope.functions.columns import (
    atomic,
    json_text,
    missing_to_null,
    quoted,
    ratio,
    to_number,
)
from gridscope.functions.order import exact_quantiles
from gridscope.operators.quality import issue, issue_rows


class TargetError(ValueError):
    """The target column cannot be profiled."""


def target_values(df: DataFrame, target: str) -> tuple[DataFrame, T.DataType]:
    """The target as a single column `value`, with its declared type."""
    if target not in df.columns:
        raise TargetError(f"no such target column: {target}")
    data_type = df.schema[df.columns.index(target)].dataType
    column = missing_to_null(F.col(quoted(target)), data_type)
    return df.select(atomic(column, data_type).alias("value")), data_type


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Label, count and share of the non-missing rows, most frequent first."""
    values, _ = target_values(df, target)
    data_type = values.schema["value"].dataType
    groups = (
        values.where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = values.agg(F.count("value")).scalar()
    return groups.orderBy(F.desc("n"), "value").select(
        json_text(F.col("value"), data_type).alias("label"),
        F.col("n").alias("count"),
        ratio(F.col("n"), total).alias("proportion"),
    )


def _class_counts(values: DataFrame) -> DataFrame:
    """One row over the classes: counts, the most and the least frequent class."""
    value, n = F.col("value"), F.col("n")
    present = F.when(value.isNotNull(), n)
    frequency = F.when(value.isNotNull(), F.struct((-n).alias("order"), value.alias("value")))
    groups = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(present), F.lit(0)).alias("non_null_count"),
        F.count(value).alias("unique_count"),
        F.min(frequency).alias("most"),
        F.max(frequency).alias("least"),
        F.lit(0).cast("bigint").alias("numbers"),
        F.lit(False).alias("same"),
    )


def _number_counts(values: DataFrame, unique_count: int | None) -> DataFrame:
    """One row over the numbers; without a distinct count to make, nothing is shuffled."""
    data_type = values.schema["value"].dataType
    value, number = F.col("value"), to_number(F.col("value"), data_type)
    none = F.struct(F.lit(0).alias("order"), F.lit(None).cast(data_type).alias("value"))
    distinct = F.count_distinct(value) if unique_count is None else F.max(F.lit(unique_count))
    return values.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(value).alias("non_null_count"),
        distinct.cast("bigint").alias("unique_count"),
        F.count(number).alias("numbers"),
        F.coalesce(F.min(number) == F.max(number), F.lit(False)).alias("same"),
    ).withColumns({"most": none, "least": none})


def target_summary(
    df: DataFrame, target: str, task_type: str, unique_count: int | None = None
) -> DataFrame:
    """One row: counts, and either the class balance or the numeric validity.

    A distinct count known from a profile spares counting numbers again.
    """
    values, _ = target_values(df, target)
    data_type = values.schema["value"].dataType
    if task_type == "classification":
        counted = _class_counts(values)
    else:
        counted = _number_counts(values, unique_count)
    rows, non_null = F.col("row_count"), F.col("non_null_count")
    for_classes = F.lit(task_type == "classification") & (non_null > 0)
    for_numbers = F.lit(task_type == "regression") & (non_null > 0)

    def label(end: str) -> Column:
        return F.when(for_classes, json_text(F.col(f"{end}.value"), data_type))

    def share(end: str) -> Column:
        return F.when(for_classes, ratio(-F.col(f"{end}.order"), non_null))

    return counted.select(
        F.lit(target).alias("target_column"),
        F.lit(task_type).alias("task_type"),
        rows,
        non_null,
        (rows - non_null).alias("missing_count"),
        ratio(rows - non_null, rows).alias("missing_ratio"),
        "unique_count",
        label("most").alias("majority_class"),
        share("most").alias("majority_class_ratio"),
        label("least").alias("minority_class"),
        share("least").alias("minority_class_ratio"),
        F.when(
            for_classes & (F.col("unique_count") > 1),
            F.round(F.try_divide(F.col("most.order"), F.col("least.order")), 6),
        ).alias("class_imbalance_ratio"),
        F.when(for_numbers, non_null - F.col("numbers")).alias("invalid_numeric_count"),
        F.when(for_numbers, F.col("numbers")).alias("numeric_count"),
        F.when(for_numbers, F.col("same")).alias("is_constant_number"),
    )


def target_issues(summary: DataFrame, config: AnalysisConfig | None = None) -> DataFrame:
    """Issue rows of a target summary, in a fixed order."""
    config = config or AnalysisConfig()
    missing, unique = F.col("missing_ratio"), F.col("unique_count")
    imbalance = F.col("class_imbalance_ratio")
    classes = (F.col("task_type") == "classification") & (F.col("non_null_count") > 0)

    def known(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    return issue_rows(
        summary,
        [
            issue(
                "target_missing_values", "warning", missing > config.target_missing_warning,
                "some rows have no target value", metric=missing,
            ),
            issue(
                "target_all_missing", "critical", F.col("non_null_count") == 0,
                "the target holds no value at all",
            ),
            issue(
                "single_class_target", "critical", classes & (unique == 1),
                "the target has one class, so there is nothing to separate",
            ),
            issue(
                "high_cardinality_classification_target", "warning",
                classes & (unique > config.high_cardinality_classes),
                "the target has very many classes", metric=unique,
            ),
            issue(
                "class_imbalance", "warning",
                known(
                    (imbalance >= config.imbalance_ratio)
                    | (imbalance.isNotNull() & (F.col("minority_class_ratio") <= config.minority_share))
                ),
                "classes are unbalanced: split by class and weigh them", metric=imbalance,
            ),
            issue(
                "non_numeric_regression_target", "critical",
                known(F.col("invalid_numeric_count") > 0),
                "the regression target holds values that are not numbers",
                metric=F.col("invalid_numeric_count"),
            ),
            issue(
                "empty_numeric_regression_target", "critical", known(F.col("numeric_count") == 0),
                "the regression target holds no number",
            ),
            issue(
                "constant_regression_target", "critical", known(F.col("is_constant_number")),
                "the regression target has a single value",
            ),
        ],
    )


def numeric_summary(df: DataFrame, target: str) -> DataFrame:
    """One row: count, mean, std, quartiles and extremes, bias-corrected skewness."""
    values, data_type = target_values(df, target)
    numbers = values.select(to_number(F.col("value"), data_type).alias("x"))
    q25, median, q75 = exact_quantiles(numbers, ["x"], [0.25, 0.5, 0.75])["x"]
    n = F.count("x").cast("double")
    correction = F.try_divide(F.sqrt(n * (n - 1)), n - 2)

    def fixed(value) -> Column:
        return F.round(F.lit(value).cast("double"), 6)

    return numbers.agg(
        F.count("x").alias("count"),
        F.round(F.avg("x"), 6).alias("mean"),
        F.round(F.stddev_samp("x"), 6).alias("std"),
        F.round(F.min("x"), 6).alias("minimum"),
        F.max(fixed(q25)).alias("q25"),
        F.max(fixed(median)).alias("median"),
        F.max(fixed(q75)).alias("q75"),
        F.round(F.max("x"), 6).alias("maximum"),
        F.when(
            n >= 3,
            F.when(F.min("x") == F.max("x"), 0.0).otherwise(
                F.round(F.skewness("x") * correction, 6)
            ),
        ).alias("skewness"),
    )
