"""Target column and task inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscope.config import DEFAULT_TARGET_NAMES
from gridscope.functions.columns import missing_to_null, quoted
from gridscope.functions.tables import local_table

RESULT = "candidate_target string, task_type string, status string, reasons array<string>"


def matching_targets(columns: Sequence[str], candidates: Sequence[str]) -> list[str]:
    """Columns named like a candidate; of names equal but for case, the last."""
    by_name = {name.strip().lower(): name for name in columns}
    return [by_name[c.lower()] for c in candidates if c.lower() in by_name]


def label_like(value: Column, max_classes: int) -> Column:
    """Aggregate: do the numbers look like class codes rather than measurements?

    Codes are 0..k-1, 1..k or {-1, 1} with k at most `max_classes`, so only whole
    numbers from -1 to `max_classes` matter. Counting distinct values inside that
    window shuffles a handful of rows where a plain distinct count would shuffle
    the column.
    """
    number = value.cast("double")
    in_window = number.between(-1, max_classes) & (number == F.floor(number))
    window = F.when(in_window, number.cast("bigint"))
    distinct = F.count_distinct(window)
    only_codes = F.count(window) == F.count(value)
    low, high = F.min(window), F.max(window)
    two_classes = ((low == 0) & (high == 1) & (distinct == 2)) | (
        (low == -1) & (high == 1) & (distinct == 2)
    )
    sparse = (distinct > 2) & (F.try_divide(distinct, F.count(value)) > 0.5)
    consecutive = (high - low + 1 == distinct) & low.isin(0, 1)
    return F.coalesce(
        only_codes & (distinct <= max_classes) & (two_classes | (~sparse & consecutive)),
        F.lit(False),
    )


def infer_task(
    df: DataFrame,
    candidates: Sequence[str] = DEFAULT_TARGET_NAMES,
    max_classes: int = 20,
) -> DataFrame:
    """One row: target column, task type, status and reasons."""
    spark = df.sparkSession
    matches = matching_targets(df.columns, candidates)
    if not matches:
        reasons = ["no column is named like a target"]
        return local_table(spark, [(None, None, "not_found", reasons)], RESULT)
    if len(matches) > 1:
        reasons = ["several columns are named like a target: " + ", ".join(matches)]
        return local_table(spark, [(None, None, "ambiguous", reasons)], RESULT)

    target = matches[0]
    data_type = df.schema[df.columns.index(target)].dataType
    value = missing_to_null(F.col(quoted(target)), data_type)
    is_number = isinstance(data_type, T.NumericType)
    facts = df.agg(
        (F.count(value) == 0).alias("all_missing"),
        (label_like(value, max_classes) if is_number else F.lit(True)).alias("label_like"),
    )
    matched = F.lit(f"column '{target}' is named like a target")
    return facts.select(
        F.lit(target).alias("candidate_target"),
        F.when(F.col("all_missing"), F.lit(None))
        .when(F.col("label_like"), "classification")
        .otherwise("regression")
        .alias("task_type"),
        F.when(F.col("all_missing"), "ambiguous").otherwise("ok").alias("status"),
        F.array(
            matched,
            F.when(F.col("all_missing"), "it holds no value")
            .when(F.col("label_like"), "its type or its few values look like classes")
            .otherwise("it holds numbers that do not look like class codes"),
        ).alias("reasons"),
    )
