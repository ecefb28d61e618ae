"""Column profile: one row per column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscope.config import AnalysisConfig
from gridscope.functions.columns import (
    NESTED,
    atomic,
    grouping_key,
    json_text,
    key_family,
    key_text_length,
    positional,
    ratio,
)
from gridscope.functions.tables import local_table

EMPTY_STATS = "position int, row_count bigint, non_null_count bigint, unique_count bigint, length_sum bigint"


def value_counts(df: DataFrame) -> DataFrame:
    """Row, non-missing and distinct counts per column, exact, in one pass.

    Columns are unpivoted to (position, value), one branch per physical type, so a
    shuffled row holds one value however wide the table is. Repeated values are
    merged before the shuffle, and a value that fills a third of the table
    arrives as one row per map task. Each branch reads only its own columns.
    """
    frame = positional(df)
    families: dict[str, list[int]] = {}
    for position, field in enumerate(frame.schema):
        families.setdefault(key_family(field.dataType), []).append(position)

    branches = []
    for family, positions in families.items():
        keys = frame.select(
            *[
                grouping_key(F.col(f"c{p}"), frame.schema[p].dataType).alias(str(p))
                for p in positions
            ]
        )
        groups = (
            keys.unpivot([], [str(p) for p in positions], "position", "value")
            .withColumn("position", F.col("position").cast("int"))
            .groupBy("position", "value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        length = key_text_length(F.col("value")) if family == "string" else F.lit(None).cast("bigint")
        branches.append(
            groups.groupBy("position").agg(
                F.sum("n").alias("row_count"),
                F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("non_null_count"),
                F.count("value").alias("unique_count"),
                F.sum(F.col("n") * length).alias("length_sum"),
            )
        )
    if not branches:
        return local_table(df.sparkSession, [], EMPTY_STATS)
    return reduce(DataFrame.unionByName, branches)


def estimated_value_counts(df: DataFrame, error: float) -> DataFrame:
    """The same counts with an estimated distinct count: one aggregate, no value shuffled.

    Flags that compare the distinct share with a limit can then be off by `error`.
    """
    frame = positional(df)
    if not df.columns:
        return local_table(df.sparkSession, [], EMPTY_STATS)
    stats = []
    for position, field in enumerate(frame.schema):
        column = F.col(field.name)
        is_text = isinstance(field.dataType, T.StringType)
        length = F.length(column) if is_text else F.lit(None)
        estimate = F.approx_count_distinct(grouping_key(column, field.dataType), error)
        stats.append(
            F.struct(
                F.lit(position).alias("position"),
                F.count(F.lit(1)).alias("row_count"),
                F.count(column).alias("non_null_count"),
                F.least(estimate, F.count(column)).alias("unique_count"),
                F.sum(length.cast("bigint")).alias("length_sum"),
            )
        )
    return frame.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))


def storage_kind(data_type: T.DataType) -> str:
    """What the declared type alone says about the logical type."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, T.StringType):
        return "string"
    return "unknown"


def logical_type(kind: Column, config: AnalysisConfig) -> Column:
    non_null, unique = F.col("non_null_count"), F.col("unique_count")
    mean_length = F.try_divide(F.col("length_sum"), non_null)
    is_text = (mean_length >= config.text_min_length) & (
        F.try_divide(unique, non_null) >= config.text_min_ratio
    )
    return (
        F.when(non_null == 0, "empty")
        .when(kind != "string", kind)
        .when(is_text, "text")
        .otherwise("categorical")
    )


def profile_columns(
    df: DataFrame, config: AnalysisConfig | None = None, with_samples: bool = True
) -> DataFrame:
    """One row per column: type, counts, ratios, flags and sample values."""
    config = config or AnalysisConfig()
    names = local_table(
        df.sparkSession,
        [
            (i, name, field.dataType.simpleString(), storage_kind(field.dataType))
            for i, (name, field) in enumerate(zip(df.columns, df.schema))
        ],
        "position int, column_name string, dtype string, kind string",
    )
    if config.distinct_error is None:
        counts = value_counts(df)
    else:
        counts = estimated_value_counts(df, config.distinct_error)
    # One row per column of the table: the broadcast is bounded by the schema.
    counted = names.join(F.broadcast(counts), "position", "left").na.fill(
        0, ["row_count", "non_null_count", "unique_count"]
    )
    non_null, unique, rows = F.col("non_null_count"), F.col("unique_count"), F.col("row_count")
    profile = counted.withColumn("inferred_type", logical_type(F.col("kind"), config)).select(
        "position",
        "column_name",
        "dtype",
        "inferred_type",
        non_null,
        (rows - non_null).alias("missing_count"),
        ratio(rows - non_null, rows).alias("missing_ratio"),
        unique,
        ratio(unique, non_null).alias("unique_ratio"),
        (unique == 1).alias("is_constant"),
        (non_null == 0).alias("is_all_missing"),
        (
            F.col("inferred_type").isin("categorical", "text")
            & (unique >= config.high_cardinality_min_unique)
            & F.coalesce(
                F.try_divide(unique, non_null) >= config.high_cardinality_ratio, F.lit(False)
            )
        ).alias("is_high_cardinality"),
    )
    if not with_samples:
        return profile
    samples = sample_values(df, config.sample_values).select("position", "sample_values")
    none = F.array().cast("array<string>")
    return profile.join(F.broadcast(samples), "position", "left").withColumn(
        "sample_values", F.coalesce("sample_values", none)
    )


def sample_values(df: DataFrame, count: int = 3) -> DataFrame:
    """The `count` smallest distinct values of each column, as text.

    Each round is a plain aggregate: the smallest value above the previous one.
    Nothing is sorted or shuffled but one row per task, whatever the skew, and one
    value per column reaches the driver.
    """
    schema = "position int, column_name string, sample_values array<string>"
    if count <= 0 or not df.columns:
        return local_table(df.sparkSession, [], schema)
    types = [field.dataType for field in df.schema]
    frame = positional(df)
    frame = frame.select(*[_literal_form(F.col(c), t).alias(c) for c, t in zip(frame.columns, types)])
    shown = [_shown(F.col(c), t) for c, t in zip(frame.columns, types)]

    found: list[list[str]] = [[] for _ in types]
    floors = [None] * len(types)
    for number in range(count):
        open_columns = [
            i for i in range(len(types)) if number == 0 or floors[i] is not None
        ]
        if not open_columns:
            break
        smallest = frame.agg(
            *[_smallest_above(f"c{i}", floors[i], types[i]).alias(f"c{i}") for i in open_columns]
        )
        row = smallest.select("*", *[shown[i].alias(f"text{i}") for i in open_columns]).first()
        for i in open_columns:
            floors[i] = row[f"c{i}"]
            if floors[i] is not None:
                found[i].append(row[f"text{i}"])
    rows = [(i, name, values) for i, (name, values) in enumerate(zip(df.columns, found))]
    return local_table(df.sparkSession, rows, schema)


def _literal_form(column: Column, data_type: T.DataType) -> Column:
    """A form with the same order whose values are exact as literals."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(data_type, (*NESTED, T.BinaryType, T.NullType)):
        return atomic(column, data_type)
    known = (T.NumericType, T.BooleanType, T.StringType, T.DateType, T.TimestampNTZType)
    return column if isinstance(data_type, known) else column.cast("string")


def _shown(form: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.TimestampType):
        return json_text(F.timestamp_micros(form), data_type)
    text_already = isinstance(data_type, (*NESTED, T.BinaryType, T.NullType))
    return form if text_already else json_text(form, data_type)


def _smallest_above(name: str, floor: object, data_type: T.DataType) -> Column:
    if floor is None:
        return F.min(name)
    bound = F.lit(floor)
    if isinstance(data_type, T.TimestampNTZType):
        bound = F.lit(floor.isoformat()).cast("timestamp_ntz")
    elif isinstance(data_type, T.FloatType):
        bound = bound.cast("float")
    return F.min(F.when(F.col(name) > bound, F.col(name)))


def column_lists(profile: DataFrame) -> DataFrame:
    """One row of column-name lists by type and by flag, in table order."""
    kinds = ("numeric", "categorical", "boolean", "datetime", "text", "empty")
    return profile.agg(
        *[names_where(F.col("inferred_type") == kind).alias(f"{kind}_columns") for kind in kinds],
        names_where(F.col("is_constant")).alias("constant_columns"),
        names_where(F.col("is_all_missing")).alias("all_missing_columns"),
        names_where(F.col("is_high_cardinality")).alias("high_cardinality_columns"),
    )


def names_where(condition: Column) -> Column:
    """Aggregate of a profile: names of the columns that meet a condition."""
    found = F.collect_list(F.when(condition, F.struct("position", "column_name")))
    return F.array_sort(found)["column_name"]
