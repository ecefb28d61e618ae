"""Table-level counts and the validation verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.config import AnalysisConfig
from gridscope.functions.columns import positional

NO_NAMES = "array<string>"


def table_counts(df: DataFrame) -> DataFrame:
    """One row of counts shared by validation and the quality report.

    A single aggregate over the table; only one row per task is shuffled.
    """
    frame = positional(df)
    names = df.columns
    some = " OR ".join(f"{c} IS NULL" for c in frame.columns) or "false"
    every = " AND ".join(f"{c} IS NULL" for c in frame.columns) or "false"
    present = ", ".join(f"count({c})" for c in frame.columns)
    counted = frame.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.expr(some)).alias("rows_with_missing_count"),
        F.count_if(F.expr(every)).alias("fully_missing_row_count"),
        F.expr(f"array({present})").cast("array<bigint>").alias("non_null"),
    )
    labels = F.array(*[F.lit(name) for name in names]).cast(NO_NAMES)
    paired = F.arrays_zip(labels.alias("name"), F.col("non_null"))
    fewer = F.filter(paired, lambda p: p["non_null"] < F.col("row_count"))
    none = F.filter(paired, lambda p: p["non_null"] == 0)
    present = F.aggregate("non_null", F.lit(0).cast("bigint"), lambda total, n: total + n)
    return counted.select(
        "row_count",
        F.lit(len(names)).cast("bigint").alias("column_count"),
        (F.col("row_count") * len(names) - present).alias("missing_cell_count"),
        "rows_with_missing_count",
        "fully_missing_row_count",
        F.transform(fewer, lambda p: p["name"]).alias("columns_with_missing_values"),
        F.transform(none, lambda p: p["name"]).alias("fully_missing_columns"),
    )


def validate_table(
    df: DataFrame, config: AnalysisConfig | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """One row: `is_valid`, the counts, and lists of errors and warnings."""
    config = config or AnalysisConfig()
    counts = table_counts(df) if counts is None else counts
    rows, columns = F.col("row_count"), F.col("column_count")
    all_missing = (columns > 0) & (F.size("fully_missing_columns") == columns)

    def when(condition, message):
        return F.when(condition, message)

    errors = F.array_compact(
        F.array(
            when(
                columns < config.min_columns,
                F.concat(
                    F.lit(f"too few columns: {config.min_columns} needed, found "),
                    columns.cast("string"),
                ),
            ),
            when(
                rows < config.min_rows,
                F.concat(
                    F.lit(f"too few rows: {config.min_rows} needed, found "), rows.cast("string")
                ),
            ),
            when((rows == 0) | (columns == 0), F.lit("the table is empty")),
            when(all_missing, F.lit("every cell is missing")),
        )
    )
    warnings = F.array_compact(
        F.array(
            when(F.col("fully_missing_row_count") > 0, F.lit("some rows hold no value at all")),
            when(
                F.size("fully_missing_columns") > 0,
                F.concat(
                    F.lit("columns without any value: "),
                    F.array_join("fully_missing_columns", ", "),
                ),
            ),
        )
    )
    return counts.select(
        (F.size(errors) == 0).alias("is_valid"),
        rows,
        columns,
        errors.alias("errors"),
        warnings.alias("warnings"),
        "fully_missing_columns",
    )
