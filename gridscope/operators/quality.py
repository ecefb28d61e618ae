"""Data-quality summary (one row) and issues (one row each)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscope.config import AnalysisConfig
from gridscope.functions.columns import grouping_key, positional, ratio, row_digest
from gridscope.operators.profile import names_where, profile_columns
from gridscope.operators.validate import table_counts

NO_NAMES = "array<string>"
PLAIN_COLUMNS = 4
FRACTIONS = (T.FloatType, T.DoubleType)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat another one.

    Null equals null. Rows of more than four columns are shuffled as 32-byte digests,
    others as their keys, in which long strings are digests. Copies are merged on the map
    side, so a group with a third of all rows costs one row per task.
    """
    frame = positional(df)
    keys = [grouping_key(F.col(f.name), f.dataType).alias(f.name) for f in frame.schema]
    if len(keys) > PLAIN_COLUMNS:
        # Adding zero makes both zeros one, as grouping does.
        same = [k + 0.0 if isinstance(f.dataType, FRACTIONS) else k for k, f in zip(keys, frame.schema)]
        keys = [row_digest(same).alias("digest")]
    keys = frame.select(*keys)
    groups = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("n"))
    repeats = F.sum(F.col("n") - 1)
    if not df.columns:
        repeats = F.lit(0)
    return groups.agg(F.coalesce(repeats, F.lit(0)).cast("bigint").alias("duplicate_row_count"))


def looks_like_id(config: AnalysisConfig) -> Column:
    """Over a profile: an id-like name whose values are nearly all different."""
    named = F.lower("column_name").rlike(r"id\s*$|identifier")
    return named & ~F.col("is_all_missing") & (F.col("unique_ratio") >= config.possible_id_ratio)


def possible_id_columns(profile: DataFrame, config: AnalysisConfig | None = None) -> DataFrame:
    return profile.where(looks_like_id(config or AnalysisConfig())).select(
        "position", "column_name", "unique_ratio"
    )


def quality_summary(
    df: DataFrame,
    config: AnalysisConfig | None = None,
    profile: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row of quality measures; a profile or counts made before are reused."""
    config = config or AnalysisConfig()
    profile = profile_columns(df, config, with_samples=False) if profile is None else profile
    counts = table_counts(df) if counts is None else counts
    lists = profile.agg(
        F.struct(
            names_where(F.col("is_constant")).alias("constant"),
            names_where(F.col("is_high_cardinality")).alias("high_cardinality"),
            names_where(looks_like_id(config)).alias("possible_id"),
        ).alias("lists")
    )
    rows, cells = F.col("row_count"), F.col("row_count") * F.col("column_count")
    measured = counts.select(
        "*",
        duplicate_rows(df).scalar().alias("duplicate_row_count"),
        lists.scalar().alias("lists"),
    )
    return measured.select(
        rows,
        "column_count",
        "duplicate_row_count",
        ratio(F.col("duplicate_row_count"), rows).alias("duplicate_row_ratio"),
        "missing_cell_count",
        ratio(F.col("missing_cell_count"), cells).alias("missing_cell_ratio"),
        "rows_with_missing_count",
        ratio(F.col("rows_with_missing_count"), rows).alias("rows_with_missing_ratio"),
        "fully_missing_row_count",
        ratio(F.col("fully_missing_row_count"), rows).alias("fully_missing_row_ratio"),
        "columns_with_missing_values",
        "fully_missing_columns",
        F.col("lists.constant").alias("constant_columns"),
        F.col("lists.high_cardinality").alias("high_cardinality_columns"),
        F.col("lists.possible_id").alias("possible_id_columns"),
    ).withColumn(
        "is_usable_for_analysis", F.col("missing_cell_ratio") < config.missing_cell_critical
    )


def issue(code: str, severity: str, fires: Column, message: str, columns=None, metric=None) -> Column:
    """A rule: an issue row that is kept when its condition holds."""
    return F.struct(
        fires.alias("fires"),
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        (F.array() if columns is None else columns).cast(NO_NAMES).alias("columns"),
        (F.lit(None) if metric is None else metric).cast("double").alias("metric_value"),
        F.lit(message).alias("message"),
    )


def issue_rows(summary: DataFrame, rules: list[Column]) -> DataFrame:
    """Evaluate rules over a one-row summary, numbering the ones that hold."""
    holding = F.filter(F.array(*rules), lambda rule: rule["fires"])
    return summary.select(F.posexplode(holding).alias("seq", "found")).select(
        "seq", "found.code", "found.severity", "found.columns", "found.metric_value", "found.message"
    )


def quality_issues(summary: DataFrame, config: AnalysisConfig | None = None) -> DataFrame:
    """Issue rows of a quality summary, in a fixed order."""
    config = config or AnalysisConfig()
    missing, repeated = F.col("missing_cell_ratio"), F.col("duplicate_row_ratio")
    critical = missing >= config.missing_cell_critical

    def lists(name: str) -> Column:
        return F.size(name) > 0

    return issue_rows(
        summary,
        [
            issue(
                "critical_missingness", "critical", critical,
                "so many cells are missing that results may be unreliable",
                F.col("columns_with_missing_values"), missing,
            ),
            issue(
                "missing_values", "warning", ~critical & (missing >= config.missing_cell_warning),
                "missing cells need treatment before training",
                F.col("columns_with_missing_values"), missing,
            ),
            issue(
                "duplicate_rows", "warning",
                (repeated >= config.duplicate_row_warning) & (F.col("duplicate_row_count") > 0),
                "repeated rows may bias the evaluation", metric=repeated,
            ),
            issue(
                "fully_missing_rows", "warning", F.col("fully_missing_row_count") > 0,
                "some rows hold no value at all", metric=F.col("fully_missing_row_ratio"),
            ),
            issue(
                "fully_missing_columns", "warning", lists("fully_missing_columns"),
                "some columns hold no value at all", F.col("fully_missing_columns"),
            ),
            issue(
                "constant_columns", "warning", lists("constant_columns"),
                "columns with a single value carry no signal", F.col("constant_columns"),
            ),
            issue(
                "high_cardinality_columns", "warning", lists("high_cardinality_columns"),
                "columns with very many values need encoding with care or exclusion",
                F.col("high_cardinality_columns"),
            ),
            issue(
                "possible_id_columns", "warning", lists("possible_id_columns"),
                "identifier-like columns help joins but should not be features",
                F.col("possible_id_columns"),
            ),
        ],
    )
