"""Feature plan and preprocessing: which columns are used, and how."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.config import AnalysisConfig
from gridscope.functions.columns import missing_to_null, quoted, to_number
from gridscope.functions.order import exact_quantiles
from gridscope.operators.quality import looks_like_id

FEATURES = "__features"
BUCKETS = ("numeric", "categorical", "boolean")


class FeatureError(ValueError):
    """No feature matrix can be built."""


def plan_features(
    profile: DataFrame,
    target: str,
    config: AnalysisConfig | None = None,
    possible_ids: Sequence[str] | None = None,
    exclude_possible_id: bool = True,
    exclude_text: bool = True,
    exclude_datetime: bool = True,
    exclude_high_cardinality: bool = True,
    exclude_constant: bool = True,
    exclude_all_missing: bool = True,
) -> DataFrame:
    """Per column other than the target: its bucket, or why it is left out.

    The first reason that holds is given. Text and date columns have no bucket, so
    switching their rule off changes the reason, not the outcome.
    """
    config = config or AnalysisConfig()
    kind = F.col("inferred_type")
    if possible_ids is None:
        is_id = looks_like_id(config)
    else:
        is_id = F.col("column_name").isin(list(possible_ids))
    reason = (
        F.when(F.lit(exclude_all_missing) & F.col("is_all_missing"), "all_missing")
        .when(F.lit(exclude_constant) & F.col("is_constant"), "constant")
        .when(F.lit(exclude_possible_id) & is_id, "possible_id")
        .when(F.lit(exclude_text) & (kind == "text"), "text")
        .when(F.lit(exclude_datetime) & (kind == "datetime"), "datetime")
        .when(F.lit(exclude_high_cardinality) & F.col("is_high_cardinality"), "high_cardinality")
        .when(~kind.isin(*BUCKETS), "unknown_type")
    )
    if config.max_categories is not None:
        many = (kind == "categorical") & (F.col("unique_count") > config.max_categories)
        reason = F.coalesce(reason, F.when(many, "too_many_categories"))
    return (
        profile.where(F.col("column_name") != target)
        .withColumn("exclusion_reason", reason)
        .select(
            "position",
            "column_name",
            F.when(F.col("exclusion_reason").isNull(), kind).alias("bucket"),
            "exclusion_reason",
            "unique_count",
        )
    )


@dataclass(frozen=True)
class FeatureColumns:
    """The included columns of a feature plan, by bucket, in table order."""

    numeric: list[str]
    categorical: list[str]
    boolean: list[str]

    @property
    def all(self) -> list[str]:
        return [*self.numeric, *self.categorical, *self.boolean]

    @property
    def discrete(self) -> list[str]:
        return [*self.categorical, *self.boolean]


def feature_columns(plan: DataFrame) -> FeatureColumns:
    """Read a plan (one row per column of the table) on the driver."""
    rows = plan.where(F.col("bucket").isNotNull()).orderBy("position").collect()
    if not rows:
        raise FeatureError("no usable feature is left")
    return FeatureColumns(
        *[[r["column_name"] for r in rows if r["bucket"] == bucket] for bucket in BUCKETS]
    )


def select_features(
    df: DataFrame,
    features: FeatureColumns,
    target: str,
    task_type: str,
    keep: Sequence[str] = (),
    drop_missing_target: bool = True,
) -> DataFrame:
    """Feature columns and the target, for the rows that have a target value."""
    if target not in df.columns:
        raise FeatureError(f"no such target column: {target}")
    types = {name: field.dataType for name, field in zip(df.columns, df.schema)}
    value = missing_to_null(F.col(quoted(target)), types[target])
    number = to_number(F.col(quoted(target)), types[target])
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(value).alias("present"),
        F.count_if(value.isNotNull() & number.isNull()).alias("not_numbers"),
    ).first()
    if facts["rows"] == 0:
        raise FeatureError("the table is empty")
    if facts["present"] < facts["rows"] and not drop_missing_target:
        raise FeatureError("some rows have no target value")
    if facts["present"] == 0:
        raise FeatureError("no row has a target value")
    if task_type == "regression" and facts["not_numbers"]:
        raise FeatureError(f"regression target '{target}' holds values that are not numbers")
    extra = [name for name in keep if name not in features.all and name != target]
    columns = [
        missing_to_null(F.col(quoted(name)), types[name]).alias(name)
        for name in [*features.all, *extra]
    ]
    chosen = number if task_type == "regression" else value
    return df.where(value.isNotNull()).select(*columns, chosen.alias(target))


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of numeric columns."""
    renamed = _doubles(df, columns)
    found = exact_quantiles(renamed, renamed.columns, [0.5])
    return {name: found[f"x{i}"][0] for i, name in enumerate(columns)}


def _doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    types = {name: field.dataType for name, field in zip(df.columns, df.schema)}
    return df.select(
        *[
            to_number(F.col(quoted(name)), types[name]).alias(f"x{i}")
            for i, name in enumerate(columns)
        ]
    )


def _strings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(
        *[F.col(quoted(name)).cast("string").alias(str(i)) for i, name in enumerate(columns)]
    )


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(position in `columns`, value, n) for every category that occurs."""
    return (
        _strings(df, columns)
        .unpivot([], [str(i) for i in range(len(columns))], "position", "value")
        .where(F.col("value").isNotNull())
        .groupBy("position", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("position", F.col("position").cast("int"))
    )


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the most frequent value (of equals the smallest) and the distinct count.

    Counted with a grouped aggregate: `mode` keeps all values of a column in one task.
    """
    names = F.array(*[F.lit(name) for name in columns])
    first = F.min(F.struct((-F.col("n")).alias("order"), "value"))
    return (
        category_counts(df, columns)
        .groupBy("position")
        .agg(first.alias("first"), F.count(F.lit(1)).alias("categories"))
        .select(
            F.element_at(names, F.col("position") + 1).alias("column_name"),
            F.col("first.value").alias("value"),
            (-F.col("first.order")).alias("n"),
            "categories",
        )
    )


def scaling(df: DataFrame, columns: Sequence[str], fill: dict[str, float | None]) -> DataFrame:
    """Mean and population deviation per numeric column after imputation, one row."""
    frame = _doubles(df, columns)
    filled = [F.coalesce(F.col(f"x{i}"), F.lit(fill[name])) for i, name in enumerate(columns)]
    return frame.agg(
        *[F.avg(c).alias(f"mean{i}") for i, c in enumerate(filled)],
        *[F.stddev_pop(c).alias(f"std{i}") for i, c in enumerate(filled)],
    )


def category_labels(df: DataFrame, columns: Sequence[str]) -> list[list[str]]:
    """Sorted categories per column.

    They live in a Spark ML model, hence on the driver; `max_categories` of the feature
    plan bounds them.
    """
    labels: list[list[str]] = [[] for _ in columns]
    for position, value in category_counts(df, columns).select("position", "value").collect():
        labels[position].append(value)
    return [sorted(values) or [""] for values in labels]


@dataclass(frozen=True)
class Preprocessing:
    """Fitted feature stages, ending in the vector column `__features`."""

    stages: list
    max_categories: int
    # Slots of the vector that are indexed categories, with their number of values; unseen is one.
    slots: dict[int, int] = field(default_factory=dict)
    # Without an encoder: the columns that the stages add, numbers and texts of categories.
    numbers: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)

    def model(self) -> PipelineModel:
        return PipelineModel(self.stages)


def _number(value: float) -> str:
    return f"double('{value!r}')"


def fit_preprocessing(
    train: DataFrame,
    features: FeatureColumns,
    scale_numeric: bool = True,
    one_hot: bool = True,
    encoded: bool = True,
) -> Preprocessing:
    """Learn imputation, scaling and encoding from the training rows.

    Not encoded, categories stay texts for a later stage to learn from, and no vector is made.
    All stages are Spark ML stages, so a model built on them can be saved and
    loaded. Unseen categories and, after fitting, missing ones need no special
    care: the former become all-zero slots, the latter the most frequent value.
    """
    expressions, inputs, stages = [], [], []
    if features.numeric:
        fill = medians(train, features.numeric)
        fill = {name: 0.0 if value is None else value for name, value in fill.items()}
        scales = scaling(train, features.numeric, fill).first() if scale_numeric else None
        for i, name in enumerate(features.numeric):
            value = f"cast({quoted(name)} as double)"
            filled = f"coalesce(if(isnan({value}), null, {value}), {_number(fill[name])})"
            if scales is not None:
                deviation = scales[f"std{i}"] or 1.0
                filled = f"({filled} - {_number(scales[f'mean{i}'])}) / {_number(deviation)}"
            expressions.append(f"{filled} as __num_{i}")
            inputs.append(f"__num_{i}")

    discrete, most, slots = features.discrete, 0, {}
    if discrete:
        facts = {r["column_name"]: r for r in modes(train, discrete).collect()}
        labels = category_labels(train, discrete) if encoded else [[] for _ in discrete]
        # Only indexed categories are values of a feature; one-hot slots have two.
        if encoded and not one_hot:
            most = max(len(values) for values in labels)
            slots = {len(inputs) + i: len(values) + 1 for i, values in enumerate(labels)}
        for i, name in enumerate(discrete):
            common = facts[name]["value"] if name in facts else ""
            literal = common.replace("\\", "\\\\").replace("'", "\\'")
            # The encoder names its slots after the values and takes no empty name.
            filled = f"coalesce(cast({quoted(name)} as string), '{literal}')"
            expressions.append(f"concat('=', {filled}) as __cat_{i}")
            if not encoded:
                continue
            stages.append(
                StringIndexerModel.from_labels(
                    ["=" + value for value in labels[i]],
                    inputCol=f"__cat_{i}",
                    outputCol=f"__idx_{i}",
                    handleInvalid="keep",
                )
            )
        count = range(len(discrete))
        inputs += [f"{'__hot' if one_hot else '__idx'}_{i}" for i in count]

    statement = "SELECT *, " + ", ".join(expressions) + " FROM __THIS__"
    stages.insert(0, SQLTransformer(statement=statement))
    if not encoded:
        texts = [f"__cat_{i}" for i in range(len(discrete))]
        return Preprocessing(stages, 0, numbers=inputs[: len(inputs) - len(texts)], categories=texts)
    if discrete and one_hot:
        # The indexer states the number of categories, so this fit reads no data.
        indexed = PipelineModel(stages).transform(train.limit(0))
        encoder = OneHotEncoder(
            inputCols=[f"__idx_{i}" for i in count],
            outputCols=[f"__hot_{i}" for i in count],
        )
        stages.append(encoder.fit(indexed))
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="error"))
    return Preprocessing(stages, most, slots)


def class_weights(counts: dict[object, int]) -> dict[object, float]:
    """Balanced weights n / (k * n_c)."""
    total = sum(counts.values())
    return {label: total / (len(counts) * n) for label, n in counts.items() if n}


def class_weight_table(df: DataFrame, label: str) -> DataFrame:
    """Label, count and balanced weight per class."""
    groups = (
        df.where(F.col(quoted(label)).isNotNull())
        .groupBy(F.col(quoted(label)).alias("label"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    facts = groups.agg(F.struct(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return groups.withColumn(
        "weight", F.round(facts["n"] / (facts["k"] * F.col("count")), 6)
    )
