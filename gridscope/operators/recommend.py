"""Model recommendation: explicit rules over the small result tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.config import AnalysisConfig
from gridscope.functions.columns import distinct_messages, ratio
from gridscope.functions.tables import local_table
from gridscope.operators.profile import names_where
from gridscope.operators.quality import looks_like_id

# Fixed values of the rules.
SMALL_ROWS = 1_000
LARGE_ROWS = 100_000
MOSTLY_NUMERIC = 0.70
MANY_CATEGORICAL = 0.30
SEED = 42


@dataclass(frozen=True)
class Candidate:
    """A model to try: its name, role, starting parameters and notes."""

    model_name: str
    role: str
    task_type: str
    params: dict[str, object]
    notes: tuple[str, ...] = ()
    reasons: tuple[str, ...] = ()
    concerns: tuple[str, ...] = ()
    requires: str | None = None


@dataclass(frozen=True)
class Recommendation:
    status: str
    task_type: str
    recommended_model: str | None
    confidence: str
    candidates: list[Candidate] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    blocked_reasons: list[str] = field(default_factory=list)

    @property
    def is_ready(self) -> bool:
        return self.status == "ready" and bool(self.candidates)

    def summary_table(self, spark: SparkSession) -> DataFrame:
        return local_table(
            spark,
            [
                (
                    self.status,
                    self.task_type,
                    self.recommended_model,
                    self.confidence,
                    self.warnings,
                    self.blocked_reasons,
                )
            ],
            "status string, task_type string, recommended_model string, confidence string, "
            "warnings array<string>, blocked_reasons array<string>",
        )

    def candidate_table(self, spark: SparkSession) -> DataFrame:
        return local_table(
            spark,
            [
                (
                    seq,
                    c.model_name,
                    c.role,
                    c.task_type,
                    c.requires,
                    {name: as_text(value) for name, value in c.params.items()},
                    list(c.notes),
                    list(c.reasons),
                    list(c.concerns),
                )
                for seq, c in enumerate(self.candidates)
            ],
            "seq int, model_name string, role string, task_type string, requires string, "
            "params map<string,string>, notes array<string>, reasons array<string>, "
            "concerns array<string>",
        )


def as_text(value: object) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def dataset_facts(
    profile: DataFrame,
    target: str,
    target_issues: DataFrame,
    config: AnalysisConfig | None = None,
) -> DataFrame:
    """One row of table traits the rules read; features are all columns but the target."""
    config = config or AnalysisConfig()
    is_feature = F.col("column_name") != target

    def features(condition) -> Column:
        return F.count_if(is_feature & condition)

    imbalance = target_issues.agg(
        F.coalesce(F.bool_or(F.col("code") == "class_imbalance"), F.lit(False))
    ).scalar()
    counted = profile.agg(
        F.max(F.col("non_null_count") + F.col("missing_count")).alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        features(F.lit(True)).alias("feature_count"),
        features(F.col("inferred_type") == "numeric").alias("numeric_feature_count"),
        features(F.col("inferred_type") == "categorical").alias("categorical_feature_count"),
        features(F.col("inferred_type") == "text").alias("text_feature_count"),
        features(F.col("is_high_cardinality")).alias("high_cardinality_feature_count"),
        F.sum("missing_count").alias("missing_cell_count"),
        names_where(looks_like_id(config)).alias("possible_id_columns"),
        names_where(F.col("is_high_cardinality")).alias("high_cardinality_columns"),
    )
    numeric = ratio(F.col("numeric_feature_count"), F.col("feature_count"))
    categorical = ratio(F.col("categorical_feature_count"), F.col("feature_count"))
    cells = F.col("row_count") * F.col("column_count")
    return counted.select(
        "*",
        numeric.alias("numeric_feature_ratio"),
        categorical.alias("categorical_feature_ratio"),
        ratio(F.col("missing_cell_count"), cells).alias("missing_cell_ratio"),
        (F.col("row_count") < SMALL_ROWS).alias("is_small_dataset"),
        (F.col("row_count") >= LARGE_ROWS).alias("is_large_dataset"),
        (numeric >= MOSTLY_NUMERIC).alias("is_mostly_numeric"),
        (
            (categorical >= MANY_CATEGORICAL) | (F.col("high_cardinality_feature_count") > 0)
        ).alias("has_many_categorical_features"),
        (F.col("text_feature_count") > 0).alias("has_text_features"),
        (F.col("missing_cell_count") > 0).alias("has_missing_values"),
        imbalance.alias("has_class_imbalance"),
    )


LINEAR_NOTES = (
    "impute missing numbers with the median",
    "one-hot encode categories",
    "scale numeric features",
)
TREE_NOTES = ("impute missing values", "encode categories", "leave identifier columns out")


def linear_candidate(task_type: str, role: str, balanced: bool) -> Candidate:
    if task_type == "classification":
        name = "LogisticRegression"
        params = {
            "max_iter": 1000,
            "solver": "lbfgs",
            "class_weight": "balanced" if balanced else None,
            "random_state": SEED,
        }
    else:
        name = "Ridge"
        params = {"alpha": 1.0, "random_state": SEED}
    return Candidate(
        name,
        role,
        task_type,
        params,
        LINEAR_NOTES,
        ("a fast model whose coefficients can be read", "shows how far linear effects go"),
        ("cannot follow effects that are not linear",),
    )


def forest_candidate(task_type: str, role: str, balanced: bool, reason: str) -> Candidate:
    classes = task_type == "classification"
    params: dict[str, object] = {"n_estimators": 300, "max_depth": None, "min_samples_leaf": 2}
    if classes:
        params["class_weight"] = "balanced" if balanced else None
    params["random_state"] = SEED
    return Candidate(
        "RandomForestClassifier" if classes else "RandomForestRegressor",
        role,
        task_type,
        params,
        TREE_NOTES,
        (reason, "needs little tuning and no scaling"),
        ("deep trees can fit noise", "larger and slower than a linear model"),
    )


def boosting_candidate(task_type: str, role: str, reason: str) -> Candidate:
    classes = task_type == "classification"
    return Candidate(
        "HistGradientBoostingClassifier" if classes else "HistGradientBoostingRegressor",
        role,
        task_type,
        {
            "max_iter": 300,
            "learning_rate": 0.05,
            "max_leaf_nodes": 31,
            "l2_regularization": 0.1,
            "random_state": SEED,
        },
        TREE_NOTES,
        (reason, "boosted trees often do best on tables"),
        ("watch the gap between training and test scores",),
    )


def categorical_candidate(task_type: str, role: str, classes: int) -> Candidate:
    if task_type == "classification":
        name = "CategoricalBoostingClassifier"
        loss = "MultiClass" if classes > 2 else "Logloss"
    else:
        name, loss = "CategoricalBoostingRegressor", "RMSE"
    return Candidate(
        name,
        role,
        task_type,
        {
            "iterations": 500,
            "learning_rate": 0.05,
            "depth": 6,
            "loss_function": loss,
            "random_state": SEED,
        },
        ("categories are indexed, not one-hot encoded", "leave identifier columns out"),
        ("many features are categories, which its trees split natively",),
        ("watch for overfitting and leakage",),
    )


def choose_model(facts, task_type: str, classes: int, config: AnalysisConfig) -> Candidate:
    """The first rule that applies names the recommended model."""
    role, balanced = "recommended", bool(facts["has_class_imbalance"])
    if config.prefer_interpretable:
        return linear_candidate(task_type, role, balanced)
    if facts["has_many_categorical_features"] and config.allow_optional_models:
        return categorical_candidate(task_type, role, classes)
    if task_type == "classification" and balanced:
        return forest_candidate(task_type, role, balanced, "can weigh the unbalanced classes")
    if facts["is_mostly_numeric"]:
        return boosting_candidate(task_type, role, "most features are numeric")
    return forest_candidate(task_type, role, balanced, "robust on features of mixed types")


def recommend_models(
    profile: DataFrame,
    quality_issues: DataFrame,
    target_summary: DataFrame,
    target_issues: DataFrame,
    config: AnalysisConfig | None = None,
    facts: DataFrame | None = None,
) -> Recommendation:
    """Candidates in the order to try them, or the reasons that block training."""
    config = config or AnalysisConfig()
    target = target_summary.first()
    if facts is None:
        facts = dataset_facts(profile, target["target_column"], target_issues, config)
    traits = facts.first()
    # A fixed number of rules bounds both issue tables.
    issues = [
        *quality_issues.orderBy("seq").collect(),
        *target_issues.orderBy("seq").collect(),
    ]
    task_type, classes = target["task_type"], target["unique_count"]
    many_categories = traits["has_many_categorical_features"] and not config.allow_optional_models

    warnings = [i["message"] for i in issues]
    if traits["has_text_features"]:
        warnings.append("text columns are not used as features")
    if many_categories:
        warnings.append("many categorical features: boosting on indexed categories may do better")
    warnings = distinct_messages(warnings)

    blocked = [i["message"] for i in issues if i["severity"] == "critical"]
    if blocked:
        return Recommendation("blocked", task_type, None, "low", [], warnings, blocked)

    chosen = choose_model(traits, task_type, classes, config)
    balanced = bool(traits["has_class_imbalance"])
    if chosen.model_name.startswith("HistGradientBoosting"):
        challenger = forest_candidate(task_type, "challenger", balanced, "a challenger of another kind")
    else:
        challenger = boosting_candidate(task_type, "challenger", "a challenger of another kind")
    candidates: dict[str, Candidate] = {}
    for candidate in (chosen, linear_candidate(task_type, "baseline", balanced), challenger):
        candidates.setdefault(candidate.model_name, candidate)

    if many_categories:
        confidence = "medium"
    else:
        confidence = "high" if not issues and traits["feature_count"] > 0 else "medium"
    return Recommendation(
        "ready", task_type, chosen.model_name, confidence, list(candidates.values()), warnings
    )
