"""A training run on top of an analysis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from gridscope.functions.columns import distinct_messages
from gridscope.functions.tables import pin
from gridscope.operators.features import (
    FeatureError,
    feature_columns,
    plan_features,
    select_features,
)
from gridscope.operators.models import ModelError, Training, save_models, train_candidates
from gridscope.plans.analyze import Analysis
from gridscope.sources.sink import write_results

STAGES = ("task", "column_profile", "quality_summary", "target_summary")


@dataclass
class TrainingRun:
    run_id: str
    status: str
    training: Training | None = None
    feature_plan: DataFrame | None = None
    dropped_rows: int = 0
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)


def train_table(
    analysis: Analysis,
    key: Sequence[str] | None = None,
    test_size: float | int | None = None,
    seed: int | None = None,
    max_candidates: int | None = None,
    exclude: Sequence[str] = (),
    overrides: dict[str, object] | None = None,
) -> TrainingRun:
    """Train the recommended candidates of an analysis that is ready for it.

    `key` names columns that identify a row, for a split that never changes;
    `exclude` leaves further columns out; `overrides` changes model parameters.
    """
    run_id = analysis.run_id
    if analysis.verdict != "ready_for_training_approval":
        errors = [f"the analysis is not ready for training: {analysis.verdict}"]
        return TrainingRun(run_id, "not_ready", errors=errors)
    missing = [name for name in STAGES if name not in analysis.tables]
    if analysis.data is None or analysis.recommendation is None or missing:
        errors = ["the analysis is not complete: " + ", ".join(missing or ["data"])]
        return TrainingRun(run_id, "failed", errors=errors)

    config, target, task_type = analysis.config, analysis.target, analysis.task_type
    # The plan looks at the profile of all rows, also those without a target value.
    plan = pin(
        plan_features(
            analysis.tables["column_profile"], target, config,
            possible_ids=analysis.row("quality_summary")["possible_id_columns"],
        )
    )
    summary = analysis.row("target_summary")
    run = TrainingRun(run_id, "failed", feature_plan=plan, dropped_rows=summary["missing_count"])
    try:
        features = feature_columns(plan.where(~plan["column_name"].isin(list(exclude))))
        chosen = select_features(analysis.data, features, target, task_type, keep=key or ())
        run.training = train_candidates(
            chosen, features, target, analysis.recommendation, key,
            config.test_size if test_size is None else test_size,
            config.seed if seed is None else seed,
            max_candidates, overrides, config.max_train_rows, config.early_stopping,
        )
    except (FeatureError, ModelError) as error:
        run.errors = [f"no training data: {error}"]
        return run
    run.status = run.training.status
    run.warnings = distinct_messages([*analysis.warnings, *run.training.warnings])
    run.errors = list(run.training.errors)
    return run


def save_training(
    spark: SparkSession, run: TrainingRun, folder: str, format: str = "parquet"
) -> list[str]:
    """Write feature plan, experiments, summary and models of a run."""
    if run.training is None or run.feature_plan is None:
        raise ValueError("nothing was trained, so there is nothing to write")
    tables = {
        "feature_plan": run.feature_plan,
        "experiments": run.training.experiments,
        "training": run.training.summary_table(spark, run.dropped_rows),
    }
    paths, warnings = write_results(tables, folder, run.run_id, format)
    models, model_warnings = save_models(run.training, f"{folder.rstrip('/')}/models/{run.run_id}")
    run.warnings = distinct_messages([*run.warnings, *warnings, *model_warnings])
    return [*paths, *models]
