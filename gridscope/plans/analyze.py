"""An analysis run: every stage in turn, stopping where a later one has no ground."""

from __future__ import annotations

import time
import weakref
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridscope.config import AnalysisConfig
from gridscope.functions.columns import distinct_messages
from gridscope.functions.tables import local_table, pin, remove_folder, scratch_folder
from gridscope.operators.profile import column_lists, profile_columns
from gridscope.operators.quality import quality_issues, quality_summary
from gridscope.operators.recommend import Recommendation, dataset_facts, recommend_models
from gridscope.operators.target import (
    TargetError,
    class_distribution,
    numeric_summary,
    target_issues,
    target_summary,
)
from gridscope.operators.task import infer_task
from gridscope.operators.validate import table_counts, validate_table
from gridscope.sources.reader import (
    SEPARATORS,
    LoadError,
    format_of,
    preview_rows,
    read_table,
    source_facts,
)
from gridscope.sources.sink import write_results


@dataclass
class Analysis:
    """The result tables of a run, by name, and what follows from them."""

    run_id: str
    source: str
    status: str
    config: AnalysisConfig
    data: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    recommendation: Recommendation | None = None
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    # Seconds since the epoch.
    started: float | None = None
    ended: float | None = None
    # Removes what the run keeps in the shared folder; nothing to do for a DataFrame.
    close: Callable[[], None] = field(default=lambda: None, repr=False)
    _rows: dict[str, Row] = field(default_factory=dict, repr=False)
    _state: tuple | None = field(default=None, repr=False)

    def row(self, name: str) -> Row | None:
        """The only row of a one-row result table."""
        if name not in self.tables:
            return None
        if name not in self._rows:
            self._rows[name] = self.tables[name].first()
        return self._rows[name]

    @property
    def target(self) -> str | None:
        task = self.row("task")
        return task and task["candidate_target"]

    @property
    def task_type(self) -> str | None:
        task = self.row("task")
        return task and task["task_type"]

    def state(self) -> Row:
        """The readiness flags and the verdict, one row."""
        key = (self.status, *sorted(self.tables))
        if self._state is None or self._state[0] != key:
            spark = SparkSession.active()
            self._state = key, readiness(self._facts(spark)).first()
        return self._state[1]

    def _facts(self, spark: SparkSession) -> DataFrame:
        """What the flags follow from; null where a stage has not run."""
        validation, quality, task = map(self.row, ("validation", "quality_summary", "task"))
        critical = None
        if "target_issues" in self.tables:
            critical = self.tables["target_issues"].where("severity = 'critical'").count()
        plan = self.recommendation
        row = (
            self.status,
            validation and validation["is_valid"],
            quality and quality["is_usable_for_analysis"],
            task and task["status"],
            critical,
            len(plan.candidates) if plan is not None and plan.is_ready else 0,
        )
        return local_table(
            spark,
            [row],
            "status string, valid boolean, usable boolean, task string, critical bigint, candidates int",
        )

    @property
    def is_ready_for_downstream_analysis(self) -> bool:
        return self.state()["ready_for_downstream"]

    @property
    def is_ready_for_model_planning(self) -> bool:
        return self.state()["ready_for_planning"]

    @property
    def requires_target(self) -> bool:
        return self.state()["requires_target"]

    @property
    def is_ready_for_training(self) -> bool:
        return self.state()["ready_for_training"]

    @property
    def verdict(self) -> str:
        return self.state()["verdict"]

    def summary_table(self, spark: SparkSession) -> DataFrame:
        """One row: the run, when it ran, its readiness, warnings and errors."""
        flags = readiness(self._facts(spark)).drop("valid", "usable", "task", "critical", "candidates")
        run = (self.run_id, self.source, self.started, self.ended, self.warnings, self.errors)
        about = local_table(
            spark,
            [run],
            "run_id string, source string, started_at double, ended_at double, "
            "warnings array<string>, errors array<string>",
        )
        # One row each.
        return about.crossJoin(flags).select(
            "run_id",
            "source",
            "status",
            "verdict",
            "ready_for_downstream",
            "ready_for_planning",
            "requires_target",
            "ready_for_training",
            F.timestamp_seconds("started_at").alias("started_at"),
            F.timestamp_seconds("ended_at").alias("ended_at"),
            F.round(F.col("ended_at") - F.col("started_at"), 3).alias("duration_seconds"),
            "warnings",
            "errors",
        )


def readiness(facts: DataFrame) -> DataFrame:
    """The facts of runs with four flags and a verdict.

    A task is needed once the table is valid; planning needs a task whose target has been
    profiled without critical issues; training needs a candidate on top of that.
    """
    sure = lambda condition: F.coalesce(condition, F.lit(False))
    done, known = F.col("status") == "completed", sure(F.col("task") == "ok")
    downstream = done & sure(F.col("valid"))
    planning = downstream & known & F.coalesce("usable", F.lit(True)) & sure(F.col("critical") == 0)
    return facts.withColumns(
        {
            "ready_for_downstream": downstream,
            "requires_target": downstream & sure(F.col("task") != "ok"),
            "ready_for_planning": planning,
            "ready_for_training": planning & (F.col("candidates") > 0),
            "verdict": F.when(~done, "failed")
            .when(~known, "requires_user_input")
            .when(F.col("candidates") > 0, "ready_for_training_approval")
            .otherwise("blocked"),
        }
    )


def analyze_table(
    spark: SparkSession,
    table: DataFrame | str,
    config: AnalysisConfig | None = None,
    target: str | None = None,
    run_id: str = "run",
) -> Analysis:
    """Validate, profile, check quality, find and profile the target, recommend.

    A text file is parsed once: its typed rows are kept as Parquet in the shared folder,
    which every stage and a later training read, until the analysis is closed or gone.

    Small results are computed once and kept as literal tables; the class
    distribution, which grows with the data, stays a query.
    """
    config = config or AnalysisConfig()
    if target is not None:
        config = replace(config, target_candidates=(target,))
    source = table if isinstance(table, str) else "dataframe"
    analysis = Analysis(run_id, source, "completed", config, started=time.time())
    try:
        analysis.data = read_table(spark, table) if isinstance(table, str) else table
        if isinstance(table, str) and format_of(table) in SEPARATORS:
            folder = scratch_folder(spark)
            analysis.close = weakref.finalize(analysis, remove_folder, spark, folder)
            analysis.data.write.parquet(folder)
            analysis.data = spark.read.schema(analysis.data.schema).parquet(folder)
        _run_stages(analysis)
    except LoadError as error:
        analysis.status, analysis.errors = "load_failed", [str(error)]
    except Exception as error:
        analysis.status, analysis.errors = "pipeline_error", [f"analysis failed: {error}"]
        analysis.tables, analysis.recommendation = {}, None
    analysis.ended = time.time()
    return analysis


def _run_stages(analysis: Analysis) -> None:
    df, config, tables = analysis.data, analysis.config, analysis.tables
    counts = pin(table_counts(df))
    tables["table_counts"] = counts
    rows = counts.first()["row_count"]
    tables["source"] = pin(source_facts(df, analysis.source, rows))
    tables["preview"] = preview_rows(df, config.preview_rows)
    tables["validation"] = pin(validate_table(df, config, counts))
    valid = analysis.row("validation")
    if not valid["is_valid"]:
        analysis.status = "validation_failed"
        analysis.errors, analysis.warnings = list(valid["errors"]), list(valid["warnings"])
        return

    profile = pin(profile_columns(df, config))
    tables["column_profile"] = profile
    tables["column_lists"] = column_lists(profile)
    tables["quality_summary"] = pin(quality_summary(df, config, profile, counts))
    tables["quality_issues"] = pin(quality_issues(tables["quality_summary"], config))
    tables["task"] = pin(infer_task(df, config.target_candidates, config.max_classes))

    warnings = [*valid["warnings"], *_issue_lines(tables["quality_issues"])]
    task = analysis.row("task")
    if task["status"] != "ok":
        analysis.warnings = distinct_messages([*warnings, *task["reasons"]])
        return
    target, task_type = task["candidate_target"], task["task_type"]
    try:
        distinct = profile.where(profile["column_name"] == target).first()["unique_count"]
        tables["target_summary"] = pin(target_summary(df, target, task_type, distinct))
    except TargetError as error:
        analysis.warnings = distinct_messages([*warnings, f"no target profile: {error}"])
        return
    tables["target_issues"] = pin(target_issues(tables["target_summary"], config))
    if task_type == "classification":
        tables["class_distribution"] = class_distribution(df, target)
    else:
        tables["numeric_summary"] = pin(numeric_summary(df, target))

    facts = pin(dataset_facts(profile, target, tables["target_issues"], config))
    tables["dataset_facts"] = facts
    found = recommend_models(
        profile, tables["quality_issues"], tables["target_summary"], tables["target_issues"],
        config, facts,
    )
    analysis.recommendation = found
    tables["recommendation"] = found.summary_table(df.sparkSession)
    tables["model_candidates"] = found.candidate_table(df.sparkSession)
    analysis.warnings = distinct_messages(
        [*warnings, *_issue_lines(tables["target_issues"]), *found.warnings]
    )


def _issue_lines(issues: DataFrame) -> list[str]:
    return [f"{i['severity']}: {i['message']}" for i in issues.orderBy("seq").collect()]


def save_analysis(
    spark: SparkSession, analysis: Analysis, folder: str, format: str = "parquet"
) -> list[str]:
    """Write all result tables of a run; failed writes are added to the warnings."""
    tables = {"analysis": analysis.summary_table(spark), **analysis.tables}
    paths, warnings = write_results(tables, folder, analysis.run_id, format)
    analysis.warnings = distinct_messages([*analysis.warnings, *warnings])
    return paths
