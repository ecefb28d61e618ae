"""Thresholds of an analysis run."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values, here and below: the contract of the analysis, in the order the stages use them.
DEFAULT_TARGET_NAMES = ("target", "label", "y", "class", "outcome")


@dataclass(frozen=True)
class AnalysisConfig:
    min_rows: int = 2
    min_columns: int = 1
    target_candidates: tuple[str, ...] = DEFAULT_TARGET_NAMES
    max_classes: int = 20
    preview_rows: int = 5
    sample_values: int = 3
    # Relative error allowed in distinct counts; None counts exactly.
    distinct_error: float | None = None
    high_cardinality_min_unique: int = 50
    high_cardinality_ratio: float = 0.8
    text_min_length: float = 40
    text_min_ratio: float = 0.8
    duplicate_row_warning: float = 0.01
    missing_cell_warning: float = 0.05
    missing_cell_critical: float = 0.50
    possible_id_ratio: float = 0.95
    target_missing_warning: float = 0.0
    imbalance_ratio: float = 5.0
    minority_share: float = 0.10
    high_cardinality_classes: int = 50
    prefer_interpretable: bool = False
    allow_optional_models: bool = False
    test_size: float | int = 0.2
    seed: int = 42
    # A column with more categories is left out of models; None leaves none out. A fitted
    # Spark ML model holds its categories on the driver.
    max_categories: int | None = None
    # At most about so many training rows reach the learners, chosen by hash; None takes all.
    max_train_rows: int | None = None
    # Boosting stops when a tenth of the training rows, chosen by hash, gains less than this
    # per round; None always goes through all rounds.
    early_stopping: float | None = None
