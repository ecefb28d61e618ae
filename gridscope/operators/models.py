"""Candidate models on Spark ML: estimators, training loop, saved models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field, replace
from importlib.util import find_spec

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscope.functions.columns import distinct_messages, json_text, quoted
from gridscope.functions.tables import kept, local_table
from gridscope.operators.boosting import HistogramBoosting, Settings
from gridscope.operators.cells import predicted_by_cells
from gridscope.operators.features import (
    FEATURES,
    FeatureColumns,
    Preprocessing,
    class_weights,
    fit_preprocessing,
)
from gridscope.operators.forest import ForestSettings, HistogramForest, HistogramForestModel
from gridscope.operators.metrics import (
    best_experiment,
    classification_metrics,
    generalization_gap,
    multiclass_roc_auc,
    overfitting_risk,
    regression_metrics,
    roc_auc,
    run_status,
)
from gridscope.operators.recommend import Candidate, Recommendation, as_text
from gridscope.operators.split import SplitError, SplitPlan, numbered_copies, plan_split, split_train_test
from gridscope.operators.statistics import fit_target_statistics, order_bucket

# The largest depth Spark's trees accept, the leaf size of the boosted trees,
# the L2 term of those on target statistics, and the share of rows that tells when to stop.
DEEPEST_TREE = 30
BOOSTING_LEAF = 20
STATISTICS_L2 = 3.0
STOPPING_SHARE = 10
#: Learned rows, and leaves of all trees, up to which a forest is Spark's, which takes the cuts of
#: more rows from 10,000 of them and holds all trees on the driver.
SPARK_ROWS, SPARK_LEAVES = 10_000, 20_000
#: Learned rows of a task of Spark's forest. Every task sends histograms of all nodes of a level, so
#: few tasks are less work; more rows are more tasks, and none holds more.
FOREST_ROWS = 250_000

# Columns added for training; the table may well have a `weight` or `label` of its own.
LABEL, WEIGHT, SPLIT, STOPPING, COPY = "__label", "__weight", "__split", "__stopping", "__copy"
STEP = "__step_of_order"


class ModelError(ValueError):
    """No estimator can be built for a candidate."""


@dataclass(frozen=True)
class TrainingFacts:
    """What estimator parameters depend on."""

    rows: int
    classes: int
    label_deviation: float
    max_categories: int
    early_stopping: float | None = None
    slots: dict[int, int] = field(default_factory=dict)
    # Per class what a training row weighs if classes are balanced.
    weights: list[float] = field(default_factory=list)


def _ridge(params: dict, facts: TrainingFacts) -> Estimator:
    # Spark penalises the mean loss of a label scaled to unit deviation. The iteration goes
    # on until it meets the closed form, whatever the number of features.
    return LinearRegression(
        regParam=float(params.get("alpha", 1.0)) * facts.label_deviation / facts.rows,
        elasticNetParam=0.0,
        standardization=False,
        solver="l-bfgs",
        maxIter=1000,
        tol=1e-14,
    )


def _logistic(params: dict, facts: TrainingFacts) -> Estimator:
    # The penalty of one half the squared weights against the summed loss.
    return LogisticRegression(
        regParam=1.0 / (float(params.get("C", 1.0)) * facts.rows),
        elasticNetParam=0.0,
        standardization=False,
    )


def _forest_classifier(params: dict, facts: TrainingFacts) -> Estimator:
    return RandomForestClassifier(
        maxDepth=DEEPEST_TREE, featureSubsetStrategy="sqrt", cacheNodeIds=True, checkpointInterval=10
    )


def _forest_regressor(params: dict, facts: TrainingFacts) -> Estimator:
    return RandomForestRegressor(
        maxDepth=DEEPEST_TREE, featureSubsetStrategy="all", cacheNodeIds=True, checkpointInterval=10
    )


def _own_forest(params: dict, facts: TrainingFacts) -> HistogramForest:
    given = {RENAMED.get(name, name): value for name, value in params.items()}
    settings = ForestSettings(
        facts.classes,
        trees=int(given.get("numTrees", 20)),
        depth=given.get("maxDepth"),
        least_rows=int(given.get("minInstancesPerNode", 1)),
        subset="sqrt" if facts.classes else "all",
        seed=int(given.get("seed") or 0),
        weights=facts.weights if params.get("class_weight") == "balanced" else [],
    )
    return HistogramForest(settings, FEATURES, LABEL, facts.slots)


def _histograms(params: dict, facts: TrainingFacts) -> HistogramBoosting:
    # A split of one category against all others is a split of its one-hot column.
    settings = Settings(
        facts.classes,
        rounds=int(params.get("maxIter", params.get("max_iter", 100))),
        rate=float(params.get("stepSize", params.get("learning_rate", 0.1))),
        leaves=int(params.get("max_leaf_nodes") or 31),
        depth=params.get("maxDepth", params.get("max_depth")),
        l2=float(params.get("l2_regularization", 0.0)),
        least_rows=int(params.get("min_samples_leaf", BOOSTING_LEAF)),
    )
    watched = None if params.get("early_stopping") is False else STOPPING
    return HistogramBoosting(settings, FEATURES, LABEL, watched, facts.slots, facts.early_stopping)


def _statistics(params: dict, facts: TrainingFacts) -> HistogramBoosting:
    # Categories are target statistics, which are numbers; every round is grown unless a
    # tolerance is given.
    depth = int(params.get("maxDepth", params.get("depth", 6)))
    settings = Settings(
        facts.classes,
        rounds=int(params.get("maxIter", params.get("iterations", 500))),
        rate=float(params.get("stepSize", params.get("learning_rate", 0.05))),
        leaves=2**depth,
        depth=depth,
        l2=float(params.get("l2_leaf_reg", STATISTICS_L2)),
        least_rows=int(params.get("min_data_in_leaf", 1)),
    )
    return HistogramBoosting(settings, FEATURES, LABEL, None if facts.early_stopping is None else STOPPING, {}, facts.early_stopping)


# What becomes of a candidate's categories.
ONE_HOT, INDEXED, STATISTICS = "one-hot", "indexed", "statistics"

# Candidate name -> (estimator, what its categories become).
ESTIMATORS: dict[str, tuple[Callable[[dict, TrainingFacts], Estimator | HistogramBoosting], str]] = {
    "LogisticRegression": (_logistic, ONE_HOT),
    "Ridge": (_ridge, ONE_HOT),
    "RandomForestClassifier": (_forest_classifier, ONE_HOT),
    "RandomForestRegressor": (_forest_regressor, ONE_HOT),
    "HistGradientBoostingClassifier": (_histograms, INDEXED),
    "HistGradientBoostingRegressor": (_histograms, INDEXED),
    "CategoricalBoostingClassifier": (_statistics, STATISTICS),
    "CategoricalBoostingRegressor": (_statistics, STATISTICS),
}

# Candidate parameter -> Spark parameter, where they differ by name only.
RENAMED = {
    "n_estimators": "numTrees",
    "min_samples_leaf": "minInstancesPerNode",
    "learning_rate": "stepSize",
    "max_iter": "maxIter",
    "iterations": "maxIter",
    "depth": "maxDepth",
    "max_depth": "maxDepth",
    "random_state": "seed",
}


# What the library's own forests know of the parameters of Spark's.
FOREST_PARAMETERS = ("numTrees", "maxDepth", "minInstancesPerNode", "seed")


def is_own_forest(candidate: Candidate, rows: int) -> bool:
    """Whether a forest over so many learned rows is the library's own."""
    if candidate.model_name not in ("RandomForestClassifier", "RandomForestRegressor"):
        return False
    given = {RENAMED.get(name, name): value for name, value in candidate.params.items() if value is not None}
    if any(hasattr(RandomForestRegressor, name) and name not in FOREST_PARAMETERS for name in given):
        return False
    leaves = min(rows, 2 ** int(given.get("maxDepth", DEEPEST_TREE)))
    return rows > SPARK_ROWS or leaves * int(given.get("numTrees", 20)) > SPARK_LEAVES


def build_estimator(candidate: Candidate, facts: TrainingFacts) -> Estimator | HistogramBoosting | HistogramForest:
    """The estimator of a candidate; parameters that one of Spark ML does not have are dropped."""
    if candidate.model_name not in ESTIMATORS:
        raise ModelError(f"no such model: {candidate.model_name}")
    if is_own_forest(candidate, facts.rows):
        return _own_forest(candidate.params, facts)
    factory, _ = ESTIMATORS[candidate.model_name]
    estimator = factory(candidate.params, facts)
    if isinstance(estimator, HistogramBoosting):
        return estimator
    for name, value in candidate.params.items():
        name = RENAMED.get(name, name)
        if value is None or name == "solver" or not estimator.hasParam(name):
            continue
        estimator.set(estimator.getParam(name), value)
    if candidate.params.get("class_weight") == "balanced":
        estimator.setWeightCol(WEIGHT)
    estimator.setLabelCol(LABEL).setFeaturesCol(FEATURES)
    return estimator


@dataclass
class Training:
    """Result of a training run: tables, and one fitted model per success."""

    status: str
    experiments: DataFrame
    models: dict[int, PipelineModel] = field(default_factory=dict)
    best: dict | None = None
    split: SplitPlan | None = None
    feature_count: int = 0
    features: FeatureColumns | None = None
    test_size: float | int | None = None
    seed: int | None = None
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def summary_table(self, spark: SparkSession, dropped_rows: int = 0) -> DataFrame:
        split, used = self.split, self.features
        return local_table(
            spark,
            [
                (
                    self.status,
                    self.best and self.best["model_name"],
                    self.best and self.best["primary_metric_value"],
                    split and split.train_count,
                    split and split.test_count,
                    self.feature_count,
                    len(used.numeric) if used else 0,
                    len(used.categorical) if used else 0,
                    len(used.boolean) if used else 0,
                    dropped_rows,
                    None if self.test_size is None else float(self.test_size),
                    self.seed,
                    split and split.stratified,
                    self.warnings,
                    self.errors,
                )
            ],
            "status string, best_model string, best_value double, train_rows bigint, "
            "test_rows bigint, feature_count int, numeric_features int, categorical_features int, "
            "boolean_features int, dropped_rows bigint, test_size double, seed bigint, stratified boolean, "
            "warnings array<string>, errors array<string>",
        )


EXPERIMENT = (
    "seq int, model_name string, role string, task_type string, estimator string, status string, "
    "params map<string,string>, train_metrics map<string,double>, test_metrics map<string,double>, "
    "primary_metric_name string, primary_metric_value double, higher_is_better boolean, "
    "train_primary_value double, warnings array<string>, errors array<string>"
)


def experiment_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Experiment rows with the gap between training and test score and its risk."""
    higher = F.col("higher_is_better")
    gap = generalization_gap(F.col("train_primary_value"), F.col("primary_metric_value"), higher)
    return (
        local_table(spark, rows, EXPERIMENT)
        .withColumn("generalization_gap", gap)
        .withColumn("overfitting_risk", overfitting_risk(F.col("generalization_gap"), higher))
    )


def primary_metric(task_type: str) -> tuple[str, bool]:
    return ("f1_macro", True) if task_type == "classification" else ("rmse", False)


def score(predictions: DataFrame, task_type: str, classes: int) -> dict[str, dict[str, float]]:
    """Metrics per split: two rows, whatever the number of predictions."""
    if task_type == "regression":
        tables = [regression_metrics(predictions, LABEL, "prediction", [SPLIT])]
    else:
        if classes == 2:
            positive = (F.col(LABEL) == 1).alias("positive")
            scored = predictions.select(SPLIT, F.col("scores")[1].alias("score"), positive)
            area = roc_auc(scored, "score", "positive", [SPLIT])
        else:
            area = multiclass_roc_auc(predictions, LABEL, "scores", classes, [SPLIT])
        tables = [classification_metrics(predictions, LABEL, "prediction", [SPLIT]), area]
    metrics: dict[str, dict[str, float]] = {"train": {}, "test": {}}
    for table in tables:
        for row in table.drop("row_count").collect():
            values = row.asDict()
            side = values.pop(SPLIT)
            metrics[side].update({k: v for k, v in values.items() if v is not None})
    return metrics


def train_candidates(
    df: DataFrame,
    features: FeatureColumns,
    target: str,
    recommendation: Recommendation,
    key: Sequence[str] | None = None,
    test_size: float | int = 0.2,
    seed: int = 42,
    max_candidates: int | None = None,
    overrides: dict[str, object] | None = None,
    max_train_rows: int | None = None,
    early_stopping: float | None = None,
) -> Training:
    """Split, fit every candidate, score both sides, pick the best.

    `df` holds the feature columns and a target without missing values. A candidate
    that is unavailable is skipped and one that raises is recorded as failed; the
    others still run. `overrides` changes parameters of all candidates. The learners see
    about `max_train_rows` training rows if that is given, chosen by a hash of the whole
    row, key included, and of its number among equal rows; imputation, scaling and
    categories are of all training rows, and scores of all rows. With `early_stopping` boosting ends when a hash-chosen tenth of the training
    rows gains less than that by a further round.
    """
    spark, task_type = df.sparkSession, recommendation.task_type
    nothing = experiment_table(spark, [])
    if not recommendation.is_ready:
        errors = ["the recommendation does not allow training", *recommendation.blocked_reasons]
        return Training("failed", nothing, errors=errors)
    candidates = recommendation.candidates[:max_candidates]
    if not candidates:
        return Training("failed", nothing, errors=["there is no candidate to train"])
    label = target if task_type == "classification" else None
    try:
        plan = plan_split(df, label, test_size)
        rows = split_train_test(df, label, key, test_size, seed, plan=plan, column=SPLIT)
    except SplitError as error:
        return Training("failed", nothing, errors=[f"no split: {error}"])

    if max_train_rows is not None or early_stopping is not None:
        rows = numbered_copies(rows, COPY)
    rows, labels, weights = _with_label(rows, target, task_type)
    with kept(rows) as rows:
        records, models = _run(
            rows, [c for c in rows.columns if c not in (LABEL, WEIGHT)], features, candidates,
            task_type, labels, weights, overrides or {}, plan, seed, max_train_rows, early_stopping,
        )

    experiments = experiment_table(spark, records)
    status = run_status(experiments).first()["run_status"]
    best = best_experiment(experiments).first()
    warnings = distinct_messages([m for record in records for m in record[-2]])
    errors = distinct_messages([m for record in records for m in record[-1]])
    if status == "failed" and not errors:
        errors = ["no candidate completed"]
    return Training(
        status, experiments, models, best.asDict() if best else None, plan, len(features.all),
        features, test_size, seed, warnings, errors,
    )


def _with_label(
    rows: DataFrame, target: str, task_type: str
) -> tuple[DataFrame, list[str], list[float]]:
    """Add class number and weight; numbers follow the sorted labels of all rows."""
    if task_type == "regression":
        columns = {LABEL: F.col(quoted(target)).cast("double"), WEIGHT: F.lit(1.0)}
        return rows.withColumns(columns), [], []
    kind = rows.schema[target].dataType
    value = F.col(quoted(target))
    per_class = rows.groupBy(value.alias("value")).agg(
        F.count_if(F.col(SPLIT) == "train").alias("n")
    )
    # One row per class; a classifier and its label names are on the driver anyway.
    found = per_class.orderBy("value").select("value", json_text(F.col("value"), kind).alias("text"), "n").collect()
    weights = class_weights({i: row["n"] for i, row in enumerate(found)})
    weights = [weights.get(i, 1.0) for i in range(len(found))]
    table = local_table(
        rows.sparkSession,
        [(row["value"], float(i), weights[i]) for i, row in enumerate(found)],
        T.StructType([T.StructField("__class", kind), T.StructField(LABEL, T.DoubleType()), T.StructField(WEIGHT, T.DoubleType())]),
    )
    # Values are joined, not their texts: 0.0 and -0.0 are one class and two texts.
    joined = rows.join(F.broadcast(table), value.eqNullSafe(F.col("__class")))
    return joined.drop("__class"), [row["text"] for row in found], weights


def _run(
    rows, hashed, features, candidates, task_type, labels, weights, overrides, plan, seed,
    max_train_rows, early_stopping,
):
    train = rows.where(F.col(SPLIT) == "train")
    if train.count() != plan.train_count:
        raise ModelError("the training rows are not those of the split")
    pick = F.pmod(F.xxhash64(F.lit(seed), *[F.col(quoted(c)) for c in hashed]), F.lit(1_000_000_007))
    learned = F.lit(True)
    if max_train_rows is not None and max_train_rows < plan.train_count:
        learned = pick < int(1_000_000_007 * max_train_rows / plan.train_count)
    rows = rows.withColumn(STOPPING, pick % STOPPING_SHARE == 0).withColumn("__learned", learned)
    rows = rows.withColumn(STEP, order_bucket(pick))
    # Medians, scaling and categories are of all training rows; only the learner's are bounded.
    train = rows.where(F.col(SPLIT) == "train")
    numbers = train.where("__learned").agg(
        F.count(F.lit(1)).alias("rows"), F.stddev_samp(LABEL).alias("deviation")
    ).first()
    prepared: dict[str, Preprocessing] = {}
    metric, higher = primary_metric(task_type)
    records, models = [], {}
    for seq, candidate in enumerate(candidates):
        candidate = replace(candidate, params={**candidate.params, **overrides})
        estimator_name, status, warnings, errors = None, "success", [], []
        metrics: dict[str, dict[str, float]] = {"train": {}, "test": {}}
        if candidate.requires and find_spec(candidate.requires) is None:
            status = "skipped"
            warnings = [f"{candidate.model_name} skipped: {candidate.requires} is not installed"]
        else:
            try:
                encoding = ESTIMATORS.get(candidate.model_name, (None, ONE_HOT))[1]
                # A split of one category against all others is a split of its one-hot column.
                encoding = INDEXED if is_own_forest(candidate, numbers["rows"]) else encoding
                if encoding not in prepared:
                    prepared[encoding] = fit_preprocessing(
                        train, features, one_hot=encoding == ONE_HOT, encoded=encoding != STATISTICS
                    )
                model, estimator_name, metrics = _fit_one(
                    candidate, rows, prepared[encoding], numbers, task_type, labels, weights, early_stopping
                )
                models[seq] = model
            except Exception as error:
                status, errors = "failed", [f"{candidate.model_name} failed: {error}"]
        records.append(
            (
                seq, candidate.model_name, candidate.role, candidate.task_type, estimator_name,
                status, {k: as_text(v) for k, v in candidate.params.items()},
                metrics["train"], metrics["test"],
                metric if status == "success" else None, metrics["test"].get(metric),
                higher, metrics["train"].get(metric), warnings, errors,
            )
        )
    return records, models


def _fit_one(candidate, rows, preprocessing, numbers, task_type, labels, weights, early_stopping):
    kept_columns = [LABEL, WEIGHT, SPLIT, STOPPING, "__learned"]
    stages, found = list(preprocessing.stages), preprocessing.model().transform(rows)
    learned = (F.col(SPLIT) == "train") & F.col("__learned")
    if preprocessing.categories or preprocessing.numbers:
        found = found.select(*preprocessing.numbers, *preprocessing.categories, *kept_columns, STEP)
        inputs, trained = preprocessing.numbers, found.where(learned)
        if preprocessing.categories:
            statistics, trained = fit_target_statistics(trained, preprocessing.categories, LABEL, len(labels), STEP)
            stages.append(statistics)
            inputs, found = [*inputs, *statistics.outputCols], statistics.transform(found)
        stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="error"))
        vectors, trained = (stages[-1].transform(t).select(FEATURES, *kept_columns) for t in (found, trained))
    else:
        vectors = found.select(FEATURES, *kept_columns)
        trained = vectors.where(learned)
    facts = TrainingFacts(
        numbers["rows"],
        len(labels),
        numbers["deviation"] or 0.0,
        preprocessing.max_categories,
        early_stopping,
        preprocessing.slots,
        weights,
    )
    estimator = build_estimator(candidate, facts)
    forest = isinstance(estimator, (RandomForestClassifier, RandomForestRegressor))
    if forest:
        trained = trained.select(FEATURES, LABEL, WEIGHT, STOPPING).repartition(max(1, -(-numbers["rows"] // FOREST_ROWS)))
        # Rows arrive in any order, and a bootstrap sample follows their order.
        trained = trained.sortWithinPartitions(F.xxhash64(vector_to_array(FEATURES), LABEL, WEIGHT, STOPPING))
    fitted = estimator.fit(trained)

    with _predicted(fitted, vectors, task_type, forest) as predicted:
        metrics = score(predicted, task_type, len(labels))

    stages.append(fitted)
    if task_type == "classification":
        stages.append(
            IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels)
        )
    return PipelineModel(stages), type(estimator).__name__, metrics


@contextmanager
def _predicted(fitted: Model, vectors: DataFrame, task_type: str, forest: bool) -> Iterator[DataFrame]:
    """SPLIT, LABEL, prediction and, for classes, scores of all rows, held for several metrics."""
    outputs = ["prediction"]
    if task_type == "classification":
        outputs.append("probability" if not fitted.hasParam("probabilityCol") or fitted.getProbabilityCol() else "rawPrediction")
    with ExitStack() as held:
        if forest:
            predicted = held.enter_context(contextmanager(predicted_by_cells)(fitted, vectors, FEATURES, [SPLIT, LABEL], outputs))
        elif isinstance(fitted, HistogramForestModel):
            coded = held.enter_context(kept(fitted.coded(vectors, [SPLIT, LABEL])))
            cells = held.enter_context(kept(coded.select("_cell").distinct()))
            predicted = fitted.scored(coded, held.enter_context(kept(fitted.scores(cells))))
        else:
            predicted = fitted.transform(vectors)
        if task_type == "classification":
            predicted = predicted.withColumn("scores", vector_to_array(outputs[1])).drop(outputs[1])
        predicted = predicted.select(SPLIT, LABEL, "prediction", *(["scores"] if task_type == "classification" else [])).persist()
        held.callback(predicted.unpersist)
        yield predicted


def save_models(training: Training, folder: str) -> tuple[list[str], list[str]]:
    """Save each fitted pipeline as `NN_role_model`; returns paths and warnings."""
    paths, warnings = [], []
    for row in training.experiments.where("status = 'success'").orderBy("seq").collect():
        name = f"{row['seq'] + 1:02d}_{row['role']}_{row['model_name']}"
        model = training.models.get(row["seq"])
        if model is None:
            warnings.append(f"{name} has no fitted model")
            continue
        path = f"{folder.rstrip('/')}/{name}"
        try:
            model.write().overwrite().save(path)
            paths.append(path)
        except Exception as error:
            warnings.append(f"{name} could not be saved: {error}")
    return paths, warnings
