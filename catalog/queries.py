"""The registered queries: name -> (Spark query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import oracle
from catalog.tables import columns, load
from gridscope.config import DEFAULT_TARGET_NAMES, AnalysisConfig
from gridscope.functions.columns import quoted
from gridscope.functions.tables import local_table, scratch_folder
from gridscope.operators.features import (
    FeatureColumns,
    class_weight_table,
    fit_preprocessing,
    medians,
    modes,
    plan_features,
    select_features,
)
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
from gridscope.operators.models import Training, save_models, train_candidates
from gridscope.operators.profile import column_lists, profile_columns, sample_values
from gridscope.operators.quality import (
    duplicate_rows,
    possible_id_columns,
    quality_issues,
    quality_summary,
)
from gridscope.operators.recommend import (
    Candidate,
    Recommendation,
    boosting_candidate,
    categorical_candidate,
    dataset_facts,
    forest_candidate,
    linear_candidate,
    recommend_models,
)
from gridscope.operators.split import split_train_test
from gridscope.operators.target import (
    class_distribution,
    numeric_summary,
    target_issues,
    target_summary,
)
from gridscope.operators.task import infer_task
from gridscope.operators.validate import table_counts, validate_table
from gridscope.plans.analyze import analyze_table, save_analysis
from gridscope.plans.report import report_lines
from gridscope.plans.train import save_training, train_table
from gridscope.sources.reader import preview_rows, read_table, source_facts

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        REGISTRY[name] = (query, sql)
        return query

    return add


def plain(df: DataFrame) -> DataFrame:
    """Lists of names as comma-separated text, for comparison with SQL."""
    return df.select(
        *[
            F.array_join(F.col(quoted(f.name)), ",").alias(f.name)
            if f.dataType.simpleString() == "array<string>"
            else F.col(quoted(f.name))
            for f in df.schema
        ]
    )


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


# --- column profile -------------------------------------------------------------------

PROFILED = ["flagged", "customer", "orders", "lineitem", "events", "documents", "pages", "conversations",
            "embeddings", "doclab"]


def _profile(table: str, *names: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = profile_columns(load(spark, folder, table), with_samples=False)
        return found.select(*names) if names else found

    return query


for _table in PROFILED:
    register(f"column_profile_{_table}", oracle.profile(_table))(_profile(_table))

register("column_counts", oracle.column_counts("doclab"))(
    _profile("doclab", "column_name", "non_null_count", "missing_count", "missing_ratio")
)
register("column_distinct", oracle.column_distinct("lineitem"))(
    _profile("lineitem", "column_name", "unique_count", "unique_ratio")
)
register("column_types", oracle.column_types("documents"))(
    _profile("documents", "column_name", "dtype", "inferred_type")
)
for _table in ("part", "supplier"):
    register(f"column_flags_{_table}", oracle.column_flags(_table))(
        _profile(_table, "column_name", "is_constant", "is_all_missing", "is_high_cardinality")
    )


@register("column_lists", oracle.column_lists("documents"))
def column_lists_query(spark: SparkSession, folder: str) -> DataFrame:
    return plain(column_lists(profile_columns(load(spark, folder, "documents"), with_samples=False)))


def _samples(table: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = sample_values(load(spark, folder, table), 3)
        return found.withColumn("sample_values", F.array_join("sample_values", "|"))

    return query


for _table in ("part", "orders", "documents"):
    register(f"column_samples_{_table}", oracle.column_samples(_table))(_samples(_table))


# --- validation and quality -----------------------------------------------------------


def _validation(table: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return plain(
            validate_table(load(spark, folder, table)).select(
                "is_valid", "row_count", "column_count", F.size("errors").alias("error_count"),
                F.size("warnings").alias("warning_count"), "fully_missing_columns",
            )
        )

    return query


for _table in ("hollow", "single", "vacant"):
    register(f"validate_summary_{_table}", oracle.validation(_table))(_validation(_table))

for _table in ("doclab", "doclab_labels", "lineitem", "flagged"):
    register(f"validate_summary_{_table}", oracle.validation(_table))(_validation(_table))
    register(f"missing_cells_{_table}", oracle.table_counts(_table))(
        lambda spark, folder, table=_table: plain(table_counts(load(spark, folder, table)))
    )
    register(f"quality_summary_{_table}", oracle.quality_summary(_table))(
        lambda spark, folder, table=_table: plain(quality_summary(load(spark, folder, table)))
    )
    register(f"quality_issues_{_table}", oracle.quality_issues(_table))(
        lambda spark, folder, table=_table: plain(
            quality_issues(quality_summary(load(spark, folder, table))).drop("message")
        )
    )


DUPLICATES = {
    "lineitem_part": ("lineitem", ["l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"]),
    "documents_text": ("documents", ["text", "lang"]),
    "conversations_role": ("conversations", ["turn", "role"]),
    "embeddings_vector": ("embeddings", ["embedding", "label"]),
}


@register(
    "duplicate_rows",
    " UNION ALL ".join(
        oracle.duplicates(name, ", ".join(names), table) for name, (table, names) in DUPLICATES.items()
    ),
)
def duplicate_rows_query(spark: SparkSession, folder: str) -> DataFrame:
    return union(
        [
            duplicate_rows(load(spark, folder, table).select(*names)).select(
                F.lit(name).alias("input"), "duplicate_row_count"
            )
            for name, (table, names) in DUPLICATES.items()
        ]
    )


def _ids(table: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        profile = profile_columns(load(spark, folder, table), with_samples=False)
        return possible_id_columns(profile).select(
            F.lit(table).alias("table_name"), "column_name", "unique_ratio"
        )

    return query


for _table in ("supplier", "events", "documents", "embeddings"):
    register(f"possible_ids_{_table}", oracle.possible_ids(_table))(_ids(_table))


# --- task and target --------------------------------------------------------------------

TASKS = [("embeddings", "label"), ("doclab", "quality"), ("orders", "o_totalprice"),
         ("part", "p_size"), ("lineitem", "l_linenumber"), ("lineitem", "l_quantity")]


@register("task_inference", " UNION ALL ".join(oracle.task(*pair) for pair in TASKS))
def task_inference(spark: SparkSession, folder: str) -> DataFrame:
    return union(
        [
            infer_task(load(spark, folder, table), [target]).select(
                F.lit(table).alias("input"), "candidate_target", "task_type", "status"
            )
            for table, target in TASKS
        ]
    )


for _table, _target in (("events", "event_type"), ("lineitem", "l_returnflag"), ("orders", "o_custkey")):
    register(f"class_distribution_{_target}", oracle.class_distribution(_table, _target))(
        lambda spark, folder, table=_table, target=_target: class_distribution(
            load(spark, folder, table), target
        )
    )

for _table, _target in (("doclab", "quality"), ("doclab", "toxic"), ("part", "p_brand"), ("orders", "o_custkey")):
    register(f"target_classes_{_target}", oracle.target_classes(_table, _target))(
        lambda spark, folder, table=_table, target=_target: target_summary(
            load(spark, folder, table), target, "classification"
        ).drop("invalid_numeric_count", "numeric_count", "is_constant_number")
    )
    register(f"target_issues_{_target}", oracle.class_issues(_table, _target))(
        lambda spark, folder, table=_table, target=_target: plain(
            target_issues(
                target_summary(load(spark, folder, table), target, "classification")
            ).drop("message")
        )
    )

for _table, _target in (("orders", "o_totalprice"), ("lineitem", "l_extendedprice"), ("events", "value"), ("part", "p_size")):
    register(f"numeric_summary_{_target}", oracle.numeric_summary(_table, _target))(
        lambda spark, folder, table=_table, target=_target: numeric_summary(
            load(spark, folder, table), target
        ).select(F.lit(f"{table}.{target}").alias("input"), "*")
    )


# The values in the JSON texts, whole, with one more that is no number.
VALUES_SQL = r"SELECT regexp_extract(props, ':\s*([^,}]*)', 1) AS s FROM events UNION ALL SELECT event_type FROM events"


@register(
    "coerce_numeric",
    f"""SELECT count(*) AS row_count, count(*) - count(x) AS invalid_numeric_count, count(x) AS numeric_count,
    count(DISTINCT s) AS unique_count, count(DISTINCT x) = 1 AS is_constant_number
    FROM (SELECT s, TRY_CAST(s AS DOUBLE) AS x FROM ({VALUES_SQL}))""",
)
def coerce_numeric(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    text = events.select(F.regexp_extract("props", r":\s*([^,}]*)", 1).alias("s"))
    text = text.union(events.select("event_type"))
    return target_summary(text, "s", "regression").select(
        "row_count", "invalid_numeric_count", "numeric_count", "unique_count", "is_constant_number"
    )


@register(
    "numeric_issues",
    f"""SELECT CASE WHEN count(x) < count(s) THEN 'non_numeric_regression_target' END AS code, 'critical' AS severity
    FROM (SELECT s, TRY_CAST(s AS DOUBLE) AS x FROM ({VALUES_SQL}))""",
)
def numeric_issues(spark: SparkSession, folder: str) -> DataFrame:
    events = load(spark, folder, "events")
    text = events.select(F.regexp_extract("props", r":\s*([^,}]*)", 1).alias("s"))
    text = text.union(events.select("event_type"))
    return target_issues(target_summary(text, "s", "regression")).select("code", "severity")


def _status_sql(name: str, sql: str) -> str:
    """Status by the number of columns that are named like a target."""
    names = ", ".join(f"'{n}'" for n in DEFAULT_TARGET_NAMES)
    return (
        f"SELECT '{name}' AS input, CASE WHEN k = 0 THEN 'not_found' WHEN k > 1 THEN 'ambiguous' ELSE 'ok' END AS status, k = 1 AS named "
        f"FROM (SELECT count(*) AS k FROM (DESCRIBE {sql}) WHERE lower(column_name) IN ({names}))"
    )


@register(
    "task_statuses",
    _status_sql("customer", "SELECT * FROM customer")
    + " UNION ALL " + _status_sql("two names", "SELECT quality AS target, toxic AS label FROM labels")
    + " UNION ALL SELECT 'all missing', CASE WHEN count(nothing) = 0 THEN 'ambiguous' ELSE 'ok' END, true "
    f"FROM ({oracle.source_sql('flagged')})",
)
def task_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """No target-like column, two of them, one without any value."""
    two = load(spark, folder, "labels").withColumnsRenamed({"quality": "target", "toxic": "label"})
    found = [
        ("customer", infer_task(load(spark, folder, "customer"))),
        ("two names", infer_task(two)),
        ("all missing", infer_task(load(spark, folder, "flagged"), ["nothing"])),
    ]
    return union(
        [
            table.select(F.lit(name).alias("input"), "status", F.col("candidate_target").isNotNull().alias("named"))
            for name, table in found
        ]
    )


# --- recommendation -----------------------------------------------------------------------

PLANNED = [
    ("embeddings", "label", "classification"),
    ("doclab", "quality", "classification"),
    ("orders", "o_totalprice", "regression"),
    ("lineitem", "l_returnflag", "classification"),
    ("part", "p_retailprice", "regression"),
]


def _inputs(spark: SparkSession, folder: str, table: str, target: str, task_type: str):
    df = load(spark, folder, table)
    profile = profile_columns(df, with_samples=False)
    summary = target_summary(df, target, task_type)
    return df, profile, summary, target_issues(summary)


def _facts(table: str, target: str, task_type: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        _, profile, _, issues = _inputs(spark, folder, table, target, task_type)
        return plain(dataset_facts(profile, target, issues))

    return query


def _candidates(table: str, target: str, task_type: str, optional: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        config = AnalysisConfig(allow_optional_models=optional)
        df, profile, summary, issues = _inputs(spark, folder, table, target, task_type)
        found = recommend_models(
            profile, quality_issues(quality_summary(df, config, profile), config), summary, issues, config
        )
        return found.candidate_table(spark).select("seq", "model_name", "role")

    return query


for _table, _target, _task in PLANNED:
    register(f"dataset_facts_{_table}", oracle.dataset_facts(_table, _target, _task))(
        _facts(_table, _target, _task)
    )
    register(f"model_candidates_{_table}", oracle.candidates(_table, _target, _task))(
        _candidates(_table, _target, _task, False)
    )
register("model_candidates_optional", oracle.candidates("lineitem", "l_returnflag", "classification", True))(
    _candidates("lineitem", "l_returnflag", "classification", True)
)


RECOMMENDED = [("embeddings", "label"), ("doclab", "quality"), ("lineitem", "l_returnflag"), ("orders", "o_orderstatus"), ("flagged", "fixed")]


def _recommended(spark: SparkSession, folder: str, table: str, target: str) -> Recommendation:
    config = AnalysisConfig()
    df, profile, summary, issues = _inputs(spark, folder, table, target, "classification")
    return recommend_models(profile, quality_issues(quality_summary(df, config, profile), config), summary, issues, config)


@register("recommendations", " UNION ALL ".join(f"SELECT * FROM ({oracle.recommendation(*pair)})" for pair in RECOMMENDED))
def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    """Ready and blocked recommendations, with confidence and numbers of warnings."""
    found = [(f"{table}.{target}", _recommended(spark, folder, table, target)) for table, target in RECOMMENDED]
    return union(
        [
            plan.summary_table(spark).select(
                F.lit(name).alias("input"), "status", "recommended_model", "confidence", F.size("warnings").alias("warning_count"),
                F.size("blocked_reasons").alias("blocked_count"), F.lit(len(plan.candidates)).alias("candidate_count"),
            )
            for name, plan in found
        ]
    )


@register("candidate_parameters", " UNION ALL ".join(f"SELECT * FROM ({oracle.parameters(*pair)})" for pair in RECOMMENDED[1:4]))
def candidate_parameters(spark: SparkSession, folder: str) -> DataFrame:
    return union(
        [
            _recommended(spark, folder, table, target).candidate_table(spark).select(
                F.lit(f"{table}.{target}").alias("input"), "seq", "role", "model_name", F.explode("params").alias("parameter", "value")
            )
            for table, target in RECOMMENDED[1:4]
        ]
    )


# --- features and split ---------------------------------------------------------------------

for _table, _target in (("events", "event_type"), ("doclab", "quality"), ("lineitem", "l_returnflag")):
    register(f"feature_plan_{_table}", oracle.feature_plan(_table, _target))(
        lambda spark, folder, table=_table, target=_target: plan_features(
            profile_columns(load(spark, folder, table), with_samples=False), target
        ).drop("unique_count")
    )

MEDIANS = [("doclab", ["n_chars", "quality", "toxic"]), ("lineitem", ["l_quantity", "l_extendedprice", "l_discount"])]


@register("impute_median", " UNION ALL ".join(oracle.medians(*pair) for pair in MEDIANS))
def impute_median(spark: SparkSession, folder: str) -> DataFrame:
    found = [pair for table, names in MEDIANS for pair in medians(load(spark, folder, table), names).items()]
    return local_table(spark, found, "column_name string, median double")


MODES = [("doclab", ["lang", "source", "quality"]), ("orders", ["o_orderpriority", "o_custkey"])]


@register("impute_mode", " UNION ALL ".join(oracle.modes(*pair) for pair in MODES))
def impute_mode(spark: SparkSession, folder: str) -> DataFrame:
    return union([modes(load(spark, folder, table), names) for table, names in MODES])


@register("standard_scale", oracle.scaled("part", "p_partkey", ["p_retailprice", "p_size"]))
def standard_scale(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "part")
    fitted = fit_preprocessing(df, FeatureColumns(["p_retailprice", "p_size"], [], []))
    return fitted.model().transform(df).select(
        "p_partkey",
        F.round("__num_0", 6).alias("p_retailprice"),
        F.round("__num_1", 6).alias("p_size"),
    )


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("one_hot", oracle.one_hot("customer", "c_custkey", "c_mktsegment", SEGMENTS))
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "customer")
    fitted = fit_preprocessing(df, FeatureColumns([], ["c_mktsegment"], []))
    vector = vector_to_array("__features")
    return fitted.model().transform(df).select(
        "c_custkey", *[vector[i].cast("int").alias(f"slot_{i}") for i in range(len(SEGMENTS))]
    )


@register("split_plain", oracle.split("orders", "o_orderkey", None))
def split_plain(spark: SparkSession, folder: str) -> DataFrame:
    return split_train_test(load(spark, folder, "orders"), None, ["o_orderkey"]).select("o_orderkey", "split")


@register("split_stratified", oracle.split("orders", "o_orderkey", "o_orderstatus"))
def split_stratified(spark: SparkSession, folder: str) -> DataFrame:
    return split_train_test(load(spark, folder, "orders"), "o_orderstatus", ["o_orderkey"]).select(
        "o_orderkey", "split"
    )


@register("split_labels", oracle.split("doclab", "doc_id", "quality"))
def split_labels(spark: SparkSession, folder: str) -> DataFrame:
    df = load(spark, folder, "doclab").where("quality IS NOT NULL")
    return split_train_test(df, "quality", ["doc_id"]).select("doc_id", "split")


@register("class_weights", oracle.weights("labels", "quality"))
def class_weights_query(spark: SparkSession, folder: str) -> DataFrame:
    return class_weight_table(load(spark, folder, "labels"), "quality")


# --- metrics --------------------------------------------------------------------------------

FLAG_PAIRS = "SELECT l_returnflag AS y, CASE WHEN l_quantity > 25 THEN 'R' WHEN l_discount > 0.05 THEN 'N' ELSE 'Z' END AS p FROM lineitem"


def _flags(spark: SparkSession, folder: str) -> DataFrame:
    guess = F.when(F.col("l_quantity") > 25, "R").when(F.col("l_discount") > 0.05, "N").otherwise("Z")
    return load(spark, folder, "lineitem").select(F.col("l_returnflag").alias("y"), guess.alias("p"))


@register("metrics_classification", oracle.classification(FLAG_PAIRS))
def metrics_classification(spark: SparkSession, folder: str) -> DataFrame:
    return classification_metrics(_flags(spark, folder), "y", "p")


@register("metrics_regression", oracle.regression("SELECT p_retailprice AS y, 900.0 + p_size AS p FROM part"))
def metrics_regression(spark: SparkSession, folder: str) -> DataFrame:
    pairs = load(spark, folder, "part").select(
        F.col("p_retailprice").alias("y"), (F.lit(900.0) + F.col("p_size")).alias("p")
    )
    return regression_metrics(pairs, "y", "p")


@register("auc_binary", oracle.auc("SELECT l_returnflag = 'R' AS y, l_extendedprice AS s, l_linestatus FROM lineitem", "l_linestatus"))
def auc_binary(spark: SparkSession, folder: str) -> DataFrame:
    scored = load(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").alias("y"), F.col("l_extendedprice").alias("s"), "l_linestatus"
    )
    return roc_auc(scored, "s", "y", ["l_linestatus"])


AUC_CLASSES = (
    "SELECT c, y = c AS y, CASE c WHEN 0 THEN l_discount WHEN 1 THEN l_tax ELSE l_quantity / 50 END AS s FROM "
    "(SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y FROM lineitem), "
    "(VALUES (0), (1), (2)) v(c)"
)


@register("auc_multiclass", f"SELECT round(avg(roc_auc), 6) AS roc_auc FROM ({oracle.auc(AUC_CLASSES, 'c')})")
def auc_multiclass(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.col("l_returnflag")
    scored = load(spark, folder, "lineitem").select(
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("y"),
        F.array("l_discount", "l_tax", F.col("l_quantity") / 50).alias("scores"),
    )
    return multiclass_roc_auc(scored, "y", "scores", 3)


# Experiments made from the data: guesses of three qualities, scored per line status.
GUESSES = {0: "l_extendedprice / 1500.0", 1: "25.0", 2: "l_quantity + 0.5"}
EXPERIMENTS_SQL = "WITH e AS (" + " UNION ALL ".join(
    f"SELECT {seq} AS seq, round(sqrt(avg(CASE WHEN l_linestatus = 'F' THEN (l_quantity - ({p})) ** 2 END)), 6) AS tr, "
    f"round(sqrt(avg(CASE WHEN l_linestatus = 'O' THEN (l_quantity - ({p})) ** 2 END)), 6) AS te FROM lineitem"
    for seq, p in GUESSES.items()
) + "), g AS (SELECT seq, tr AS train_value, te AS test_value, round((te - tr) / abs(tr), 6) AS gap FROM e) "


def _experiments(spark: SparkSession, folder: str) -> DataFrame:
    lines = load(spark, folder, "lineitem")
    scored = [
        regression_metrics(
            lines.withColumn("p", F.expr(p)), "l_quantity", "p", ["l_linestatus"]
        ).select(F.lit(seq).alias("seq"), "l_linestatus", "rmse")
        for seq, p in GUESSES.items()
    ]
    side = {"train_value": "F", "test_value": "O"}
    return union(scored).groupBy("seq").agg(
        *[F.max(F.when(F.col("l_linestatus") == s, F.col("rmse"))).alias(n) for n, s in side.items()]
    )


@register(
    "gap_and_risk",
    EXPERIMENTS_SQL + "SELECT *, CASE WHEN gap IS NULL THEN 'unknown' WHEN gap <= 0 THEN 'low' "
    "WHEN gap >= 0.30 THEN 'high' WHEN gap >= 0.15 THEN 'medium' ELSE 'low' END AS risk FROM g",
)
def gap_and_risk(spark: SparkSession, folder: str) -> DataFrame:
    lower = F.lit(False)
    found = _experiments(spark, folder).withColumn(
        "gap", generalization_gap(F.col("train_value"), F.col("test_value"), lower)
    )
    return found.withColumn("risk", overfitting_risk(F.col("gap"), lower))


SCORES_SQL = "WITH s AS (SELECT seq, l_linestatus, round(avg(CAST(l_returnflag = p AS INT)), 6) AS accuracy FROM (" + " UNION ALL ".join(
    f"SELECT {seq} AS seq, l_linestatus, l_returnflag, {guess} AS p FROM lineitem"
    for seq, guess in enumerate(("'N'", "CASE WHEN l_quantity > 25 THEN 'R' ELSE 'A' END", "CASE WHEN l_linestatus = 'F' THEN l_returnflag ELSE 'N' END"))
) + """) GROUP BY 1, 2), e AS (SELECT seq, max(accuracy) FILTER (l_linestatus = 'F') AS train_value, max(accuracy) FILTER (l_linestatus = 'O') AS test_value FROM s GROUP BY 1),
g AS (SELECT *, round(train_value - test_value, 6) AS gap FROM e)
SELECT *, CASE WHEN gap IS NULL THEN 'unknown' WHEN gap <= 0 THEN 'low' WHEN gap >= 0.15 THEN 'high' WHEN gap >= 0.07 THEN 'medium' ELSE 'low' END AS risk FROM g"""


@register("gap_and_risk_of_scores", SCORES_SQL)
def gap_and_risk_of_scores(spark: SparkSession, folder: str) -> DataFrame:
    """As gap_and_risk, where more is better: one guess knows the classes of the training side."""
    lines, flag = load(spark, folder, "lineitem"), F.col("l_returnflag")
    guesses = [F.lit("N"), F.when(F.col("l_quantity") > 25, "R").otherwise("A"), F.when(F.col("l_linestatus") == "F", flag).otherwise("N")]
    scored = [
        classification_metrics(lines.select("l_linestatus", flag.alias("y"), p.alias("p")), "y", "p", ["l_linestatus"]).select(F.lit(k).alias("seq"), "l_linestatus", "accuracy")
        for k, p in enumerate(guesses)
    ]
    value = lambda side: F.max(F.when(F.col("l_linestatus") == side, F.col("accuracy")))
    found = union(scored).groupBy("seq").agg(value("F").alias("train_value"), value("O").alias("test_value"))
    found = found.withColumn("gap", generalization_gap(F.col("train_value"), F.col("test_value"), F.lit(True)))
    return found.withColumn("risk", overfitting_risk(F.col("gap"), F.lit(True)))


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _experiments(spark, folder).select(
        "seq",
        F.when(F.col("test_value") > 20, "failed").otherwise("success").alias("status"),
        F.col("test_value").alias("primary_metric_value"),
        F.lit(False).alias("higher_is_better"),
    )


@register(
    "best_experiment",
    EXPERIMENTS_SQL + "SELECT seq, test_value AS primary_metric_value FROM g WHERE test_value <= 20 "
    "ORDER BY test_value, seq LIMIT 1",
)
def best_experiment_query(spark: SparkSession, folder: str) -> DataFrame:
    return best_experiment(_outcomes(spark, folder)).select("seq", "primary_metric_value")


@register(
    "run_status",
    EXPERIMENTS_SQL + "SELECT CASE WHEN count(*) FILTER (WHERE test_value <= 20) = 0 THEN 'failed' "
    "WHEN count(*) FILTER (WHERE test_value <= 20) = count(*) THEN 'completed' "
    "ELSE 'completed_with_failures' END AS run_status, count(*) AS experiments, "
    "count(*) FILTER (WHERE test_value <= 20) AS succeeded, CAST(0 AS BIGINT) AS skipped, "
    "count(*) FILTER (WHERE test_value > 20) AS failed FROM g",
)
def run_status_query(spark: SparkSession, folder: str) -> DataFrame:
    return run_status(_outcomes(spark, folder))


# --- models ---------------------------------------------------------------------------------

def _train(
    spark: SparkSession, folder: str, table: str, target: str, features: FeatureColumns,
    candidate: Candidate, key: list[str], overrides: dict | None = None, **learning: object,
) -> Training:
    data = select_features(
        load(spark, folder, table), features, target, candidate.task_type, keep=key
    )
    wanted = Recommendation("ready", candidate.task_type, candidate.model_name, "high", [candidate])
    return train_candidates(data, features, target, wanted, key, overrides=overrides, **learning)


def _scores(training: Training) -> DataFrame:
    if training.errors:
        raise RuntimeError("; ".join(training.errors))
    sides = [
        training.experiments.select(
            F.lit(side).alias("split"), F.explode(f"{side}_metrics").alias("metric", "value")
        )
        for side in ("train", "test")
    ]
    return union(sides)


@register(
    "train_ridge",
    "SELECT split, metric, value FROM (SELECT split, mae, rmse, r2 FROM ("
    + oracle.ridge("lineitem", "CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)", "l_quantity", "l_extendedprice")
    + ")) UNPIVOT (value FOR metric IN (mae, rmse, r2))",
)
def train_ridge(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(
        _train(
            spark, folder, "lineitem", "l_extendedprice", FeatureColumns(["l_quantity"], [], []),
            linear_candidate("regression", "baseline", False),
            ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
        )
    )


LINE_FEATURES = FeatureColumns(["l_quantity", "l_extendedprice", "l_discount"], ["l_linestatus"], [])
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@register("train_logistic", None)
def train_logistic(spark: SparkSession, folder: str) -> DataFrame:
    candidate = linear_candidate("classification", "baseline", True)
    return _scores(
        _train(spark, folder, "lineitem", "l_returnflag", LINE_FEATURES, candidate, LINE_KEY)
    )


@register("train_forest", None)
def train_forest(spark: SparkSession, folder: str) -> DataFrame:
    candidate = forest_candidate("classification", "recommended", True, "")
    return _scores(
        _train(spark, folder, "lineitem", "l_returnflag", LINE_FEATURES, candidate, LINE_KEY)
    )


@register("train_forest_regression", None)
def train_forest_regression(spark: SparkSession, folder: str) -> DataFrame:
    candidate = forest_candidate("regression", "recommended", False, "")
    features = FeatureColumns(["p_size"], ["p_brand", "p_type"], [])
    return _scores(
        _train(spark, folder, "part", "p_retailprice", features, candidate, ["p_partkey"])
    )


@register("train_gbt", None)
def train_gbt(spark: SparkSession, folder: str) -> DataFrame:
    candidate = boosting_candidate("classification", "recommended", "")
    features = FeatureColumns(["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"], [])
    return _scores(
        _train(spark, folder, "lineitem", "l_linestatus", features, candidate, LINE_KEY)
    )


@register("train_gbt_regression", None)
def train_gbt_regression(spark: SparkSession, folder: str) -> DataFrame:
    candidate = boosting_candidate("regression", "recommended", "")
    features = FeatureColumns(["o_custkey"], ["o_orderstatus", "o_orderpriority"], [])
    return _scores(
        _train(spark, folder, "orders", "o_totalprice", features, candidate, ["o_orderkey"])
    )


@register("train_categorical_boosting", None)
def train_categorical_boosting(spark: SparkSession, folder: str) -> DataFrame:
    candidate = categorical_candidate("classification", "recommended", 3)
    features = FeatureColumns(["o_totalprice"], ["o_orderpriority"], [])
    return _scores(
        _train(spark, folder, "orders", "o_orderstatus", features, candidate, ["o_orderkey"])
    )


# Trainings whose scores follow from counts and means of one category. A weak penalty, or
# trees that take whole steps, leave the class shares and means of each band.
LINE_KEY_SQL = " || '|' || ".join(f"CAST({name} AS VARCHAR)" for name in LINE_KEY)
BAND = FeatureColumns([], ["band"], [])
FEW = {"numTrees": 20, "maxDepth": 5, "maxIter": 5}


def _majority(candidate: Candidate, overrides: dict) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        training = _train(spark, folder, "banded", "size", BAND, candidate, LINE_KEY, overrides)
        return _scores(training).where("metric != 'roc_auc'")

    return query


MAJORITY = oracle.group_majority("banded", LINE_KEY_SQL, "band", "size")
register("train_logistic_shares", MAJORITY)(
    _majority(linear_candidate("classification", "baseline", False), {"regParam": 1e-9, "maxIter": 300})
)
register("train_forest_majority", MAJORITY)(
    _majority(forest_candidate("classification", "recommended", False, ""), FEW)
)
register("train_gbt_majority", MAJORITY)(
    _majority(boosting_candidate("classification", "recommended", ""), {})
)
register("train_categorical_majority", MAJORITY)(
    _majority(categorical_candidate("classification", "recommended", 2), {})
)


@register("train_gbt_group_means", oracle.group_means("banded", LINE_KEY_SQL, "band", "l_extendedprice"))
def train_gbt_group_means(spark: SparkSession, folder: str) -> DataFrame:
    candidate = boosting_candidate("regression", "recommended", "")
    # Whole steps on all rows, so the sums of the steps are the means.
    overrides = {"learning_rate": 1.0, "early_stopping": False}
    return _scores(
        _train(spark, folder, "banded", "l_extendedprice", BAND, candidate, LINE_KEY, overrides)
    )


@register(
    "train_forest_beats_mean",
    "SELECT count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) AS train_rows, "
    "CAST(ceil(count(*) * 0.2) AS BIGINT) AS test_rows, true AS beats_mean FROM lineitem",
)
def train_forest_beats_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the forest explains test rows better than their mean does, which has an R2 of 0."""
    candidate = forest_candidate("regression", "recommended", False, "")
    training = _train(spark, folder, "banded", "l_quantity", BAND, candidate, LINE_KEY, FEW)
    sizes = training.summary_table(spark).select("train_rows", "test_rows")
    r2 = training.experiments.select((F.col("test_metrics")["r2"] > 0.05).alias("beats_mean"))
    # One row each.
    return sizes.crossJoin(r2)


@register(
    "candidate_outcomes",
    "WITH r AS (" + oracle.ridge("part", "CAST(p_partkey AS VARCHAR)", "p_size", "p_retailprice") + """)
SELECT 0 AS seq, 'Other' AS model_name, 'skipped' AS status, CAST(NULL AS VARCHAR) AS primary_metric_name, CAST(NULL AS DOUBLE) AS primary_metric_value, 1 AS warning_count, 0 AS error_count, false AS best
UNION ALL SELECT 1, 'Ridge', 'success', 'rmse', rmse, 0, 0, true FROM r WHERE split = 'test'
UNION ALL SELECT 2, 'Unknown', 'failed', NULL, NULL, 0, 1, false""",
)
def candidate_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """A candidate whose package is missing, one that fits, one that nothing is known of."""
    features = FeatureColumns(["p_size"], [], [])
    data = select_features(load(spark, folder, "part"), features, "p_retailprice", "regression", keep=["p_partkey"])
    wanted = Recommendation(
        "ready", "regression", "Ridge", "high",
        [
            Candidate("Other", "recommended", "regression", {}, requires="no_such_package"),
            linear_candidate("regression", "baseline", False),
            Candidate("Unknown", "challenger", "regression", {}),
        ],
    )
    training = train_candidates(data, features, "p_retailprice", wanted, ["p_partkey"])
    return training.experiments.select(
        "seq", "model_name", "status", "primary_metric_name", "primary_metric_value", F.size("warnings").alias("warning_count"),
        F.size("errors").alias("error_count"), (F.col("seq") == training.best["seq"]).alias("best"),
    )


@register("model_sink", oracle.ridge_predictions("part", "p_partkey", "p_size", "p_retailprice"))
def model_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Train, save, load, predict the whole table."""
    candidate = linear_candidate("regression", "baseline", False)
    features = FeatureColumns(["p_size"], [], [])
    training = _train(spark, folder, "part", "p_retailprice", features, candidate, ["p_partkey"])
    paths, _ = save_models(training, scratch_folder(spark))
    predicted = PipelineModel.load(paths[0]).transform(load(spark, folder, "part"))
    return predicted.select("p_partkey", F.round("prediction", 4).alias("predicted"))


# --- sources, sinks, runs ------------------------------------------------------------------


def _text_scan(table: str, format: str, separator: str) -> Query:
    """Write a table as text with `NA` for missing cells, read it back, profile it."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = load(spark, folder, table)
        path = f"{scratch_folder(spark)}/{table}.{format}"
        df.select(
            *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t == "timestamp_ntz" else F.col(c)
              for c, t in df.dtypes]
        ).write.csv(
            path, sep=separator, header=True, nullValue="NA", quote='"', escape='"',
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
        read = read_table(spark, path, format)
        found = profile_columns(read, with_samples=False)
        return found.select("position", "column_name", "dtype", "non_null_count", "unique_count")

    return query


def _text_scan_sql(table: str) -> str:
    kept = {"int": "bigint", "timestamp_ntz": "string"}
    parts = [
        f"SELECT {i} AS position, '{name}' AS column_name, '{kept.get(dtype, dtype)}' AS dtype, "
        f"count({name}) AS non_null_count, count(DISTINCT {name}) AS unique_count FROM ({oracle.source_sql(table)})"
        for i, (name, dtype) in enumerate(columns(table))
    ]
    return " UNION ALL ".join(parts)


register("csv_scan", _text_scan_sql("orders"))(_text_scan("orders", "csv", ","))
register("csv_scan_line_breaks", _text_scan_sql("doclab"))(_text_scan("doclab", "csv", ","))
register("tsv_scan", _text_scan_sql("customer"))(_text_scan("customer", "tsv", "\t"))


@register(
    "source_facts",
    "SELECT 'orders.parquet' AS file_name, '.parquet' AS file_extension, count(*) AS row_count, "
    "CAST(6 AS BIGINT) AS column_count, "
    "'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS column_names FROM orders",
)
def source_facts_query(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/orders.parquet"
    return plain(source_facts(read_table(spark, path), path))


@register(
    "preview_rows",
    "SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS INT) AS seq, "
    """'{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || """
    """',"c_acctbal":' || c_acctbal || ',"c_mktsegment":"' || c_mktsegment || '"}' AS row_json """
    "FROM customer ORDER BY c_custkey LIMIT 5",
)
def preview(spark: SparkSession, folder: str) -> DataFrame:
    return preview_rows(load(spark, folder, "customer"), 5)


ANALYZED = [("supplier", None), ("embeddings", None), ("orders", "o_totalprice"), ("doclab", "quality")]


def _run_sql(table: str, target: str | None, task_type: str | None) -> str:
    """Status, verdict and flags of a run, from counts of table and target."""
    name = "NULL" if target is None else f"'{target}'"
    kinds = "" if target is None else f", count(DISTINCT {target}) AS k, count({target}) AS n"
    verdict = (
        "'requires_user_input'" if target is None
        else "CASE WHEN n = 0 THEN 'requires_user_input' WHEN k = 1 THEN 'blocked' ELSE 'ready_for_training_approval' END"
    )
    ready = "false" if target is None else "k > 1"
    missing = "true" if target is None else "n = 0"
    task = "NULL" if task_type is None else f"'{task_type}'"
    return (
        f"SELECT '{table}' AS input, CASE WHEN c >= 2 THEN 'completed' ELSE 'validation_failed' END AS status, "
        f"{verdict} AS verdict, CAST({name} AS VARCHAR) AS target, CAST({task} AS VARCHAR) AS task_type, "
        f"{missing} AS requires_target, {ready} AS ready_for_training "
        f"FROM (SELECT count(*) AS c{kinds} FROM ({oracle.source_sql(table)}))"
    )


@register(
    "analysis_runs",
    " UNION ALL ".join(
        [
            _run_sql("supplier", None, None),
            _run_sql("embeddings", "label", "classification"),
            _run_sql("orders", "o_totalprice", "regression"),
            _run_sql("doclab", "quality", "classification"),
        ]
    ),
)
def analysis_runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = []
    for table, target in ANALYZED:
        run = analyze_table(spark, load(spark, folder, table), target=target)
        rows.append(
            (table, run.status, run.verdict, run.target, run.task_type, run.requires_target,
             run.is_ready_for_training)
        )
    return local_table(
        spark, rows,
        "input string, status string, verdict string, target string, task_type string, "
        "requires_target boolean, ready_for_training boolean",
    )


@register(
    "analysis_outcomes",
    "SELECT 'one class' AS input, CASE WHEN count(*) >= 2 THEN 'completed' ELSE 'validation_failed' END AS status, "
    "CASE WHEN count(*) < 2 THEN 'failed' WHEN count(DISTINCT fixed) = 1 THEN 'blocked' ELSE 'ready_for_training_approval' END AS verdict, "
    "count(*) >= 2 AS ready_for_downstream, CAST(0 AS INT) AS errors, count(DISTINCT fixed) = 1 AS blocked FROM ("
    + oracle.source_sql("flagged") + ") UNION ALL SELECT 'no rows', CASE WHEN count(*) >= 2 THEN 'completed' ELSE 'validation_failed' END, "
    "CASE WHEN count(*) < 2 THEN 'failed' ELSE 'requires_user_input' END, count(*) >= 2, "
    "CAST(count(*) < 2 AS INT) + CAST(count(*) = 0 AS INT) + CAST(count(event_id) = 0 AS INT), false FROM events WHERE value < -1e30",
)
def analysis_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Runs that end blocked and failed."""
    inputs = {"one class": load(spark, folder, "flagged"), "no rows": load(spark, folder, "events").where("value < -1e30")}
    rows = []
    for name, df in inputs.items():
        run = analyze_table(spark, df, target="fixed")
        blocked = run.recommendation is not None and run.recommendation.status == "blocked"
        rows.append((name, run.status, run.verdict, run.is_ready_for_downstream_analysis, len(run.errors), blocked))
    return local_table(spark, rows, "input string, status string, verdict string, ready_for_downstream boolean, errors int, blocked boolean")


@register("result_sink", oracle.profile("supplier"))
def result_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Analyse a table, write all results, read the column profile back."""
    run = analyze_table(spark, load(spark, folder, "supplier"), run_id="one")
    base = scratch_folder(spark)
    save_analysis(spark, run, base)
    return spark.read.parquet(f"{base}/column_profile").drop("run_id", "sample_values")


#: Free texts, and sample values, which column_samples compares.
TEXTS = ("message", "warnings", "errors", "reasons", "sample_values")
REPORT_SQL = " UNION ALL ".join(
    oracle.lines(section, sql, number, fractions)
    for section, sql, number, fractions in (
        ("analysis", "SELECT 'run' AS run_id, 'dataframe' AS source, status, verdict, status = 'completed' AS ready_for_downstream, "
         f"false AS ready_for_planning, requires_target, ready_for_training FROM ({_run_sql('supplier', None, None)})", None, False),
        ("table_counts", oracle.table_counts("supplier"), None, False),
        ("source", "SELECT 'dataframe' AS file_name, '' AS file_extension, count(*) AS row_count, "
         f"{len(columns('supplier'))} AS column_count, '{','.join(n for n, _ in columns('supplier'))}' AS column_names FROM supplier", None, False),
        ("validation", f"SELECT * EXCLUDE (error_count, warning_count) FROM ({oracle.validation('supplier')})", None, False),
        ("column_profile", oracle.profile("supplier"), "position", True),
        ("column_lists", oracle.column_lists("supplier"), None, False),
        ("quality_summary", oracle.quality_summary("supplier"), None, True),
        ("quality_issues", oracle.quality_issues("supplier"), "seq", True),
        ("task", "SELECT CAST(NULL AS VARCHAR) AS candidate_target, CAST(NULL AS VARCHAR) AS task_type, CASE WHEN bool_or(n IN "
         "('target', 'label', 'y', 'class', 'outcome')) THEN 'ok' ELSE 'not_found' END AS status FROM "
         "(SELECT unnest(list_transform(['s_suppkey', 's_name', 's_nationkey', 's_acctbal'], lambda x: lower(x))) AS n)", None, False),
    )
)


@register("report_lines", REPORT_SQL)
def report(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of a report but free texts."""
    lines = report_lines(spark, analyze_table(spark, load(spark, folder, "supplier")))
    return lines.where(~F.col("name").isin(*TEXTS)).drop("seq")


@register("training_run", None)
def training_run(spark: SparkSession, folder: str) -> DataFrame:
    """Analyse, train all recommended candidates, save, read the experiments back."""
    run = analyze_table(spark, load(spark, folder, "part"), target="p_retailprice", run_id="one")
    trained = train_table(run, key=["p_partkey"])
    if trained.errors:
        raise RuntimeError("; ".join(trained.errors))
    base = scratch_folder(spark)
    save_training(spark, trained, base)
    found = spark.read.parquet(f"{base}/experiments")
    return found.select(
        "seq", "model_name", "role", "status", "primary_metric_name", "primary_metric_value",
        "generalization_gap", "overfitting_risk",
    )


@register(
    "training_run_outcome",
    f"""WITH b AS ({oracle.feature_plan('part', 'p_retailprice')}), n AS (SELECT count(*) AS c FROM part)
SELECT seq, model_name, role, 'success' AS status, c - CAST(ceil(c * 0.2) AS BIGINT) AS train_rows,
  CAST(ceil(c * 0.2) AS BIGINT) AS test_rows, CAST(0 AS BIGINT) AS dropped_rows, CAST(42 AS BIGINT) AS seed,
  CAST(0.2 AS DOUBLE) AS test_size,
  (SELECT CAST(count(*) AS INT) FROM b WHERE bucket = 'numeric') AS numeric_features,
  (SELECT CAST(count(*) AS INT) FROM b WHERE bucket = 'categorical') AS categorical_features
FROM n, (VALUES (0, 'RandomForestRegressor', 'recommended'), (1, 'Ridge', 'baseline'),
  (2, 'HistGradientBoostingRegressor', 'challenger')) m(seq, model_name, role)""",
)
def training_run_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """Analyse, train all recommended candidates, save; experiments and run facts read back."""
    run = analyze_table(spark, load(spark, folder, "part"), target="p_retailprice", run_id="one")
    trained = train_table(run, key=["p_partkey"])
    base = scratch_folder(spark)
    save_training(spark, trained, base)
    facts = spark.read.parquet(f"{base}/training").select(
        "train_rows", "test_rows", "dropped_rows", "seed", "test_size", "numeric_features", "categorical_features"
    )
    # The facts are one row.
    found = spark.read.parquet(f"{base}/experiments").select("seq", "model_name", "role", "status")
    return found.crossJoin(facts)
