"""SQL counterparts of the registered queries."""

from __future__ import annotations

from catalog.tables import columns, source_sql

INTEGERS = ("bigint", "int")


def kind_of(dtype: str) -> str:
    if dtype == "string":
        return "string"
    if dtype.startswith(("array", "map", "struct")):
        return "unknown"
    if dtype == "boolean":
        return dtype
    return "datetime" if dtype.startswith(("timestamp", "date")) else "numeric"


def facts_sql(table: str, names: list[str] | None = None) -> str:
    """One row per column: rows, non-missing values, distinct values, mean length."""
    parts = []
    for i, (name, dtype) in enumerate(columns(table)):
        if names and name not in names:
            continue
        length = f"avg(length({name}))" if dtype == "string" else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS position, '{name}' AS column_name, '{dtype}' AS dtype, "
            f"'{kind_of(dtype)}' AS kind, count(*) AS row_count, count({name}) AS non_null_count, "
            f"count(DISTINCT {name}) AS unique_count, {length} AS mean_length FROM src"
        )
    return " UNION ALL ".join(parts)


def profile_cte(table: str) -> str:
    """`src`, `facts` and `p`, the column profile of a table."""
    return f"""WITH src AS ({source_sql(table)}),
facts AS ({facts_sql(table)}),
typed AS (SELECT *, CASE WHEN non_null_count = 0 THEN 'empty' WHEN kind <> 'string' THEN kind
  WHEN mean_length >= 40 AND unique_count / non_null_count >= 0.8 THEN 'text'
  ELSE 'categorical' END AS inferred_type FROM facts),
p AS (SELECT position, column_name, dtype, inferred_type, non_null_count,
  row_count - non_null_count AS missing_count,
  CASE WHEN row_count = 0 THEN 0.0 ELSE round((row_count - non_null_count) / row_count, 6) END AS missing_ratio,
  unique_count,
  CASE WHEN non_null_count = 0 THEN 0.0 ELSE round(unique_count / non_null_count, 6) END AS unique_ratio,
  unique_count = 1 AS is_constant, non_null_count = 0 AS is_all_missing,
  inferred_type IN ('categorical', 'text') AND unique_count >= 50
    AND unique_count / non_null_count >= 0.8 AS is_high_cardinality, row_count FROM typed)"""


IS_ID = (
    "(regexp_matches(lower(column_name), 'id\\s*$|identifier') AND NOT is_all_missing "
    "AND unique_ratio >= 0.95)"
)


def names_sql(condition: str, source: str = "p") -> str:
    return (
        f"(SELECT coalesce(string_agg(column_name, ',' ORDER BY position), '') FROM {source} "
        f"WHERE {condition})"
    )


def profile(table: str) -> str:
    return f"{profile_cte(table)} SELECT * EXCLUDE (row_count) FROM p"


def column_counts(table: str) -> str:
    return (
        f"{profile_cte(table)} SELECT column_name, non_null_count, missing_count, missing_ratio FROM p"
    )


def column_distinct(table: str) -> str:
    return f"{profile_cte(table)} SELECT column_name, unique_count, unique_ratio FROM p"


def column_types(table: str) -> str:
    return f"{profile_cte(table)} SELECT column_name, dtype, inferred_type FROM p"


def column_flags(table: str) -> str:
    return (
        f"{profile_cte(table)} SELECT column_name, is_constant, is_all_missing, is_high_cardinality FROM p"
    )


def column_lists(table: str) -> str:
    kinds = ", ".join(
        f"{names_sql(f_)} AS {name}"
        for name, f_ in [
            *[
                (f"{k}_columns", f"inferred_type = '{k}'")
                for k in ("numeric", "categorical", "boolean", "datetime", "text", "empty")
            ],
            ("constant_columns", "is_constant"),
            ("all_missing_columns", "is_all_missing"),
            ("high_cardinality_columns", "is_high_cardinality"),
        ]
    )
    return f"{profile_cte(table)} SELECT {kinds}"


def column_samples(table: str) -> str:
    parts = []
    for i, (name, dtype) in enumerate(columns(table)):
        text = (
            f"strftime({name}, '%Y-%m-%dT%H:%M:%S')" if dtype.startswith("timestamp")
            else f"CAST({name} AS VARCHAR)"
        )
        parts.append(
            f"SELECT {i} AS position, '{name}' AS column_name, string_agg(t, '|' ORDER BY v) AS sample_values "
            f"FROM (SELECT DISTINCT {name} AS v, {text} AS t FROM {table} WHERE {name} IS NOT NULL "
            f"ORDER BY v LIMIT 3)"
        )
    return " UNION ALL ".join(parts)


def counts_cte(table: str) -> str:
    """`q`: one row of table-level counts on top of the profile."""
    names = [name for name, _ in columns(table)]
    some = " OR ".join(f"{n} IS NULL" for n in names)
    every = " AND ".join(f"{n} IS NULL" for n in names)
    return f"""{profile_cte(table)},
q AS (SELECT count(*) AS row_count, CAST({len(names)} AS BIGINT) AS column_count,
  (SELECT CAST(sum(missing_count) AS BIGINT) FROM p) AS missing_cell_count,
  count(*) FILTER (WHERE {some}) AS rows_with_missing_count,
  count(*) FILTER (WHERE {every}) AS fully_missing_row_count,
  {names_sql('missing_count > 0')} AS columns_with_missing_values,
  {names_sql('is_all_missing')} AS fully_missing_columns FROM src)"""


def table_counts(table: str) -> str:
    return f"{counts_cte(table)} SELECT * FROM q"


def validation(table: str) -> str:
    return f"""{counts_cte(table)},
v AS (SELECT *, CAST(column_count < 1 AS INT) + CAST(row_count < 2 AS INT) + CAST(row_count = 0 AS INT)
    + CAST((SELECT bool_and(is_all_missing) FROM p) AS INT) AS errors,
  CAST(fully_missing_row_count > 0 AS INT) + CAST(fully_missing_columns <> '' AS INT) AS warnings FROM q)
SELECT errors = 0 AS is_valid, row_count, column_count, CAST(errors AS INT) AS error_count,
  CAST(warnings AS INT) AS warning_count, fully_missing_columns FROM v"""


def share(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0 ELSE round({part} / {whole}, 6) END"


def summary_cte(table: str) -> str:
    return f"""{counts_cte(table)},
d AS (SELECT (SELECT count(*) FROM src) - (SELECT count(*) FROM (SELECT DISTINCT * FROM src)) AS duplicate_row_count),
s AS (SELECT row_count, column_count, duplicate_row_count,
  {share('duplicate_row_count', 'row_count')} AS duplicate_row_ratio, missing_cell_count,
  {share('missing_cell_count', '(row_count * column_count)')} AS missing_cell_ratio,
  rows_with_missing_count, {share('rows_with_missing_count', 'row_count')} AS rows_with_missing_ratio,
  fully_missing_row_count, {share('fully_missing_row_count', 'row_count')} AS fully_missing_row_ratio,
  columns_with_missing_values, fully_missing_columns,
  {names_sql('is_constant')} AS constant_columns,
  {names_sql('is_high_cardinality')} AS high_cardinality_columns,
  {names_sql(IS_ID)} AS possible_id_columns
  FROM q, d)"""


def quality_summary(table: str) -> str:
    return f"{summary_cte(table)} SELECT *, missing_cell_ratio < 0.5 AS is_usable_for_analysis FROM s"


QUALITY_RULES = [
    ("critical_missingness", "critical", "missing_cell_ratio >= 0.5", "columns_with_missing_values", "missing_cell_ratio"),
    ("missing_values", "warning", "missing_cell_ratio < 0.5 AND missing_cell_ratio >= 0.05", "columns_with_missing_values", "missing_cell_ratio"),
    ("duplicate_rows", "warning", "duplicate_row_ratio >= 0.01 AND duplicate_row_count > 0", "''", "duplicate_row_ratio"),
    ("fully_missing_rows", "warning", "fully_missing_row_count > 0", "''", "fully_missing_row_ratio"),
    ("fully_missing_columns", "warning", "fully_missing_columns <> ''", "fully_missing_columns", "NULL"),
    ("constant_columns", "warning", "constant_columns <> ''", "constant_columns", "NULL"),
    ("high_cardinality_columns", "warning", "high_cardinality_columns <> ''", "high_cardinality_columns", "NULL"),
    ("possible_id_columns", "warning", "possible_id_columns <> ''", "possible_id_columns", "NULL"),
]


def rules_sql(rules: list[tuple], source: str) -> str:
    """Rows of the rules that hold, numbered from 0 in rule order."""
    parts = " UNION ALL ".join(
        f"SELECT {i} AS rule, '{code}' AS code, '{severity}' AS severity, {names} AS columns, "
        f"CAST({metric} AS DOUBLE) AS metric_value FROM {source} WHERE {condition}"
        for i, (code, severity, condition, names, metric) in enumerate(rules)
    )
    return (
        f"SELECT CAST(row_number() OVER (ORDER BY rule) - 1 AS INT) AS seq, code, severity, columns, "
        f"metric_value FROM ({parts})"
    )


def quality_issues(table: str) -> str:
    return f"{summary_cte(table)} {rules_sql(QUALITY_RULES, 's')}"


def possible_ids(table: str) -> str:
    return f"{profile_cte(table)} SELECT '{table}' AS table_name, column_name, unique_ratio FROM p WHERE {IS_ID}"


def duplicates(name: str, columns_sql: str, table: str) -> str:
    return (
        f"SELECT '{name}' AS input, (SELECT count(*) FROM {table}) - (SELECT count(*) FROM "
        f"(SELECT DISTINCT {columns_sql} FROM {table})) AS duplicate_row_count"
    )


def task(table: str, target: str) -> str:
    """Task rule on a numeric target, spelled out on its distinct values."""
    return f"""SELECT '{table}' AS input, '{target}' AS candidate_target,
CASE WHEN n = 0 THEN NULL
 WHEN k <= 20 AND whole AND ((k = 2 AND lo = 0 AND hi = 1) OR (k = 2 AND lo = -1 AND hi = 1)
   OR (NOT (k > 2 AND k / n > 0.5) AND hi - lo + 1 = k AND lo IN (0, 1))) THEN 'classification'
 ELSE 'regression' END AS task_type, CASE WHEN n = 0 THEN 'ambiguous' ELSE 'ok' END AS status
FROM (SELECT count({target}) AS n, count(DISTINCT {target}) AS k, min({target}) AS lo, max({target}) AS hi,
  bool_and({target} = floor({target})) AS whole FROM ({source_sql(table)}))"""


def class_distribution(table: str, target: str) -> str:
    return f"""SELECT CAST({target} AS VARCHAR) AS label, count(*) AS count,
round(count(*) / (SELECT count({target}) FROM ({source_sql(table)})), 6) AS proportion
FROM ({source_sql(table)}) WHERE {target} IS NOT NULL GROUP BY {target}"""


def target_classes_cte(table: str, target: str) -> str:
    return f"""WITH src AS ({source_sql(table)}),
g AS (SELECT {target} AS v, count(*) AS c FROM src WHERE {target} IS NOT NULL GROUP BY 1),
t AS (SELECT '{target}' AS target_column, 'classification' AS task_type,
  (SELECT count(*) FROM src) AS row_count, CAST(sum(c) AS BIGINT) AS non_null_count,
  (SELECT count(*) FROM src) - CAST(sum(c) AS BIGINT) AS missing_count,
  round(((SELECT count(*) FROM src) - sum(c)) / (SELECT count(*) FROM src), 6) AS missing_ratio,
  count(*) AS unique_count,
  (SELECT CAST(v AS VARCHAR) FROM g ORDER BY c DESC, v LIMIT 1) AS majority_class,
  round(max(c) / sum(c), 6) AS majority_class_ratio,
  (SELECT CAST(v AS VARCHAR) FROM g ORDER BY c, v DESC LIMIT 1) AS minority_class,
  round(min(c) / sum(c), 6) AS minority_class_ratio,
  CASE WHEN count(*) > 1 THEN round(max(c) / min(c), 6) END AS class_imbalance_ratio FROM g)"""


def target_classes(table: str, target: str) -> str:
    return f"{target_classes_cte(table, target)} SELECT * FROM t"


CLASS_RULES = [
    ("target_missing_values", "warning", "missing_ratio > 0", "''", "missing_ratio"),
    ("target_all_missing", "critical", "non_null_count = 0", "''", "NULL"),
    ("single_class_target", "critical", "unique_count = 1", "''", "NULL"),
    ("high_cardinality_classification_target", "warning", "unique_count > 50", "''", "unique_count"),
    ("class_imbalance", "warning", "class_imbalance_ratio IS NOT NULL AND (class_imbalance_ratio >= 5 OR minority_class_ratio <= 0.1)", "''", "class_imbalance_ratio"),
]


def class_issues(table: str, target: str) -> str:
    return f"{target_classes_cte(table, target)} {rules_sql(CLASS_RULES, 't')}"


def numeric_summary(table: str, target: str) -> str:
    return f"""SELECT '{table}.{target}' AS input, count(x) AS count, round(avg(x), 6) AS mean,
round(stddev_samp(x), 6) AS std, round(min(x), 6) AS minimum, round(quantile_cont(x, 0.25), 6) AS q25,
round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75,
round(max(x), 6) AS maximum, round(skewness(x), 6) AS skewness
FROM (SELECT CAST({target} AS DOUBLE) AS x FROM {table})"""


def facts(table: str, target: str) -> str:
    """Traits the recommendation rules read."""
    feature = f"column_name <> '{target}'"
    return f"""{profile_cte(table)},
f AS (SELECT max(row_count) AS row_count, count(*) AS column_count,
  count(*) FILTER (WHERE {feature}) AS feature_count,
  count(*) FILTER (WHERE {feature} AND inferred_type = 'numeric') AS numeric_feature_count,
  count(*) FILTER (WHERE {feature} AND inferred_type = 'categorical') AS categorical_feature_count,
  count(*) FILTER (WHERE {feature} AND inferred_type = 'text') AS text_feature_count,
  count(*) FILTER (WHERE {feature} AND is_high_cardinality) AS high_cardinality_feature_count,
  CAST(sum(missing_count) AS BIGINT) AS missing_cell_count,
  {names_sql(IS_ID)} AS possible_id_columns, {names_sql('is_high_cardinality')} AS high_cardinality_columns
  FROM p),
g AS (SELECT {target} AS v, count(*) AS c FROM src WHERE {target} IS NOT NULL GROUP BY 1),
i AS (SELECT count(*) > 1 AND (round(max(c) / min(c), 6) >= 5 OR round(min(c) / sum(c), 6) <= 0.1) AS has_class_imbalance,
  count(*) AS classes, (SELECT count(*) FROM src) - sum(c) AS unlabelled FROM g),
n AS (SELECT f.*, {share('numeric_feature_count', 'feature_count')} AS numeric_feature_ratio,
  {share('categorical_feature_count', 'feature_count')} AS categorical_feature_ratio,
  {share('missing_cell_count', '(row_count * column_count)')} AS missing_cell_ratio,
  row_count < 1000 AS is_small_dataset, row_count >= 100000 AS is_large_dataset,
  numeric_feature_count / feature_count >= 0.7 AS is_mostly_numeric,
  categorical_feature_count / feature_count >= 0.3 OR high_cardinality_feature_count > 0 AS has_many_categorical_features,
  text_feature_count > 0 AS has_text_features, missing_cell_count > 0 AS has_missing_values, {{imbalance}} AS has_class_imbalance
  FROM f, i)"""


def dataset_facts(table: str, target: str, task_type: str) -> str:
    return f"{_facts(table, target, task_type)} SELECT * FROM n"


def _facts(table: str, target: str, task_type: str) -> str:
    imbalance = "has_class_imbalance" if task_type == "classification" else "false"
    return facts(table, target).replace("{imbalance}", imbalance)


def candidates(table: str, target: str, task_type: str, optional: bool = False) -> str:
    """Candidate models in order, by the rules spelled out as CASE."""
    classes = task_type == "classification"
    kind = "Classifier" if classes else "Regressor"
    linear = "LogisticRegression" if classes else "Ridge"
    flag = "true" if optional else "false"
    return f"""{_facts(table, target, task_type)},
m AS (SELECT *, CASE WHEN has_many_categorical_features AND {flag} THEN 'CategoricalBoosting{kind}'
  WHEN has_class_imbalance THEN 'RandomForest{kind}'
  WHEN is_mostly_numeric THEN 'HistGradientBoosting{kind}' ELSE 'RandomForest{kind}' END AS first FROM n)
SELECT 0 AS seq, first AS model_name, 'recommended' AS role FROM m
UNION ALL SELECT 1, '{linear}', 'baseline' FROM m
UNION ALL SELECT 2, CASE WHEN first LIKE 'HistGradient%' THEN 'RandomForest{kind}' ELSE 'HistGradientBoosting{kind}' END, 'challenger' FROM m"""


def feature_plan(table: str, target: str) -> str:
    return f"""{profile_cte(table)},
r AS (SELECT position, column_name, inferred_type, CASE WHEN is_all_missing THEN 'all_missing'
  WHEN is_constant THEN 'constant' WHEN {IS_ID} THEN 'possible_id' WHEN inferred_type = 'text' THEN 'text'
  WHEN inferred_type = 'datetime' THEN 'datetime' WHEN is_high_cardinality THEN 'high_cardinality'
  WHEN inferred_type NOT IN ('numeric', 'categorical', 'boolean') THEN 'unknown_type' END AS exclusion_reason
  FROM p WHERE column_name <> '{target}')
SELECT position, column_name, CASE WHEN exclusion_reason IS NULL THEN inferred_type END AS bucket, exclusion_reason FROM r"""


def medians(table: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS column_name, CAST(median({n}) AS DOUBLE) AS median FROM ({source_sql(table)})"
        for n in names
    )


def modes(table: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{n}' AS column_name, CAST({n} AS VARCHAR) AS value, count(*) AS n, "
        f"(SELECT count(DISTINCT {n}) FROM ({source_sql(table)})) AS categories FROM ({source_sql(table)}) "
        f"WHERE {n} IS NOT NULL GROUP BY {n} ORDER BY count(*) DESC, CAST({n} AS VARCHAR) LIMIT 1)"
        for n in names
    )


def scaled(table: str, key: str, names: list[str]) -> str:
    values = ", ".join(
        f"round(({n} - avg({n}) OVER ()) / (SELECT stddev_pop({n}) FROM {table}), 6) AS {n}" for n in names
    )
    return f"SELECT {key}, {values} FROM {table}"


def one_hot(table: str, key: str, name: str, values: list[str]) -> str:
    slots = ", ".join(
        f"CAST({name} = '{v}' AS INT) AS slot_{i}" for i, v in enumerate(sorted(values))
    )
    return f"SELECT {key}, {slots} FROM {table}"


def split_sql(table: str, key: str, label: str | None, size: float = 0.2, seed: int = 42) -> str:
    """Key and side: test rows are the first of each class by MD5, up to its quota."""
    group = label or "0"
    return f"""src AS ({source_sql(table)}),
u AS (SELECT *, {group} AS cls FROM src {f'WHERE {label} IS NOT NULL' if label else ''}),
cnt AS (SELECT cls, count(*) AS c FROM u GROUP BY cls),
tot AS (SELECT CAST(sum(c) AS BIGINT) AS n, CAST(ceil(CAST(sum(c) AS DOUBLE) * {size}) AS BIGINT) AS t FROM cnt),
base AS (SELECT cls, (c * t) // n AS whole, (c * t) % n AS rest, t FROM cnt, tot),
quo AS (SELECT cls, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, cls)
  <= t - (SELECT sum(whole) FROM base) THEN 1 ELSE 0 END AS quota FROM base),
split AS (SELECT u.*, CASE WHEN row_number() OVER (PARTITION BY u.cls
  ORDER BY md5('{seed}|' || CAST({key} AS VARCHAR))) <= quota THEN 'test' ELSE 'train' END AS split
  FROM u JOIN quo ON u.cls = quo.cls)"""


def split(table: str, key: str, label: str | None) -> str:
    return f"WITH {split_sql(table, key, label)} SELECT {key}, split FROM split"


def weights(table: str, label: str) -> str:
    return f"""SELECT {label} AS label, count(*) AS count,
round((SELECT count({label}) FROM {table}) / ((SELECT count(DISTINCT {label}) FROM {table}) * count(*)), 6) AS weight
FROM {table} GROUP BY {label}"""


def classification(pairs_sql: str) -> str:
    return f"""WITH s AS ({pairs_sql}),
k AS (SELECT y AS cls FROM s UNION SELECT p FROM s),
f AS (SELECT cls, (SELECT count(*) FROM s WHERE y = cls AND p = cls) AS tp,
  (SELECT count(*) FROM s WHERE y = cls) + (SELECT count(*) FROM s WHERE p = cls) AS uses FROM k)
SELECT (SELECT count(*) FROM s) AS row_count, round((SELECT avg(CAST(y = p AS INT)) FROM s), 6) AS accuracy,
  round(avg(2 * tp / uses), 6) AS f1_macro FROM f"""


def regression(pairs_sql: str, groups: str = "") -> str:
    names, by = (f"{groups}, ", f"GROUP BY {groups}") if groups else ("", "")
    return f"""SELECT {names}count(*) AS row_count, round(avg(abs(y - p)), 6) AS mae,
round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 6) AS r2 FROM ({pairs_sql}) {by}"""


def auc(scores_sql: str, groups: str = "") -> str:
    """Rank formula with averaged ranks of tied scores."""
    names, part = (f"{groups}, ", f"PARTITION BY {groups} ") if groups else ("", "")
    tie = f"PARTITION BY {names}s"
    by = f"GROUP BY {groups}" if groups else ""
    return f"""SELECT {names}round((sum(CASE WHEN y THEN rk END) - count(*) FILTER (WHERE y)
 * (count(*) FILTER (WHERE y) + 1) / 2.0) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)), 6) AS roc_auc
FROM (SELECT *, rank() OVER ({part}ORDER BY s) + (count(*) OVER ({tie}) - 1) / 2.0 AS rk FROM ({scores_sql})) {by}"""


def ridge(table: str, key: str, x: str, y: str) -> str:
    """Ridge with one scaled feature in closed form, scored on both sides of the split."""
    return f"""WITH {split_sql(table, key, None)},
tr AS (SELECT avg({x}) AS mx, stddev_pop({x}) AS sx, avg({y}) AS my FROM split WHERE split = 'train'),
w AS (SELECT sum((({x} - mx) / sx) * ({y} - my)) / (count(*) + 1.0) AS w FROM split, tr WHERE split = 'train'),
z AS (SELECT split, {y} AS y, my + w * ({x} - mx) / sx AS p FROM split, tr, w)
{regression('SELECT * FROM z', 'split')}"""


def group_majority(table: str, key: str, group: str, label: str) -> str:
    """Accuracy and macro F1 per side of predicting each group's most frequent training class."""
    return f"""WITH {split_sql(table, key, label)},
c AS (SELECT {group} AS g, {label} AS p, count(*) AS n FROM split WHERE split.split = 'train' GROUP BY 1, 2),
m AS (SELECT g, p, row_number() OVER (PARTITION BY g ORDER BY n DESC, p) AS rk FROM c),
z AS (SELECT split, {label} AS y, p FROM split JOIN m ON {group} = g WHERE rk = 1),
k AS (SELECT split, y AS cls FROM z UNION SELECT split, p FROM z),
f AS (SELECT k.split, cls, count(*) FILTER (WHERE y = cls AND p = cls) AS tp,
  count(*) FILTER (WHERE y = cls) + count(*) FILTER (WHERE p = cls) AS uses
  FROM k JOIN z ON z.split = k.split GROUP BY k.split, cls)
SELECT split, 'accuracy' AS metric, round(avg(CAST(y = p AS INT)), 6) AS value FROM z GROUP BY split
UNION ALL SELECT split, 'f1_macro', round(avg(2 * tp / uses), 6) FROM f GROUP BY split"""


def group_means(table: str, key: str, group: str, y: str) -> str:
    """Scores per side of predicting each group's training mean."""
    return f"""SELECT split, metric, value FROM (SELECT split, mae, rmse, r2 FROM (WITH {split_sql(table, key, None)},
m AS (SELECT {group} AS g, avg({y}) AS p FROM split WHERE split = 'train' GROUP BY 1),
z AS (SELECT split, {y} AS y, p FROM split JOIN m ON {group} = g)
{regression('SELECT * FROM z', 'split')})) UNPIVOT (value FOR metric IN (mae, rmse, r2))"""


def ridge_predictions(table: str, key: str, x: str, y: str) -> str:
    """What the same ridge predicts for every row."""
    return f"""WITH {split_sql(table, key, None)},
tr AS (SELECT avg({x}) AS mx, stddev_pop({x}) AS sx, avg({y}) AS my FROM split WHERE split = 'train'),
w AS (SELECT sum((({x} - mx) / sx) * ({y} - my)) / (count(*) + 1.0) AS w FROM split, tr WHERE split = 'train')
SELECT {key}, round(my + w * ({x} - mx) / sx, 4) AS predicted FROM split, tr, w"""


def recommendation(table: str, target: str) -> str:
    """Status, model and confidence of a classification, and how many warnings and blocks there are."""
    issues = f"SELECT code, severity FROM ({quality_issues(table)}) UNION ALL SELECT code, severity FROM ({class_issues(table, target)})"
    return f"""SELECT '{table}.{target}' AS input, CASE WHEN critical > 0 THEN 'blocked' ELSE 'ready' END AS status,
CASE WHEN critical = 0 THEN model_name END AS recommended_model,
CASE WHEN critical > 0 THEN 'low' WHEN has_many_categorical_features THEN 'medium'
  WHEN issues = 0 AND feature_count > 0 THEN 'high' ELSE 'medium' END AS confidence,
CAST(issues + CAST(has_text_features AS INT) + CAST(has_many_categorical_features AS INT) AS INT) AS warning_count,
CAST(critical AS INT) AS blocked_count, CASE WHEN critical > 0 THEN 0 ELSE 3 END AS candidate_count
FROM (SELECT count(*) AS issues, count(*) FILTER (severity = 'critical') AS critical FROM ({issues})),
  ({dataset_facts(table, target, 'classification')}), ({candidates(table, target, 'classification')}) WHERE seq = 0"""


# Parameters of the candidates that don't depend on the data.
PARAMETERS = {
    "LogisticRegression": {"max_iter": "1000", "solver": "lbfgs", "random_state": "42"},
    "RandomForestClassifier": {"n_estimators": "300", "max_depth": None, "min_samples_leaf": "2", "random_state": "42"},
    "HistGradientBoostingClassifier": {
        "max_iter": "300", "learning_rate": "0.05", "max_leaf_nodes": "31", "l2_regularization": "0.1", "random_state": "42",
    },
}


def parameters(table: str, target: str) -> str:
    """The candidates' parameters; classes have weights if they are unbalanced."""
    rows = ", ".join(
        f"('{model}', '{name}', {'NULL' if value is None else repr(value)})" for model, given in PARAMETERS.items() for name, value in given.items()
    )
    weighted = "('LogisticRegression', 'class_weight'), ('RandomForestClassifier', 'class_weight')"
    return f"""WITH found AS ({candidates(table, target, 'classification')}), traits AS ({dataset_facts(table, target, 'classification')}),
given AS (SELECT * FROM (VALUES {rows}) v(model_name, parameter, value)
  UNION ALL SELECT model_name, parameter, CASE WHEN has_class_imbalance THEN 'balanced' END FROM (VALUES {weighted}) v(model_name, parameter), traits)
SELECT '{table}.{target}' AS input, seq, role, model_name, parameter, value FROM found JOIN given USING (model_name)"""


def lines(section: str, sql: str, number: str | None = None, fractions: bool = False) -> str:
    """Every cell of a result as a line of a report; ratios have six digits after the point."""
    ratio = "(c LIKE '%ratio' OR c = 'metric_value')"
    cells = f"COLUMNS(lambda c: NOT {ratio} AND c NOT IN ('seq', 'position'))::VARCHAR AS '\\0'"
    if fractions:
        cells += f", COLUMNS(lambda c: {ratio})::DECIMAL(38,6)::VARCHAR AS '\\0'"
    return (
        f"SELECT '{section}' AS section, CAST(item AS INT) AS item, name, value FROM "
        f"(SELECT {number or 0} AS item, {cells} FROM ({sql})) UNPIVOT INCLUDE NULLS (value FOR name IN (COLUMNS(* EXCLUDE (item))))"
    )
