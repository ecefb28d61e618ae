import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from gridscope.config import AnalysisConfig
from gridscope.operators.features import (
    FeatureError,
    class_weight_table,
    feature_columns,
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
from gridscope.operators.models import save_models, train_candidates
from gridscope.operators.profile import profile_columns
from gridscope.operators.recommend import (
    Candidate,
    Recommendation,
    boosting_candidate,
    categorical_candidate,
    forest_candidate,
    linear_candidate,
)
from gridscope.operators import split as split_module
from gridscope.operators.split import SplitError, plan_split, split_train_test

SMALL = {"numTrees": 3, "maxDepth": 3, "maxIter": 3}


def plan_of(df, target, **options):
    return plan_features(profile_columns(df, with_samples=False), target, **options)


def test_feature_plan(frame):
    long = "a long comment of customer number {} that is different in every row"
    df = frame(
        "age int, city string, is_active boolean, customer_id string, feedback string, "
        "constant_feature int, empty_feature int, target int",
        *[(20 + i, "xy"[i % 2], i % 2 == 0, f"c{i}", long.format(i), 1, None, i % 2) for i in range(4)],
    )
    rows = {r.column_name: (r.bucket, r.exclusion_reason) for r in plan_of(df, "target").collect()}
    assert rows == {
        "age": ("numeric", None), "city": ("categorical", None), "is_active": ("boolean", None),
        "customer_id": (None, "possible_id"), "feedback": (None, "text"),
        "constant_feature": (None, "constant"), "empty_feature": (None, "all_missing"),
    }
    off = plan_of(df, "target", exclude_text=False, exclude_possible_id=False, exclude_all_missing=False)
    rows = {r.column_name: (r.bucket, r.exclusion_reason) for r in off.collect()}
    assert rows["feedback"] == (None, "unknown_type") and rows["empty_feature"][1] == "unknown_type"
    assert rows["customer_id"] == ("categorical", None)
    assert feature_columns(off).all == ["age", "city", "customer_id", "is_active"]


def test_missing_targets(frame):
    df = frame("feature int, target int", (1, 0), (2, None), (3, 1))
    features = feature_columns(plan_of(df, "target"))
    assert select_features(df, features, "target", "classification").count() == 2
    with pytest.raises(FeatureError):
        select_features(df, features, "target", "classification", drop_missing_target=False)
    with pytest.raises(FeatureError):
        select_features(df.limit(0), features, "target", "classification")
    text = frame("feature int, target string", (1, "1"), (2, "x"))
    with pytest.raises(FeatureError):
        select_features(text, features, "target", "regression")
    with pytest.raises(FeatureError):
        feature_columns(plan_of(frame("target int", 1, 0), "target"))


def test_preprocessing(frame):
    df = frame(
        "age double, city string, flag boolean",
        (1.0, "b", True), (2.0, "a", None), (3.0, None, True), (10.0, "b", False), (None, "", True),
    )
    features = feature_columns(plan_features(profile_columns(df), "none"))
    fitted = fit_preprocessing(df, features)
    unseen = frame("age double, city string, flag boolean", (None, "zzz", None), (float("nan"), None, False))
    vectors = [r[0].toArray() for r in fitted.model().transform(df.unionByName(unseen)).select("__features").collect()]
    filled = np.array([1, 2, 3, 10, 2.5])
    scaled = (filled - filled.mean()) / filled.std()
    assert np.allclose([v[0] for v in vectors[:5]], scaled)
    one_hot = np.array([v[1:] for v in vectors])
    # City "", a, b; then flag false, true. A missing city is the frequent "b".
    assert one_hot.tolist() == [
        [0, 0, 1, 0, 1], [0, 1, 0, 0, 1], [0, 0, 1, 0, 1], [0, 0, 1, 1, 0], [1, 0, 0, 0, 1],
        [0, 0, 0, 0, 1], [0, 0, 1, 1, 0],
    ]


def test_odd_category_texts(frame):
    df = frame("s string", "it's \\ \"x\"", "it's \\ \"x\"", "${y}", None)
    features = feature_columns(plan_features(profile_columns(df), "none"))
    rows = fit_preprocessing(df, features).model().transform(df).select("__features").collect()
    assert [r[0].toArray().tolist() for r in rows] == [[0, 1], [0, 1], [1, 0], [0, 1]]


def test_median_and_mode(frame):
    df = frame("x int, s string", (1, "b"), (2, "a"), (3, "a"), (10, "b"), (None, None))
    assert medians(df, ["x"]) == {"x": 2.5}
    assert [tuple(r) for r in modes(df, ["s"]).collect()] == [("s", "a", 2, 2)]


def split_sizes(df):
    return {r.split: r["count"] for r in df.groupBy("split").count().collect()}


def test_split_sizes(frame):
    ten = frame("k int, t int", *[(i, i % 2) for i in range(10)])
    plan = plan_split(ten, "t", 0.4)
    assert plan.stratified and (plan.train_count, plan.test_count) == (6, 4)
    rows = split_train_test(ten, "t", ["k"], 0.4)
    per_class = {(r.split, r.t): r["count"] for r in rows.groupBy("split", "t").count().collect()}
    assert per_class == {("test", 0): 2, ("test", 1): 2, ("train", 0): 3, ("train", 1): 3}

    four = frame("k int, t int", (1, 0), (2, 0), (3, 0), (4, 1))
    assert not plan_split(four, "t", 0.5).stratified
    assert split_sizes(split_train_test(four, "t", ["k"], 0.5)) == {"train": 2, "test": 2}
    assert split_sizes(split_train_test(ten, None, ["k"], 3)) == {"train": 7, "test": 3}
    with pytest.raises(SplitError):
        plan_split(four.limit(1), "t", 0.5)


@pytest.mark.parametrize("key", [["o_orderkey"], ["o_custkey"], None])
def test_split_is_exact_and_stable(table, key):
    df = table("orders")
    expected = df.groupBy("o_orderpriority").count().collect()
    total = sum(r["count"] for r in expected)
    one = split_train_test(df, "o_orderpriority", key, 0.2)
    tests = one.where("split = 'test'").groupBy("o_orderpriority").count().collect()
    assert sum(r["count"] for r in tests) == -(-total // 5)
    want = {r.o_orderpriority: r["count"] / 5 for r in expected}
    assert all(abs(r["count"] - want[r.o_orderpriority]) < 1 for r in tests)
    assert one.count() == total
    other = split_train_test(df.repartition(17), "o_orderpriority", key, 0.2)
    assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0


def test_split_with_equal_rows(frame):
    df = frame("t string, split int", *[("a", 1)] * 30, *[("b", 1)] * 10)
    rows = split_train_test(df, "t", None, 0.3, column="side")
    counts = {(r.t, r.side): r["count"] for r in rows.groupBy("t", "side").count().collect()}
    assert counts == {("a", "test"): 9, ("a", "train"): 21, ("b", "test"): 3, ("b", "train"): 7}


def test_split_with_one_hot_key(spark, monkeypatch):
    monkeypatch.setattr(split_module, "COPIES_PER_PIECE", 7)
    # A key that 60 rows share, 40 of them equal and with a missing cell.
    rows = [(i, f"u{i}", 1.0) for i in range(40)]
    rows += [(777, "same", None)] * 40 + [(777, f"v{i}", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "k int, `a.b` string, x double").repartition(3)
    for seed in (0, 1):
        out = split_train_test(df, None, ["k"], 0.5, seed)
        assert split_sizes(out) == {"test": 50, "train": 50}
        assert out.drop("split").exceptAll(df).count() == 0
        again = split_train_test(df.repartition(5), None, ["k"], 0.5, seed)
        assert out.exceptAll(again).count() == 0


def test_split_quota_of_zero(frame):
    df = frame("k int, t string", *[(i, "big") for i in range(97)], (97, "s"), (98, "s"), (99, "s"))
    rows = split_train_test(df, "t", ["k"], 0.1)
    assert split_sizes(rows) == {"train": 90, "test": 10}
    assert rows.where("t = 's' and split = 'test'").count() == 0


def test_classification_metrics(frame):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a"), ("b", "d")]
    row = classification_metrics(frame("y string, p string", *pairs), "y", "p").first()
    f1 = [2 * 5 / (7 + 6), 2 * 3 / (4 + 5), 0, 0]
    assert (row.row_count, row.accuracy, row.f1_macro) == (12, round(8 / 12, 6), round(np.mean(f1), 6))


def test_regression_metrics(frame):
    row = regression_metrics(frame("y double, p double", (1.0, 2.0), (3.0, 3.0), (5.0, 3.0)), "y", "p").first()
    assert (row.mae, row.rmse, row.r2) == (1.0, round((5 / 3) ** 0.5, 6), round(1 - 5 / 8, 6))
    flat = regression_metrics(frame("y double, p double", (1.0, 1.0), (1.0, 1.0)), "y", "p").first()
    assert flat.r2 == 1.0


def rank_auc(y, s):
    ranks = pd.Series(s).rank().to_numpy()
    pos = y.sum()
    return (ranks[y].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


@pytest.mark.parametrize("rows_per_range", [10, 700, 1_000_000])
def test_auc_equals_rank_formula(spark, rows_per_range):
    rng = np.random.default_rng(0)
    n = 3000
    score = np.where(rng.random(n) < 0.35, 0.5, rng.beta(0.1, 3, n))
    positive = rng.random(n) < score
    side = rng.choice(["train", "test"], n)
    df = spark.createDataFrame(pd.DataFrame({"s": score, "y": positive, "g": side}))
    found = {r.g: r.roc_auc for r in roc_auc(df, "s", "y", ["g"], rows_per_range).collect()}
    for g in ("train", "test"):
        assert found[g] == pytest.approx(rank_auc(positive[side == g], score[side == g]), abs=1e-6)
    whole = roc_auc(df, "s", "y", rows_per_range=rows_per_range).first().roc_auc
    assert whole == pytest.approx(rank_auc(positive, score), abs=1e-6)


def test_auc_edges(frame):
    assert roc_auc(frame("s double, y boolean", (0.1, True), (0.2, True)), "s", "y").first().roc_auc is None
    rows = [(c, [0.8 if i == c else 0.1 for i in range(3)]) for c in (0, 1, 2) for _ in range(4)]
    df = frame("y int, p array<double>", *rows)
    assert multiclass_roc_auc(df, "y", "p", 3).first().roc_auc == 1.0
    assert multiclass_roc_auc(df.where("y < 2"), "y", "p", 3).first().roc_auc is None


@pytest.mark.parametrize("rows_per_range", [50, 1_000_000])
def test_multiclass_auc_with_zeros_and_gaps(frame, rows_per_range):
    """Zeros are counted, not listed; negative, null and NaN scores, and rows without a label."""
    draw = np.random.default_rng(6)
    rows = []
    for k in range(700):
        scores = [float(draw.choice([0.0, 0.0, 0.0, -0.0, -0.2, 0.3, np.round(draw.random(), 2)])) for _ in range(4)]
        if k % 50 == 0:
            scores[k // 50 % 4] = None if k % 100 else float("nan")
        rows.append(("ab"[k % 2] if k % 7 else None, None if k % 90 == 0 else int(draw.integers(0, 4)), scores))
    df = frame("g string, y int, p array<double>", *rows)
    found = {r.g: r.roc_auc for r in multiclass_roc_auc(df, "y", "p", 4, ["g"], rows_per_range).collect()}
    for g in ("a", "b", None):
        areas = []
        for c in range(4):
            own = [(y == c, s[c]) for h, y, s in rows if h == g and y is not None and s[c] is not None and not np.isnan(s[c])]
            areas.append(rank_auc(np.array([y for y, _ in own]), np.array([s for _, s in own])))
        assert found[g] == pytest.approx(np.mean(areas), abs=2e-6)


def test_sparse_scores_move_few_rows(spark):
    """With one score per row that is not zero, as many rows are shuffled as with two classes."""
    n, classes = 400, 200
    one = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == F.col("id") % classes, 0.1 + F.col("id") % 7).otherwise(0.0))
    df = spark.range(n).select((F.col("id") % classes).cast("int").alias("y"), one.alias("p"))
    assert multiclass_roc_auc(df, "y", "p", classes).first().roc_auc == 1.0
    listed = F.filter("p", lambda s: s != 0)
    assert df.select(F.explode(listed)).count() == n


@pytest.mark.parametrize(
    "train, test, higher, gap, risk",
    [
        (0.9, 0.95, True, -0.05, "low"), (0.9, 0.85, True, 0.05, "low"),
        (0.9, 0.83, True, 0.07, "medium"), (0.9, 0.7, True, 0.2, "high"),
        (10.0, 11.0, False, 0.1, "low"), (10.0, 12.0, False, 0.2, "medium"),
        (10.0, 13.0, False, 0.3, "high"), (0.0, 0.5, False, 0.5, "high"),
        (None, 1.0, True, None, "unknown"),
    ],
)
def test_gap_and_risk(spark, train, test, higher, gap, risk):
    value = generalization_gap(
        F.lit(train).cast("double"), F.lit(test).cast("double"), F.lit(higher)
    )
    row = spark.range(1).select(value.alias("gap"), overfitting_risk(value, F.lit(higher)).alias("risk")).first()
    assert (row.gap, row.risk) == (gap, risk)


def test_best_experiment_and_status(frame):
    schema = "seq int, status string, primary_metric_value double, higher_is_better boolean"
    rows = frame(schema, (0, "success", 0.5, True), (1, "success", 0.7, True), (2, "success", 0.7, True),
                 (3, "failed", 0.9, True), (4, "success", float("nan"), True), (5, "success", None, True))
    assert best_experiment(rows).first().seq == 1
    assert run_status(rows).first().run_status == "completed_with_failures"
    lower = rows.withColumn("higher_is_better", F.lit(False))
    assert best_experiment(lower).first().seq == 0
    assert run_status(rows.where("status = 'success'")).first().run_status == "completed"
    assert run_status(rows.where("seq > 9")).first().run_status == "failed"


def ready(task_type, *candidates):
    return Recommendation("ready", task_type, candidates[0].model_name, "high", list(candidates))


def prepared(df, target, task_type, key=()):
    features = feature_columns(plan_of(df, target))
    return select_features(df, features, target, task_type, keep=key), features


def test_train_classification(frame, spark, folder):
    df = frame(
        "feature_a double, feature_b int, target int",
        *[(float(i), i % 3, int(i >= 10)) for i in range(20)],
    )
    data, features = prepared(df, "target", "classification")
    wanted = ready(
        "classification",
        forest_candidate("classification", "recommended", True, ""),
        linear_candidate("classification", "baseline", True),
    )
    result = train_candidates(data, features, "target", wanted, test_size=0.3, overrides=SMALL)
    assert result.status == "completed", result.errors
    assert (result.split.train_count, result.split.test_count) == (14, 6)
    rows = result.experiments.orderBy("seq").collect()
    assert all(r.primary_metric_name == "f1_macro" and "roc_auc" in r.test_metrics for r in rows)
    assert result.best["model_name"] in {r.model_name for r in rows}

    paths, warnings = save_models(result, folder)
    assert not warnings and [p.rsplit("/", 1)[1] for p in paths] == [
        "01_recommended_RandomForestClassifier", "02_baseline_LogisticRegression",
    ]
    again = PipelineModel.load(paths[1]).transform(df.drop("target")).select("predicted_label").collect()
    assert {r[0] for r in again} <= {"0", "1"}


def test_ridge_equals_normal_equations(spark, folder):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) * [1, 50]
    y = 3 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "target": y}))
    data, features = prepared(df, "target", "regression")
    wanted = ready("regression", linear_candidate("regression", "recommended", False))
    result = train_candidates(data, features, "target", wanted, ["a"], 0.25)
    row = result.experiments.first()
    assert row.primary_metric_name == "rmse" and set(row.test_metrics) == {"mae", "rmse", "r2"}
    assert (result.split.train_count, result.split.test_count) == (150, 50)

    side = split_train_test(df, None, ["a"], 0.25).toPandas()
    train, test = side[side.split == "train"], side[side.split == "test"]
    mean, std = train[["a", "b"]].mean(), train[["a", "b"]].std(ddof=0)
    z = ((train[["a", "b"]] - mean) / std).to_numpy()
    w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (train.target - train.target.mean()))
    model = result.models[0].stages[-1]
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-8)
    error = test.target - (((test[["a", "b"]] - mean) / std).to_numpy() @ w + train.target.mean())
    assert row.test_metrics["rmse"] == pytest.approx(float(np.sqrt((error**2).mean())), abs=1e-6)


@pytest.mark.parametrize("balanced", [False, True])
def test_logistic_gradient_is_zero(spark, balanced):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    y = (x + rng.normal(size=300) > 1).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"a": x, "weight": rng.normal(size=300), "target": y}))
    data, features = prepared(df, "target", "classification")
    wanted = ready("classification", linear_candidate("classification", "recommended", balanced))
    result = train_candidates(data, features, "target", wanted, ["a"], 0.25, overrides={"tol": 1e-12})
    assert result.status == "completed", result.errors
    train = split_train_test(df, "target", ["a"], 0.25).where("split = 'train'").toPandas()
    z = train[["a", "weight"]]
    z = ((z - z.mean()) / z.std(ddof=0)).to_numpy()
    model = result.models[0].stages[-2]
    w = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(z @ w + model.intercept)))
    counts = train.target.value_counts()
    sample = train.target.map(lambda c: len(train) / (2 * counts[c])) if balanced else 1.0
    gradient = z.T @ ((p - train.target) * sample) + w
    assert np.abs(gradient).max() < 1e-3


def test_train_multiclass_and_categories(frame):
    rows = [(float(i % 7), "pqrs"[i % 4], "xyz"[i % 3]) for i in range(120)]
    df = frame("num double, cat string, target string", *rows)
    data, features = prepared(df, "target", "classification")
    wanted = ready(
        "classification",
        categorical_candidate("classification", "recommended", 3),
        linear_candidate("classification", "baseline", False),
        boosting_candidate("classification", "challenger", ""),
    )
    result = train_candidates(data, features, "target", wanted, overrides=SMALL)
    rows = result.experiments.orderBy("seq").collect()
    assert [r.status for r in rows] == ["success"] * 3, result.errors
    assert rows[0].estimator == "HistogramBoosting"
    assert all("roc_auc" in r.test_metrics for r in rows)


def test_refused_skipped_and_failed(frame):
    df = frame("a double, target double", *[(float(i), 2.0 * i) for i in range(20)])
    data, features = prepared(df, "target", "regression")
    blocked = Recommendation("blocked", "regression", None, "low", blocked_reasons=["constant"])
    result = train_candidates(data, features, "target", blocked)
    assert result.status == "failed" and "constant" in result.errors
    wanted = ready(
        "regression",
        Candidate("Other", "recommended", "regression", {}, requires="no_such_package"),
        linear_candidate("regression", "baseline", False),
        Candidate("Unknown", "challenger", "regression", {}),
    )
    result = train_candidates(data, features, "target", wanted)
    rows = result.experiments.orderBy("seq").collect()
    assert [r.status for r in rows] == ["skipped", "success", "failed"]
    assert result.status == "completed_with_failures" and result.best["model_name"] == "Ridge"
    assert len(result.warnings) == 1 and len(result.errors) == 1
    assert train_candidates(data, features, "target", wanted, max_candidates=1).status == "failed"


def test_class_weights(frame):
    rows = class_weight_table(frame("t int", 0, 0, 0, 1, None), "t").collect()
    assert {r.label: r.weight for r in rows} == {0: 0.666667, 1: 2.0}


def test_config_is_immutable():
    with pytest.raises(AttributeError):
        AnalysisConfig().min_rows = 3
