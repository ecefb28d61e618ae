"""Defects found in review: each test failed before its repair."""

import math
import os

import pytest
from pyspark.sql import functions as F

from gridscope.config import AnalysisConfig
from gridscope.functions.tables import kept
from gridscope.operators import split as split_module
from gridscope.operators.features import FeatureColumns, fit_preprocessing, plan_features
from gridscope.operators.metrics import roc_auc
from gridscope.operators.models import train_candidates
from gridscope.operators.profile import profile_columns
from gridscope.operators.quality import duplicate_rows
from gridscope.operators.recommend import Recommendation, boosting_candidate, linear_candidate
from gridscope.operators.split import split_train_test
from gridscope.sources.reader import LoadError, read_table
from gridscope.sources.sink import write_results


def files(folder, **texts):
    for name, text in texts.items():
        with open(os.path.join(folder, name + ".csv"), "w") as out:
            out.write(text)
    return folder


def test_labels_of_both_zeros_are_one_class(spark, frame):
    rows = [(float(i), (0.0, -0.0, 1.0)[i % 3]) for i in range(30)]
    df = frame("a double, y double", *rows)
    wanted = Recommendation("ready", "classification", "LogisticRegression", "high", [linear_candidate("classification", "baseline", False)])
    training = train_candidates(df, FeatureColumns(["a"], [], []), "y", wanted, ["a"])
    assert training.status == "completed", training.errors
    assert training.split.train_count + training.split.test_count == 30
    assert training.split.class_count == 2


def test_a_rerun_without_rows_replaces_the_rows(spark, folder, frame):
    issues = frame("seq int, text string", (1, "x"))
    write_results({"issues": issues}, folder, "r1")
    write_results({"issues": issues.limit(0)}, folder, "r1")
    back = spark.read.parquet(os.path.join(folder, "issues"))
    assert back.count() == 0 and set(back.columns) == {"seq", "text", "run_id"}


def test_part_files_with_other_headers(spark, folder):
    with pytest.raises(LoadError, match="different headers"):
        read_table(spark, files(folder, one="a,b\n1,x\n", two="b,a\ny,2\n"), "csv")


def test_part_files_with_one_header(spark, folder):
    rows = read_table(spark, files(folder, one='"a",b\n1,x\n', two="a,b\n2,y\n"), "csv").collect()
    assert sorted(map(tuple, rows)) == [(1, "x"), (2, "y")]


def test_a_quote_inside_a_field_is_no_line_break(spark, folder):
    path = os.path.join(files(folder, one='id,name\n1,5" pipe\n2,"two\n'.replace('"two', "two")), "one.csv")
    df = read_table(spark, path)
    assert sorted(map(tuple, df.collect())) == [(1, '5" pipe'), (2, "two")]
    assert "multiLine=true" not in df._jdf.queryExecution().toString()


def test_slots_only_where_categories_are_indexed(spark, frame):
    df = frame("c string, y int", *[(f"v{i}", i % 2) for i in range(400)])
    for one_hot, most, slots in ((True, 0, {}), (False, 400, {0: 401})):
        prepared = fit_preprocessing(df, FeatureColumns([], ["c"], []), one_hot=one_hot)
        assert (prepared.max_categories, prepared.slots) == (most, slots)
    left = fit_preprocessing(df, FeatureColumns([], ["c"], []), encoded=False)
    assert left.categories == ["__cat_0"] and len(left.stages) == 1


def test_scores_that_are_not_numbers(spark, frame):
    rows = [(i / 10, i % 3 == 0) for i in range(20)] + [(math.nan, True), (None, False)]
    df = frame("s double, y boolean", *rows)
    areas = {roc_auc(df, "s", "y", rows_per_range=n).first()["roc_auc"] for n in (1, 2, 7, 1000)}
    assert len(areas) == 1


def test_split_moves_no_table(spark, frame):
    df = frame("k int, y string", *[(i, "ab"[i % 4 == 0]) for i in range(80)])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = split_train_test(df, "y", ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_split_of_many_classes_is_the_same(spark, frame, monkeypatch):
    df = frame("k int, y string", *[(i, f"c{i % 7}") for i in range(210)], *[(7, "c1")] * 9, (1, None), (2, None))
    few = sorted(map(str, split_train_test(df, "y", ["k"], 0.3).collect()))
    monkeypatch.setattr(split_module, "BROADCAST_CLASSES", 0)
    assert sorted(map(str, split_train_test(df, "y", ["k"], 0.3).collect())) == few


def test_kept_tables_leave_nothing(spark, frame):
    with kept(frame("a int, `b.c` string", (1, "x"))) as table:
        path = table.inputFiles()[0]
        assert [tuple(r) for r in table.collect()] == [(1, "x")]
    assert not os.path.exists(os.path.dirname(path.removeprefix("file:")))


def test_bounds_are_settings(spark, frame):
    df = frame("c string, d string, y int", *[(f"v{i % 30}", "pq"[i % 2], i % 2) for i in range(60)])
    profile = profile_columns(df, with_samples=False)
    reasons = lambda config: {r["column_name"]: r["exclusion_reason"] for r in plan_features(profile, "y", config).collect()}
    assert reasons(AnalysisConfig())["c"] is None
    assert reasons(AnalysisConfig(max_categories=10)) == {"c": "too_many_categories", "d": None}
    wanted = Recommendation("ready", "classification", "LogisticRegression", "high", [linear_candidate("classification", "baseline", False)])
    rows = frame("a double, y int", *[(float(i), int(i >= 300)) for i in range(600)])
    training = train_candidates(rows, FeatureColumns(["a"], [], []), "y", wanted, ["a"], max_train_rows=100)
    assert training.status == "completed", training.errors
    assert training.summary_table(spark).first()["train_rows"] == 480


def test_boosting_may_stop_early(spark, frame):
    rows = frame("a double, y int", *[(float(i), i * i % 7 % 2) for i in range(200)])
    candidate = boosting_candidate("classification", "recommended", "")
    wanted = Recommendation("ready", "classification", candidate.model_name, "high", [candidate])
    training = train_candidates(rows, FeatureColumns(["a"], [], []), "y", wanted, ["a"], overrides={"maxIter": 40}, early_stopping=0.01)
    assert training.status == "completed", training.errors
    assert training.models[0].stages[-2].describe()["rounds"] and len(training.models[0].stages[-2].describe()["rounds"]) < 40


def test_wide_duplicates(spark, frame):
    rows = [(1, 0.0, "a", None, "bc"), (1, -0.0, "a", None, "bc"), (1, 0.0, "ab", None, "c"), (1, 0.0, "a", "n", "bc"), (None, None, None, None, None), (None, None, None, None, None)]
    df = frame("a int, b double, c string, d string, e string", *rows)
    assert duplicate_rows(df).first()["duplicate_row_count"] == 2
    assert duplicate_rows(df.drop("e")).first()["duplicate_row_count"] == 2


def test_scores_stay_where_they_are_for_the_totals_of_ranges(spark):
    from gridscope.operators.metrics import _areas

    made = spark.range(400).selectExpr("id % 2 AS side", "id / 400 AS score", "id % 3 AS pos", "id % 5 AS neg")
    bounds = [float("-inf"), 0.25, 0.5, 0.75, float("inf")]
    moved, stays = (_areas(made, "score", ["side"], bounds, most) for most in (None, 2))
    hint = lambda df: "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hint(stays) and not hint(moved) and not hint(_areas(made, "score", ["side"], bounds, 50_000))
    assert sorted(moved.collect()) == sorted(stays.collect()) == sorted(_areas(made, "score", ["side"], None).collect())
