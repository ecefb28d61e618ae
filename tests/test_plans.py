import os

import pytest

from gridscope.config import AnalysisConfig
from gridscope.plans.analyze import analyze_table, save_analysis
from gridscope.plans.report import report_lines
from gridscope.plans.train import save_training, train_table

SMALL = {"numTrees": 3, "maxDepth": 3, "maxIter": 3}


def test_ready(spark, frame):
    df = frame("feature_a int, feature_b double, target int", (1, 1.5, 0), (2, 2.5, 1), (3, 3.5, 0), (4, 4.5, 1))
    run = analyze_table(spark, df)
    assert run.status == "completed" and run.verdict == "ready_for_training_approval", run.errors
    assert run.recommendation.recommended_model == "HistGradientBoostingClassifier"
    assert run.recommendation.confidence == "high"
    assert [(c.role, c.model_name) for c in run.recommendation.candidates] == [
        ("recommended", "HistGradientBoostingClassifier"),
        ("baseline", "LogisticRegression"),
        ("challenger", "RandomForestClassifier"),
    ]
    assert run.is_ready_for_training and not run.requires_target


def test_categorical_boosting(spark, frame):
    rows = [("xy"[i % 2], "pq"[i // 3], f"c{i}", i % 2) for i in range(6)]
    df = frame("town string, trade string, member_id string, target int", *rows)
    run = analyze_table(spark, df, AnalysisConfig(allow_optional_models=True))
    chosen = run.recommendation.candidates[0]
    assert chosen.model_name == "CategoricalBoostingClassifier"
    assert chosen.params["loss_function"] == "Logloss"
    plain = analyze_table(spark, df).recommendation
    assert plain.recommended_model == "RandomForestClassifier" and plain.confidence == "medium"
    linear = analyze_table(spark, df, AnalysisConfig(prefer_interpretable=True)).recommendation
    assert [c.role for c in linear.candidates] == ["recommended", "challenger"]


def test_imbalanced_and_regression(spark, frame):
    df = frame("a int, b double, target int", *[(i, i / 2, int(i == 9)) for i in range(10)])
    forest = analyze_table(spark, df).recommendation.candidates[0]
    assert (forest.model_name, forest.params["class_weight"]) == ("RandomForestClassifier", "balanced")
    df = frame("a int, b double, target double", *[(i, i / 2, 1.5 * i) for i in range(10)])
    found = analyze_table(spark, df).recommendation
    assert [c.model_name for c in found.candidates] == [
        "HistGradientBoostingRegressor", "Ridge", "RandomForestRegressor",
    ]
    assert found.confidence == "high"


def test_load_failed(spark, folder):
    path = os.path.join(folder, "a.csv")
    with open(path, "w") as out:
        out.write("target,target,feature\n1,2,3\n")
    run = analyze_table(spark, path)
    assert run.status == "load_failed" and run.verdict == "failed" and not run.tables
    lines = report_lines(spark, run).collect()
    # Nothing was read, so only the run itself has lines.
    assert {r.section for r in lines} == {"analysis"}
    told = {r.name: r.value for r in lines}
    assert (told["status"], told["verdict"]) == ("load_failed", "failed") and "target" in told["errors"]
    assert train_table(run).status == "not_ready"


def test_validation_failed(spark, frame):
    run = analyze_table(spark, frame("a int", 1))
    assert run.status == "validation_failed" and "column_profile" not in run.tables


def test_no_target(spark, frame):
    df = frame("a int, b int", (1, 2), (3, 4))
    run = analyze_table(spark, df)
    assert run.status == "completed" and run.requires_target
    assert run.verdict == "requires_user_input" and "target_summary" not in run.tables
    again = analyze_table(spark, df, target="b")
    assert again.target == "b" and again.verdict == "ready_for_training_approval"


def test_blocked(spark, frame):
    df = frame("feature_a int, feature_b int, target int", (None, 1, 0), (None, None, 1), (None, None, 0))
    run = analyze_table(spark, df, AnalysisConfig(missing_cell_critical=0.40))
    assert run.verdict == "blocked" and not run.is_ready_for_model_planning
    assert run.recommendation.candidates == [] and run.recommendation.blocked_reasons
    constant = analyze_table(spark, frame("a int, target int", (1, 1), (2, 1), (3, 1)))
    assert constant.verdict == "blocked"
    assert train_table(constant).status == "not_ready"


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "staff.csv")
    with open(path, "w") as out:
        out.write("height,salary,months,target\n")
        for i in range(20):
            out.write(f"{22 + i},{2000 + 150 * i},{3 * i + i % 4},{int(i >= 10)}\n")
    run = analyze_table(spark, path, run_id="r7")
    return run, train_table(run, overrides=SMALL)


def test_end_to_end(trained):
    run, training = trained
    assert training.status == "completed", training.errors
    assert training.training.best["model_name"]
    assert training.training.feature_count == 3


def test_saved_results(spark, trained, folder):
    run, training = trained
    paths = save_analysis(spark, run, folder)
    assert {os.path.basename(p) for p in paths} >= {"analysis", "column_profile", "model_candidates"}
    saved = save_training(spark, training, folder)
    assert len(saved) == 6 and not training.warnings
    assert spark.read.parquet(os.path.join(folder, "experiments")).count() == 3
    back = spark.read.parquet(os.path.join(folder, "column_profile"))
    assert {r.run_id for r in back.collect()} == {"r7"} and back.count() == 4


def test_report(spark, trained):
    lines = report_lines(spark, trained[0])
    run, rows = trained[0], lines.collect()
    # Every cell of every result but the data itself, and no other.
    results = {n: t for n, t in run.tables.items() if n not in ("preview", "class_distribution") and t.count()}
    cells = sum(t.count() * len([c for c in t.columns if c not in ("seq", "position")]) for t in results.values())
    assert {r.section for r in rows} == {"analysis", *results}
    assert len([r for r in rows if r.section != "analysis"]) == cells == len({(r.section, r.item, r.name) for r in rows if r.section != "analysis"})
    facts = {(r.section, r.item, r.name): r.value for r in rows}
    assert facts["source", 0, "row_count"] == "20" and facts["target_summary", 0, "class_imbalance_ratio"] == "1.000000"
    assert facts["quality_summary", 0, "possible_id_columns"] == "" and facts["analysis", 0, "verdict"] == run.verdict
    assert facts["model_candidates", 0, "model_name"] == run.recommendation.candidates[0].model_name
    assert [facts["column_profile", k, "column_name"] for k in range(len(run.data.columns))] == run.data.columns
