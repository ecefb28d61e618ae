"""The registered queries against SQL on the smallest data, and the shape of their plans."""

import contextlib
import io

import pytest

import __spark_entry__ as contract
from catalog.tables import load
from gridscope.operators.metrics import classification_metrics, roc_auc
from gridscope.operators.profile import profile_columns
from gridscope.operators.quality import duplicate_rows, quality_summary
from gridscope.operators.split import split_train_test
from gridscope.operators.target import class_distribution, target_summary
from gridscope.operators.validate import table_counts

from .conftest import DATA
from .oracle_check import database, differences

# Training has tests of its own, and the whole catalog is checked on larger data by
# `python -m tests.oracle_check`.
SLOW = {"analysis_runs", "training_run", "training_run_outcome", "model_sink", "result_sink", "report_lines"}
CHECKED = [
    name for name in contract.oracle_sql() if name not in SLOW and name not in contract.LLM_REGISTRY and not name.startswith("model_candidates")
]


@pytest.fixture(scope="module")
def connection():
    return database(DATA)


def test_contract():
    names = set(contract.queries())
    assert set(contract.oracle_sql()) <= names
    without = names - set(contract.oracle_sql()) - set(contract.LLM_REGISTRY)
    assert all(name.startswith("train") for name in without)


def test_entry(spark):
    assert contract.entry(spark).count() == 6


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, connection, name):
    assert differences(spark, connection, DATA, name) == []


def test_the_check_finds_differences(spark, connection, monkeypatch):
    right = contract.oracle_sql()["class_weights"]
    for wrong in (
        right.replace("AS weight", "+ 1 AS weight"),
        right.replace("AS label", "AS name"),
        right + " LIMIT 1",
        right.replace("count(*) AS count", "CAST(count(*) AS DOUBLE) AS count"),
    ):
        monkeypatch.setattr(contract, "oracle_sql", lambda: {"class_weights": wrong})
        assert differences(spark, connection, DATA, "class_weights")


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_plans(spark):
    lines, documents = (load(spark, DATA, name) for name in ("lineitem", "documents"))
    plans = {
        "profile": profile_columns(lines, with_samples=False),
        "counts": table_counts(lines),
        "duplicates": duplicate_rows(documents),
        "summary": quality_summary(documents),
        "classes": class_distribution(lines, "l_returnflag"),
        "target": target_summary(lines, "l_extendedprice", "regression", 5),
        "f1": classification_metrics(lines, "l_returnflag", "l_linestatus"),
        "split": split_train_test(lines, "l_returnflag", ["l_orderkey", "l_linenumber"]),
    }
    for name, df in plans.items():
        text = plan_of(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "PythonUDF" not in text and "ArrowEvalPython" not in text, name
        assert "SinglePartition" not in text or "Window" not in text, name


def test_only_needed_columns_are_read(spark):
    lines = load(spark, DATA, "lineitem")
    text = plan_of(class_distribution(lines, "l_returnflag"))
    assert "struct<l_returnflag:string>" in text and "l_orderkey" not in text
    text = plan_of(target_summary(lines, "l_extendedprice", "regression", 5))
    assert "ReadSchema: struct<l_extendedprice:double>" in text
    # A known distinct count leaves one row per task to shuffle.
    assert text.count("hashpartitioning") == 0


def test_split_moves_no_row(spark):
    lines = load(spark, DATA, "lineitem")
    text = plan_of(split_train_test(lines, "l_returnflag", ["l_orderkey", "l_linenumber"]))
    assert "hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_auc_plan_has_no_global_window(spark):
    lines = load(spark, DATA, "lineitem").selectExpr("l_extendedprice s", "l_returnflag = 'R' y")
    text = plan_of(roc_auc(lines, "s", "y", rows_per_range=500))
    assert "BroadcastNestedLoopJoin" not in text and "Bucketizer" not in text
    assert "range" in text
