import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscope.config import AnalysisConfig
from gridscope.functions.columns import to_number
from gridscope.functions.order import exact_quantiles
from gridscope.operators.target import (
    TargetError,
    class_distribution,
    numeric_summary,
    target_issues,
    target_summary,
)
from gridscope.operators.task import infer_task


def task(df, **options):
    row = infer_task(df, **options).first()
    return row.status, row.candidate_target, row.task_type


def test_target_names(frame):
    assert task(frame("a int, b int", (1, 2))) == ("not_found", None, None)
    assert task(frame("target int, label int", (1, 2))) == ("ambiguous", None, None)
    assert task(frame("a int, ` Label ` string", (1, "x"))) == ("ok", " Label ", "classification")
    assert task(frame("sales int", 100, 120, 140), candidates=("sales",))[2] == "regression"


@pytest.mark.parametrize(
    "schema, values, expected",
    [
        ("string", ["yes", "no", "yes"], "classification"),
        ("int", [0, 1, 0, 1], "classification"),
        ("double", [10.5, 20.1, 30.2, 40.8, 50.3], "regression"),
        ("int", [0, 1, 2, 0, 1, 2], "classification"),
        ("boolean", [True, False], "classification"),
        ("int", [0], "classification"),
        ("int", [1], "classification"),
        ("int", [7], "regression"),
        ("int", [1, 2], "classification"),
        ("int", [-1, 1], "classification"),
        ("int", [-1, 0], "regression"),
        ("int", [-1, 0, 1] * 3, "regression"),
        ("int", list(range(21)) * 3, "regression"),
        ("int", list(range(20)) * 3, "classification"),
        ("int", list(range(1, 21)) * 3, "classification"),
        ("int", [0, 1, 2], "regression"),
        ("int", [0, 2] * 4, "regression"),
        ("double", [0.5, 1.5], "regression"),
        ("double", [0.0, 1.0, float("nan"), 1.0], "classification"),
        ("double", [0.0, 1.0, float("inf")], "regression"),
        ("decimal(10,2)", [__import__("decimal").Decimal(v) for v in (0, 1, 1, 0)], "classification"),
        ("date", [dt.date(2024, 1, 1)], "classification"),
    ],
)
def test_task_rule(frame, schema, values, expected):
    assert task(frame(f"target {schema}", *values)) == ("ok", "target", expected)


def test_missing_target(frame):
    assert task(frame("target int", None, None)) == ("ambiguous", "target", None)
    assert task(frame("target double", float("nan"))) == ("ambiguous", "target", None)


def codes(summary, config=None):
    return [i.code for i in target_issues(summary, config).orderBy("seq").collect()]


def test_class_balance(frame):
    row = target_summary(frame("t int", 1, 1, 1, 0, 0), "t", "classification").first()
    assert (row.majority_class, row.majority_class_ratio) == ("1", 0.6)
    assert (row.minority_class, row.minority_class_ratio) == ("0", 0.4)
    assert row.class_imbalance_ratio == 1.5


def test_single_class(frame):
    summary = target_summary(frame("t int", 1, 1, 1), "t", "classification")
    assert codes(summary) == ["single_class_target"]
    assert summary.first().class_imbalance_ratio is None


def test_imbalance(frame):
    summary = target_summary(frame("t int", *[0] * 9, 1, None), "t", "classification")
    row = summary.first()
    assert (row.missing_ratio, row.class_imbalance_ratio) == (0.090909, 9.0)
    config = AnalysisConfig(minority_share=0.15)
    assert codes(summary, config) == ["target_missing_values", "class_imbalance"]


def test_many_classes_and_ties(frame):
    df = frame("t int", *range(60))
    assert codes(target_summary(df, "t", "classification"))[0] == "high_cardinality_classification_target"
    rows = class_distribution(frame("t string", "b", "a", "c", "a", "b", None), "t").collect()
    assert [tuple(r) for r in rows] == [("a", 2, 0.4), ("b", 2, 0.4), ("c", 1, 0.2)]
    row = target_summary(frame("t string", "b", "a"), "t", "classification").first()
    assert (row.majority_class, row.minority_class) == ("a", "b")


def test_timestamp_labels(frame):
    stamps = [dt.datetime(2024, 1, d, 10) for d in (1, 1, 2)]
    rows = class_distribution(frame("t timestamp", *stamps), "t").collect()
    assert [r.label for r in rows] == ["2024-01-01T10:00:00", "2024-01-02T10:00:00"]


def test_regression_summary(frame):
    df = frame("t int", 10, 20, 30, 40)
    row = numeric_summary(df, "t").first()
    assert (row["count"], row.mean, row.median, row.minimum, row.maximum) == (4, 25, 25, 10, 40)
    assert codes(target_summary(df, "t", "regression")) == []


def test_bad_regression_targets(frame):
    summary = target_summary(frame("t string", "10", "bad-value", "30"), "t", "regression")
    assert codes(summary) == ["non_numeric_regression_target"]
    assert summary.first().invalid_numeric_count == 1
    summary = target_summary(frame("t string", "x", "y"), "t", "regression")
    assert codes(summary) == ["non_numeric_regression_target", "empty_numeric_regression_target"]
    summary = target_summary(frame("t string", "1", "1.0"), "t", "regression")
    assert codes(summary) == ["constant_regression_target"]
    summary = target_summary(frame("t int", None, None), "t", "regression")
    assert codes(summary) == ["target_missing_values", "target_all_missing"]
    assert numeric_summary(frame("t int", None, None), "t").first()["count"] == 0
    with pytest.raises(TargetError):
        target_summary(frame("t int", 1), "u", "regression")


def test_numbers_from_text(spark):
    values = ["10", "bad", " 7 ", "1e3", "nan", "inf", "-Infinity", "+5", "0x1A", "1_000", "10d",
              "10f", "1e400", "", ".5", "5.", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(
        to_number(F.col("v"), T.StringType())
    ).collect()
    series = pd.to_numeric(pd.Series(values, dtype=object), errors="coerce")
    expected = [None if pd.isna(x) else float(x) for x in series]
    expected[values.index("1e400")] = None
    assert [r[0] for r in rows] == expected


@pytest.mark.parametrize("size", [1, 2, 3, 5, 1000])
def test_statistics_equal_pandas(spark, size):
    x = pd.Series(np.random.default_rng(size).lognormal(size=size))
    row = numeric_summary(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    expected = [
        len(x), x.mean(), x.std(), x.min(), x.quantile(0.25), x.median(), x.quantile(0.75), x.max(), x.skew(),
    ]
    for got, want in zip(row, expected):
        assert got is None if pd.isna(want) else got == pytest.approx(want, abs=1e-6)


def test_constant_skewness(frame):
    assert numeric_summary(frame("t int", 3, 3, 3), "t").first().skewness == 0.0
    assert numeric_summary(frame("t int", 3, 3), "t").first().skewness is None


@pytest.mark.parametrize("limit", [1, 7, 100])
def test_exact_quantiles_in_many_rounds(spark, limit):
    rng = np.random.default_rng(1)
    columns = {
        "heavy": rng.standard_cauchy(5000) * 1e6,
        "hot": np.where(rng.random(5000) < 0.4, 5.0, rng.normal(5, 1, 5000)),
        "few": rng.integers(0, 3, 5000).astype(float),
        "mixed": np.concatenate([np.full(2500, -1e300), np.linspace(0, 1, 2500)]),
    }
    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(5)
    probabilities = [0.0, 0.25, 0.5, 0.501, 0.75, 0.999, 1.0]
    found = exact_quantiles(df, list(columns), probabilities, list_limit=limit)
    for name, values in columns.items():
        assert found[name] == pytest.approx(list(np.quantile(values, probabilities)), rel=1e-12)
