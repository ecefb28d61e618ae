"""Ordered target statistics against plain loops; no row sees its own label."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from gridscope.operators.features import FeatureColumns
from gridscope.operators.models import save_models, train_candidates
from gridscope.operators.recommend import Recommendation, categorical_candidate
from gridscope.operators.statistics import BUCKETS, TargetStatisticsModel, fit_target_statistics, order_bucket


def table_of(frame, rows):
    return frame("id long, a string, b string, y double", *rows).withColumn("step", order_bucket(F.col("id")))


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_against_plain_loops(frame, classes):
    draw = random.Random(classes)
    label = (lambda: draw.uniform(-5, 90)) if not classes else (lambda: float(draw.randrange(classes)))
    # One value holds a third of all rows, some stand alone.
    rows = [(k, draw.choice(["=hot", f"={k % 7}", f"={k}"]), f"={k % 3}", label()) for k in range(600)]
    df = table_of(frame, rows)
    told = [tuple(r) for r in df.collect()]
    outputs = [lambda y: y] if not classes else [lambda y, k=k: float(y == k) for k in (range(classes) if classes > 2 else (1,))]
    prior = [sum(o(y) for *_, y, _ in told) / len(told) for o in outputs]
    model, ordered = fit_target_statistics(df.repartition(5), ["a", "b"], "y", classes, "step")
    assert ordered.count() == len(rows)
    for r in ordered.collect():
        for i, name in enumerate(("a", "b")):
            for k, o in enumerate(outputs):
                seen = [o(y) for *_, y, step in [t for t in told if t[1 + i] == r[name]] if step < r["step"]]
                assert r[f"__stat_{i}_{k}"] == pytest.approx((sum(seen) + prior[k]) / (len(seen) + 1), abs=1e-6)
    unseen = frame("a string, b string", ("=hot", "=1"), ("=never", None))
    found = {r["a"]: r for r in model.transform(unseen).collect()}
    for k, o in enumerate(outputs):
        hot = [o(y) for _, a, _, y, _ in told if a == "=hot"]
        assert found["=hot"][f"__stat_0_{k}"] == pytest.approx((sum(hot) + prior[k]) / (len(hot) + 1), abs=1e-6)
        assert found["=never"][f"__stat_0_{k}"] == found["=never"][f"__stat_1_{k}"] == pytest.approx(prior[k], abs=1e-6)
    again, _ = fit_target_statistics(df.repartition(2), ["a", "b"], "y", classes, "step")
    assert sorted(map(tuple, again.table.collect())) == sorted(map(tuple, model.table.collect()))


def test_steps_are_even(spark):
    counts = [r["count"] for r in spark.range(64_000).groupBy(order_bucket(F.col("id"))).count().collect()]
    assert len(counts) == BUCKETS and max(counts) < 1300


def fitted(frame, rows, classes, **overrides):
    df = frame("id long, c string, y int", *rows)
    candidate = categorical_candidate("classification", "recommended", classes)
    wanted = Recommendation("ready", "classification", candidate.model_name, "high", [candidate])
    training = train_candidates(df, FeatureColumns([], ["c"], []), "y", wanted, ["id"], overrides=overrides)
    assert training.errors == []
    return df, training


def test_labels_do_not_leak(frame):
    """A category per row says nothing; statistics with the row's own label would say all."""
    draw = random.Random(4)
    rows = [(k, f"own{k}", draw.randrange(2)) for k in range(800)]
    _, training = fitted(frame, rows, 2, iterations=30)
    scores = training.experiments.first()
    majority = max(sum(y for *_, y in rows), sum(1 - y for *_, y in rows)) / len(rows)
    assert scores["train_metrics"]["accuracy"] <= majority + 0.02 and scores["test_metrics"]["roc_auc"] == pytest.approx(0.5, abs=0.02)


def test_categories_are_learned_saved_and_loaded(frame, folder):
    draw = random.Random(5)
    kinds = {f"k{n}": n % 3 for n in range(300)}
    rows = [(k, c := draw.choice(list(kinds)), kinds[c] if draw.random() < 0.95 else draw.randrange(3)) for k in range(6000)]
    df, training = fitted(frame, rows, 3, iterations=20, learning_rate=0.3)
    assert training.experiments.first()["test_metrics"]["accuracy"] > 0.9
    paths, warnings = save_models(training, folder)
    assert warnings == []
    loaded = PipelineModel.load(paths[0])
    assert any(isinstance(s, TargetStatisticsModel) for s in loaded.stages)
    before, after = ({r["id"]: r["predicted_label"] for r in m.transform(df).select("id", "predicted_label").collect()} for m in (training.models[0], loaded))
    assert before == after and len(after) == len(rows)
