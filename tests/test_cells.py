"""Forests predict once per cell of their cuts, and learn in tasks of a bounded size."""

from contextlib import contextmanager

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gridscope.operators import cells, models
from gridscope.operators.features import FeatureColumns
from gridscope.operators.recommend import Candidate, Recommendation


@pytest.mark.parametrize("distinct", [5, 4000])
def test_equals_predictions_of_rows(spark, distinct):
    x, z = F.col("id") % distinct, F.col("id") * 7 % 3
    rows = spark.range(4000).select("id", array_to_vector(F.array((x / 3).cast("double"), F.lit(0.0), z.cast("double"))).alias("v"), ((x + z) % 3).cast("double").alias("y"))
    forest = RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=5, maxDepth=8, seed=1).fit(rows)
    outputs = ["prediction", vector_to_array("probability").alias("p")]
    want = {r["id"]: r for r in forest.transform(rows).select("id", *outputs).collect()}
    with contextmanager(cells.predicted_by_cells)(forest, rows, "v", ["id", "y"], ["prediction", "probability"]) as found:
        assert found.columns == ["id", "y", "prediction", "probability"]
        assert {r["id"]: r for r in found.select("id", *outputs).collect()} == want


def test_few_cells_are_predicted(spark, frame, monkeypatch):
    """The forest transforms no more rows than it has cells, and learns in as few tasks as the rows need."""
    seen, parts = [], []
    fit = models.RandomForestClassifier.fit
    model_class = __import__("pyspark.ml.classification", fromlist=["x"]).RandomForestClassificationModel
    plain = model_class.transform
    monkeypatch.setattr(model_class, "transform", lambda self, df, *more: (seen.append(df.count()), plain(self, df, *more))[1])
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda self, df, *more: (parts.append(df.rdd.getNumPartitions()), fit(self, df, *more))[1])
    monkeypatch.setattr(models, "FOREST_ROWS", 300)
    rows = frame("k long, c string, x long, y string", *[(k, "ab"[k % 2], k % 4, "uv"[k % 4 > 1]) for k in range(1000)])
    candidate = Candidate("RandomForestClassifier", "recommended", "classification", {"n_estimators": 3, "random_state": 1})
    wanted = Recommendation("ready", "classification", candidate.model_name, "high", [candidate])
    training = models.train_candidates(rows.repartition(7), FeatureColumns(["x"], ["c"], []), "y", wanted, ["k"])
    assert training.errors == [] and training.experiments.first()["test_metrics"]["accuracy"] == 1.0
    assert seen and max(seen) <= 20 and parts == [3]


def test_categories_stay_apart(frame):
    """One-hot slots are categories to Spark, whose splits name the side, not a threshold."""
    rows = frame("k long, c string, y string", *[(k, "abcd"[k % 4], "uuvw"[k % 4]) for k in range(1200)])
    candidate = Candidate("RandomForestClassifier", "recommended", "classification", {"n_estimators": 20, "random_state": 1})
    wanted = Recommendation("ready", "classification", candidate.model_name, "high", [candidate])
    training = models.train_candidates(rows, FeatureColumns([], ["c"], []), "y", wanted, ["k"])
    found = training.experiments.first()
    assert training.errors == [] and found["train_metrics"]["accuracy"] == found["test_metrics"]["accuracy"] == 1.0
    cuts = cells.forest_cuts(training.models[0].stages[-2], training.models[0].stages[-2].numFeatures)
    assert cuts and all(c in ([], [0.0, 1.0]) for c in cuts)
