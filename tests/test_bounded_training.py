"""Which rows the learners see, and what covers all rows regardless."""

import pytest

from gridscope.operators import models
from gridscope.operators.features import FeatureColumns
from gridscope.operators.recommend import Candidate, Recommendation

CANDIDATE = Candidate("RandomForestRegressor", "recommended", "regression", {"n_estimators": 2, "random_state": 1})
WANTED = Recommendation("ready", "regression", CANDIDATE.model_name, "high", [CANDIDATE])


@pytest.mark.parametrize("key", [["k"], None])
def test_dominant_feature_row(frame, monkeypatch, key):
    seen, fit = [], models.RandomForestRegressor.fit

    def spy(self, vectors, *more):
        one = vectors.groupBy(models.FEATURES).count().agg({"count": "max"}).first()[0]
        seen.append((vectors.count(), one, vectors.where(models.STOPPING).count()))
        return fit(self, vectors, *more)

    monkeypatch.setattr(models.RandomForestRegressor, "fit", spy)
    # One feature row holds four of five rows, all with one label.
    rows = frame("k long, c string, y double", *[(k, "a" if k % 5 else f"c{k % 4}", 1.0 if k % 5 else float(k % 7)) for k in range(2000)])
    rows = rows if key else rows.drop("k")
    for parts in (1, 7):
        training = models.train_candidates(rows.repartition(parts), FeatureColumns([], ["c"], []), "y", WANTED, key, max_train_rows=400)
        assert training.errors == []
    (count, one, stopping), again = seen
    assert 320 <= count <= 480 and 0.7 * count <= one <= 0.9 * count and 0.04 * count <= stopping <= 0.18 * count
    assert again == seen[0]


def test_rare_categories_are_known(frame):
    # One row in 500 has a category of its own, and the learner sees one in ten.
    rows = frame("k long, c string, y double", *[(k, f"rare{k}" if k % 500 == 0 else "ab"[k % 2], float(k % 2)) for k in range(5000)])
    training = models.train_candidates(rows, FeatureColumns([], ["c"], []), "y", WANTED, ["k"], max_train_rows=400)
    assert training.errors == []
    whole = models.train_candidates(rows, FeatureColumns([], ["c"], []), "y", WANTED, ["k"])
    assert training.models[0].stages[-1].numFeatures == whole.models[0].stages[-1].numFeatures > 8
