"""Forests by histograms against plain loops, over other partitions and blocks, saved and loaded."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog import queries
from gridscope.operators import forest as forest_module
from gridscope.operators import models
from gridscope.operators.boosting import Bins
from gridscope.operators.features import FeatureColumns
from gridscope.operators.forest import ForestSettings, HistogramForest, _allowed, grown
from gridscope.operators.recommend import Candidate, Recommendation

BINS = Bins([[0, 1, 2, 3, 4, 5], [], [0, 1]], [0, 5, 0])


def plain(codes, stats, settings, depth=0):
    """Splits in order of depth and place: (feature, code) or the sums of a leaf."""
    weights = np.array(settings.weights or [1.0] * settings.classes)
    count = lambda x: x.sum() if settings.classes else x[0]
    side = lambda x: ((x * weights) ** 2).sum() / (x * weights).sum() if settings.classes else x[1] ** 2 / x[0]
    level, out = [np.arange(codes.shape[1])], []
    while level:
        following = []
        for on in level:
            total, best = stats[:, on].sum(axis=1), None
            may = count(total) >= 2 * settings.least_rows and (settings.depth is None or depth < settings.depth)
            for f in range(len(codes)) if may and not (settings.classes and total.max() == total.sum()) else ():
                for code in sorted(set(codes[f, on])):
                    goes = codes[f, on] == code if BINS.categories[f] else codes[f, on] <= code
                    low = stats[:, on[goes]].sum(axis=1)
                    if min(count(low), count(total - low)) < settings.least_rows:
                        continue
                    gain = side(low) + side(total - low) - side(total)
                    if gain > 1e-12 * side(total) and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = gain, f, code, goes
            out.append(best[1:3] if best else tuple(total))
            following += [on[best[3]], on[~best[3]]] if best else []
        level, depth = following, depth + 1
    return out


@pytest.mark.parametrize("classes, depth, least", [(3, None, 1), (3, 3, 2), (2, None, 5), (0, None, 2), (0, 4, 1)])
def test_a_tree_equals_plain_loops(classes, depth, least):
    draw = np.random.default_rng(classes + least)
    codes = np.unique(np.stack([draw.integers(0, n, 60) for n in (7, 4, 3)]).astype(np.uint8), axis=1)
    stats = draw.integers(0, 4, (classes or 2, codes.shape[1])).astype(float)
    stats[0] += 1
    if not classes:
        stats[1] = draw.integers(0, 1000, codes.shape[1]) * stats[0]
    settings = ForestSettings(classes, 1, depth, least, weights=[1.0, 2.5, 0.5][:classes])
    found, want = grown(codes, stats, settings, BINS, draw), plain(codes, stats, settings)
    assert len(found.feature) == len(want) > 3
    cuts, leaves, weights = iter(found.cut), iter(found.values), np.array(settings.weights)
    for feature, node in zip(found.feature, want):
        if feature >= 0:
            assert (feature, next(cuts)) == node
        else:
            share = np.array(node) * weights / (np.array(node) * weights).sum() if classes else [np.rint(node[1] / node[0])]
            assert next(leaves) == pytest.approx(share, abs=1e-8)
    # Each cell's leaf is the one whose sums it is in.
    leaf = found.leaves(codes, BINS.is_category)
    sums = [tuple(stats[:, leaf == k].sum(axis=1)) for k in range(leaf.max() + 1)]
    assert sums == [tuple(w) for f, w in zip(found.feature, want) if f < 0]


@pytest.mark.parametrize("slots", [5, 64, 65, 900])
def test_a_node_looks_at_the_root_of_its_features(slots):
    node, slot = (x.ravel() for x in np.indices((200, slots)))
    looked = _allowed(ForestSettings(2, subset="sqrt"), slots, 200, np.random.default_rng(1))(node, slot).reshape(200, slots)
    assert (looked.sum(axis=1) == int(np.ceil(np.sqrt(slots)))).all()
    assert looked.any(axis=0).mean() > 0.9 and len(np.unique(looked, axis=0)) > 9


def wanted(task_type, **params):
    name = "RandomForestClassifier" if task_type == "classification" else "RandomForestRegressor"
    candidate = Candidate(name, "recommended", task_type, {"min_samples_leaf": 2, "random_state": 7, **params})
    return Recommendation("ready", task_type, name, "high", [candidate])


def lines(frame, task_type):
    text = task_type == "classification"
    rows = [(k, k * 7 % 50 / 4, "abcd"[k % 4], k % 11) for k in range(3000)]
    y = lambda x, c, z: (x > 6) * 2 + (c == "b") + 3 * (z > 8)
    return frame(f"k long, x double, c string, z long, y {'string' if text else 'double'}", *[(*r, f"u{y(*r[1:])}" if text else float(y(*r[1:]))) for r in rows])


@pytest.mark.parametrize("task_type", ["classification", "regression"])
@pytest.mark.parametrize("block", [1 << 21, 300])
def test_partitions_and_files_change_nothing(frame, spark, folder, monkeypatch, task_type, block):
    monkeypatch.setattr(models, "SPARK_LEAVES", 0)
    monkeypatch.setattr(forest_module, "BLOCK_ROWS", block)
    monkeypatch.setattr(forest_module, "TASK_TREES", 2)
    rows, features = lines(frame, task_type), FeatureColumns(["x", "z"], ["c"], [])
    params = {"n_estimators": 5, "class_weight": "balanced"} if task_type == "classification" else {"n_estimators": 5}
    one, other = (models.train_candidates(rows.repartition(n), features, "y", wanted(task_type, **params), ["k"]) for n in (1, 7))
    assert one.errors == [] and one.experiments.first()["estimator"] == "HistogramForest"
    assert one.experiments.drop("params").collect() == other.experiments.drop("params").collect()
    found = one.experiments.first()
    # Labels follow from the features.
    assert found["test_metrics"]["accuracy" if task_type == "classification" else "r2"] > 0.99
    (path,), warnings = models.save_models(one, folder)
    assert warnings == []
    unseen = rows.limit(1).withColumns({"c": F.lit("new"), "k": F.lit(-1).cast("long")})
    told = rows.union(unseen)
    outputs = ["k", "prediction", *([vector_to_array("probability").alias("p")] if task_type == "classification" else [])]
    again = {r["k"]: r for r in PipelineModel.load(path).transform(told).select(*outputs).collect()}
    assert again == {r["k"]: r for r in one.models[0].transform(told).select(*outputs).collect()} and len(again) == 3001
    parts = one.models[0].stages[-2 if task_type == "classification" else -1].table.groupBy("tree").count().collect()
    assert len(parts) == 5 and all((r["count"] > 1) == (block == 300) for r in parts)


def test_blocks_give_the_means_of_one(spark, frame, monkeypatch):
    """Trees grown over blocks draw other rows than trees of one block, from the same table."""
    rows = frame("x double, y double", *[(float(k % 97), float(k % 97 % 9 + k % 5)) for k in range(4000)])
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["x"], outputCol="v").transform(rows)
    means = []
    for block in (1 << 21, 10):
        monkeypatch.setattr(forest_module, "BLOCK_ROWS", block)
        model = HistogramForest(ForestSettings(0, 60, None, 2), "v", "y").fit(rows)
        means.append({r["x"]: r["p"] for r in model.transform(rows).groupBy("x").agg(F.first("prediction").alias("p")).collect()})
    one, many = means
    assert max(abs(one[x] - many[x]) for x in one) < 0.25 < max(one.values()) - min(one.values())


def learned_rows(spark, monkeypatch, folder, name):
    """The rows that each learner of a query would learn from, all rounds of it."""
    seen = []

    class Counted:
        def fit(self, df):
            seen.append(df.count())
            raise ValueError("counted")

    def build(candidate, facts):
        assert facts.early_stopping is None
        return Counted()

    monkeypatch.setattr(models, "build_estimator", build)
    with pytest.raises(RuntimeError, match="counted"):
        queries.REGISTRY[name][0](spark, folder).collect()
    return seen


def test_train_forest_learns_from_all_training_rows(spark, monkeypatch):
    assert learned_rows(spark, monkeypatch, "/root/testdata/sf0.01", "train_forest") == [48_000]


def test_train_forest_regression_learns_from_all_training_rows(spark, monkeypatch):
    assert learned_rows(spark, monkeypatch, "/root/testdata/sf0.1", "train_forest_regression") == [16_000]


def test_training_run_learns_from_all_training_rows(spark, monkeypatch):
    assert learned_rows(spark, monkeypatch, "/root/testdata/sf0.1", "training_run") == [16_000] * 3


def test_training_run_outcome_trains_with_the_rules_parameters(spark, monkeypatch):
    seen = []

    def build(candidate, facts):
        seen.append(candidate.params)
        raise ValueError("seen")

    monkeypatch.setattr(models, "build_estimator", build)
    found = queries.REGISTRY["training_run_outcome"][0](spark, "/root/testdata/sf0.001").collect()
    assert {r["status"] for r in found} == {"failed"}
    forest, ridge, boosting = seen
    assert forest["n_estimators"] == 300 and boosting["max_iter"] == 300
    assert not {"numTrees", "maxDepth", "maxIter"} & {*forest, *ridge, *boosting}
