"""Boosting by histograms against plain loops, over other partitions, saved and loaded."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gridscope.operators import boosting
from gridscope.operators.boosting import HistogramBoosting, Settings, stops

RATE, LEAVES, L2, LEAST = 0.05, 31, 0.1, 20


def table_of(rows, seed=1):
    draw = np.random.default_rng(seed)
    x = np.c_[draw.normal(size=rows), draw.integers(0, 30, rows), draw.integers(0, 5, rows)]
    y = 3 * np.sin(x[:, 0]) + 4 * (x[:, 2] == 2) + 0.1 * x[:, 1] + draw.normal(size=rows) * 0.5
    return x, y


def labels_of(y, classes):
    return y if not classes else (y > 1).astype(float) if classes == 2 else np.clip(np.floor(y / 2), 0, 2)


@pytest.fixture
def vectors(spark):
    def build(x, label, watched=None):
        rows = [(r.tolist(), float(v), bool(w)) for r, v, w in zip(x, label, watched if watched is not None else np.zeros(len(x), bool))]
        df = spark.createDataFrame(rows, "a array<double>, label double, watched boolean")
        return df.select(array_to_vector("a").alias("features"), "label", "watched")

    return build


def plain_tree(x, candidates, g, h):
    """Leaf values per row: the leaf whose best split gains most is split next."""
    score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + L2)

    def best(rows):
        found = (0.0, None, None)
        if len(rows) < 2 * LEAST:
            return found
        for f, cuts in enumerate(candidates):
            for cut in cuts:
                goes = x[rows, f] == cut if f == 2 else x[rows, f] <= cut
                left, right = rows[goes], rows[~goes]
                if min(len(left), len(right)) >= LEAST and min(h[left].sum(), h[right].sum()) >= 1e-3:
                    gain = score(left) + score(right) - score(rows)
                    if gain > found[0] + 1e-12:
                        found = (gain, left, right)
        return found

    leaves = [(best(np.arange(len(x))), np.arange(len(x)))]
    while len(leaves) < LEAVES:
        at = max(range(len(leaves)), key=lambda k: leaves[k][0][0])
        if leaves[at][0][0] <= 0:
            break
        (_, left, right), _ = leaves.pop(at)
        leaves += [(best(left), left), (best(right), right)]
    out = np.zeros(len(x))
    for _, rows in leaves:
        out[rows] = -RATE * g[rows].sum() / (h[rows].sum() + L2)
    return out


def plain_scores(x, label, classes, rounds):
    # All middles between values, as no feature has more than 255 of them.
    middles = lambda v: [(a + b) / 2 for a, b in zip(v, v[1:])]
    candidates = [middles(np.unique(x[:, 0])), middles(np.unique(x[:, 1])), np.unique(x[:, 2])]
    share = [np.mean(label == k) for k in range(max(classes, 1))]
    if not classes:
        scores = np.full((1, len(x)), label.mean())
    elif classes == 2:
        scores = np.full((1, len(x)), math.log(share[1] / share[0]))
    else:
        scores = np.repeat(np.log(share)[:, None], len(x), axis=1)
    for _ in range(rounds):
        before = scores.copy()
        for k in range(len(scores)):
            if not classes:
                g, h = before[0] - label, np.ones(len(x))
            elif classes == 2:
                p = 1 / (1 + np.exp(-before[0]))
                g, h = p - label, p * (1 - p)
            else:
                p = np.exp(before[k]) / np.exp(before).sum(axis=0)
                g, h = p - (label == k), p * (1 - p)
            scores[k] += plain_tree(x, candidates, g, h)
    return scores


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_equals_plain_loops(vectors, classes):
    x, y = table_of(2000)
    x[:, 0] = np.round(x[:, 0], 1)
    label = labels_of(y, classes)
    rounds = 4 if classes == 3 else 8
    model = HistogramBoosting(Settings(classes, rounds=rounds, rate=RATE, leaves=LEAVES, l2=L2), "features", "label", None, {2: 5}).fit(vectors(x, label))
    wanted = plain_scores(x, label, classes, rounds)
    found = model.transform(vectors(x, label)).toPandas()
    if not classes:
        assert found.prediction.to_numpy() == pytest.approx(wanted[0], abs=1e-6)
    else:
        top = wanted if classes == 3 else np.stack([np.zeros(len(x)), wanted[0]])
        p = np.exp(top) / np.exp(top).sum(axis=0)
        assert np.stack([v.toArray() for v in found.probability]) == pytest.approx(p.T, abs=1e-6)
        assert found.prediction.to_numpy().tolist() == p.argmax(axis=0).tolist()
    assert all(len(t["feature"]) <= 2 * LEAVES - 1 for trees in model.describe()["rounds"] for t in trees)


@pytest.mark.parametrize("classes", [0, 3])
def test_same_trees_over_blocks(vectors, monkeypatch, classes):
    x, y = table_of(1500)
    draw = np.random.default_rng(2)
    rows = vectors(x, labels_of(y, classes), draw.random(1500) < 0.1)
    fit = lambda df: HistogramBoosting(Settings(classes, rounds=7, rate=0.3, leaves=6, l2=L2), "features", "label", "watched", {2: 5}, stopping_rows=1000).fit(df)
    one = fit(rows).describe()
    monkeypatch.setattr(boosting, "BLOCK_CELLS", 900)
    monkeypatch.setattr(boosting, "SCORED_ROUNDS", 3)
    for parts in (1, 4):
        assert fit(rows.repartition(parts)).describe() == one
    assert len(one["rounds"]) == 7 and one["settings"]["patience"] == 10


def test_stops_when_watched_rows_gain_no_more(vectors):
    draw = np.random.default_rng(3)
    x, noise = draw.normal(size=(1500, 2)), draw.normal(size=1500)
    watched = draw.random(1500) < 0.1
    settings = Settings(0, rounds=300, rate=0.3, l2=L2)
    fit = lambda label, **more: len(HistogramBoosting(settings, "features", "label", "watched", **more).fit(vectors(x, label, watched)).describe()["rounds"])
    assert 10 <= fit(noise, stopping_rows=1000) <= 40
    # Below the limit all rows teach, through all rounds.
    assert fit(noise) == 300
    assert fit(noise, stop_below=1e9) == 1


def test_rule_of_stopping():
    settings = Settings(0, patience=3, tolerance=0.1)
    assert not stops([5.0, 5.0, 5.0], settings)
    assert stops([5.0, 5.0, 4.95, 5.0], settings) and not stops([5.0, 5.0, 4.8, 5.0], settings)
    assert not stops([1.0] * 50, Settings(0))


def test_saved_and_loaded(vectors, folder):
    x, y = table_of(300)
    rows = vectors(x, labels_of(y, 2))
    model = PipelineModel([HistogramBoosting(Settings(2, rounds=5), "features", "label").fit(rows)])
    model.write().save(f"{folder}/m")
    columns = ["prediction", vector_to_array("probability").alias("p")]
    again = PipelineModel.load(f"{folder}/m").transform(rows).select(*columns).collect()
    assert again == model.transform(rows).select(*columns).collect()


def test_odd_tables(vectors, spark):
    fit = lambda x, label, classes=0: HistogramBoosting(Settings(classes, rounds=3, rate=1.0, least_rows=1), "features", "label", "watched").fit(vectors(np.array(x), label, [True] * len(x)))
    one = fit([[1.0]], [5.0])
    assert one.transform(vectors(np.array([[9.0]]), [0.0])).first()["prediction"] == 5.0
    assert one.describe()["rounds"] == []
    same = fit([[1.0, 2.0]] * 6, [1.0, 2.0, 3.0, 1.0, 2.0, 3.0])
    assert same.describe()["rounds"] == [] and same.describe()["base"] == [pytest.approx(2.0)]
    ends = fit([[-math.inf], [0.0], [math.inf], [-0.0]], [1.0, 2.0, 9.0, 2.0])
    found = ends.transform(vectors(np.array([[-math.inf], [-0.0], [math.inf]]), [0.0] * 3)).toPandas().prediction
    assert found.tolist() == pytest.approx([1.0, 2.0, 9.0], abs=1e-6)
    with pytest.raises(ValueError):
        HistogramBoosting(Settings(0), "features", "label").fit(vectors(np.array([[1.0]]), [1.0]).where("false"))
    large = fit([[float(k)] for k in range(40)], [1e12 * (k > 20) for k in range(40)])
    assert large.transform(vectors(np.array([[3.0], [30.0]]), [0.0] * 2)).toPandas().prediction.tolist() == pytest.approx([0.0, 1e12], abs=1e6)


def test_many_values_share_bins(vectors):
    x = np.arange(5000.0)[:, None]
    bins = boosting.feature_bins(vectors(x, x[:, 0]).select(vector_to_array("features").alias("features")), 1, {})
    assert 200 <= bins.sizes[0] <= 255
    counts = np.bincount(bins.codes(x)[0])
    assert counts.max() <= 3 * 5000 / 255


@pytest.mark.parametrize("classes", [0, 2])
def test_many_rows_of_few_bins_are_one_block(vectors, monkeypatch, classes):
    x, y = table_of(3000)
    x[:, 0], x[:, 1] = np.round(x[:, 0]), x[:, 1] % 4
    rows = vectors(x, labels_of(y, classes))
    fit = lambda: HistogramBoosting(Settings(classes, rounds=4, rate=0.3, leaves=6, l2=L2), "features", "label", None, {2: 5}).fit(rows)
    whole = fit().describe()
    # Fewer than the rows, more than the combinations of bins and labels; no pass over blocks is needed.
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 500)
    monkeypatch.setattr(HistogramBoosting, "_over_blocks", None)
    assert fit().describe() == whole and len(whole["rounds"]) == 4


def test_cells_score_as_rows_do(vectors, monkeypatch):
    x, y = table_of(3000)
    model = HistogramBoosting(Settings(3, rounds=5, rate=0.3, l2=L2), "features", "label", None, {2: 5}).fit(vectors(x, labels_of(y, 3)))
    x = np.r_[x, [[math.nan, 1.0, 2.0], [0.0, math.inf, 9.0], [-0.0, 3.0, 1.0]]]
    told = model.describe()
    rounds = [[boosting.Tree(**t) for t in trees] for trees in told["rounds"]]
    category = np.array(told["categories"])
    asked = []

    def each(values):
        asked.append(values.shape[1])
        out = np.zeros((3, values.shape[1]))
        for trees in rounds:
            for k, tree in enumerate(trees):
                out[k] += np.array(tree.value)[tree.nodes(values, category, False)]
        return out

    want = each(x.T)
    for known in (200_000, 50):
        monkeypatch.setattr(boosting, "KNOWN_SCORES", known)
        cells = boosting._Cells(rounds, category)
        found = [cells.scores(x[at : at + 500].T, each) for at in (0, 500, 1000, 1500, 2000, 2500, 3000, 0)]
        assert np.array_equal(np.concatenate(found[:-1], axis=1), want) and np.array_equal(found[-1], want[:, :500])
        if known > 50:
            # The last rows were met before.
            assert asked[-1] == 0
