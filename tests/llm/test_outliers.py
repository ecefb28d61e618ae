"""Statistics against plain loops, estimates against plain numpy, verdicts on labelled documents."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscope.llm import outliers as O
from gridscope.llm.outliers import chi_square_share, chi_square_value, outlier_verdicts, repeated_words, robust_estimates, without_outliers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, again = set(), 0
    for line in lines:
        again += line in seen
        seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


def test_repeated_words():
    draw = random.Random(5)
    texts = [" ".join(draw.choices("ab", k=draw.randrange(60))) for _ in range(40)] + ["", "a b c d e a b c d e", "a b c d e f"]
    assert repeated_words([t.split() for t in texts]).tolist() == [plain_statistics(t)[4] for t in texts]
    assert repeated_words([]).tolist() == []


def test_chi_square():
    for freedom in (4, 6):
        steps = np.linspace(0, 12, 200_001)
        density = steps ** (freedom / 2 - 1) * np.exp(-steps / 2) / (2 ** (freedom / 2) * math.gamma(freedom / 2))
        assert chi_square_share(12, freedom) == pytest.approx(np.trapezoid(density, steps), abs=1e-8)
    assert chi_square_share(chi_square_value(0.9, 4), 4) == pytest.approx(0.9)


def plain_estimate(x, pick):
    """The estimate of one group in numpy: the same steps over the rows themselves."""
    def solve(rows, share):
        v = rows / O.SCALE
        scatter = np.cov(v.T, bias=True) * (O.consistency(share) if share < 1 else 1) + np.diag(np.square(O.LEAST_DEVIATION))
        return v.mean(axis=0), np.linalg.inv(scatter), np.linalg.slogdet(scatter)[1]

    def distance(estimate):
        away = x / O.SCALE - estimate[0]
        return np.einsum("ni,ij,nj->n", away, estimate[1], away)

    def step(estimate):
        bins = np.floor(np.log2(np.maximum(distance(estimate), 2.0**-30)) * O.BINS_PER_OCTAVE)
        order = np.sort(bins)
        last = order[math.ceil(O.CORE * len(x)) - 1]
        return solve(x[bins <= last], O.CORE)

    deal = pick % math.ceil(len(x) / O.START_DOCUMENTS)
    starts = [solve(x, 1)] + [solve(x[deal == k], 1) for k in range(O.STARTS - 1) if (deal == k).any()]
    for _ in range(O.STEPS_ALL):
        starts = [step(s) for s in starts]
    best = min(starts, key=lambda s: s[2])
    for _ in range(O.STEPS_BEST):
        best = step(best)
    return solve(x[distance(best) <= chi_square_value(O.REWEIGHTED_WITHIN, 4)], O.REWEIGHTED_WITHIN)


def test_estimates_against_numpy(spark):
    rng = np.random.default_rng(8)
    parts, want = [], {}
    for group, n in (("a", 400), ("b", 90), ("c", 3)):
        x = np.round(rng.multivariate_normal([1, 2, 0, 0], np.diag([0.2, 2, 0.1, 0.1]) ** 2 + 0.001, n) * O.SCALE).astype(int)
        x[: n // 5] += [800, 6000, 0, 300]
        pick = np.arange(n) * 7919
        parts += [(group, int(p), *map(int, v)) for p, v in zip(pick, x)]
        want[group] = plain_estimate(x, pick)
    rows = spark.createDataFrame(parts, "group string, pick long, x0 long, x1 long, x2 long, x3 long")
    for small in (True, False):
        got = {r["group"]: r for r in robust_estimates(rows.repartition(3), small).collect()}
        assert set(got) == set(want)
        for group, (centre, inverse, _) in want.items():
            assert got[group]["centre"] == pytest.approx(centre.tolist(), abs=1e-9)
            flat = [inverse[i, j] * (1 if i == j else 2) for i, j in O._PAIRS]
            assert got[group]["inverse"] == pytest.approx(flat, rel=1e-6)
    # A fifth of the rows lies far off and doesn't move the centre.
    assert abs(want["a"][0][1] - 2) < 0.3


def test_documents(spark, table):
    docs = table("documents")
    rows = {r["doc_id"]: r for r in outlier_verdicts(docs).collect()}
    for r in docs.collect():
        got = rows[r["doc_id"]]
        stats = plain_statistics(r["text"])
        assert tuple(got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == stats
        assert got["base_failed"] == (stats[0] < 10 or 100 * stats[4] > 20 * stats[0])
        assert not (got["base_failed"] and got["kept"])
    labels = {r["doc_id"]: r["quality"] for r in table("labels").collect()}
    clean = [rows[d]["kept"] for d, q in labels.items() if q == 1 and not rows[d]["base_failed"]]
    junk = [rows[d]["kept"] for d, q in labels.items() if q == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.1 * len(junk)
    kept = without_outliers(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, r in rows.items() if r["kept"])


def test_groups_of_their_own(spark, table, monkeypatch):
    monkeypatch.setattr(O, "LEAST_DOCUMENTS", 5)
    docs = table("documents")
    own = {r["doc_id"]: r["kept"] for r in outlier_verdicts(docs).collect()}
    again = {r["doc_id"]: r["kept"] for r in outlier_verdicts(docs.repartition(5)).collect()}
    assert own == again and sum(own.values()) > 0.6 * len(own)


def test_odd_rows(spark, frame):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, text, None, "b"), (None, text, "x", None), (4, text, None, "b"), (5, "w " * 60_000, "en", "a")]
    docs = frame("doc_id long, text string, lang string, source string, kept string, distance int", *[(*r, "k", 1) for r in rows])
    got = sorted((str(r["doc_id"]), r["n_words"], r["base_failed"], r["kept"]) for r in outlier_verdicts(docs).collect())
    assert got == sorted([("1", 10, False, True), ("2", 0, True, False), ("3", 0, True, False), *[("4", 10, False, True)] * 2, ("None", 10, False, True), ("5", 60_000, True, False)])
    assert sorted(str(r["doc_id"]) for r in without_outliers(docs).collect()) == ["1", "4", "4", "None"]
    assert outlier_verdicts(docs.limit(0)).collect() == [] and without_outliers(docs.limit(0)).collect() == []
    assert without_outliers(docs.filter(F.col("doc_id") == 2)).collect() == []
