"""Quotas against plain highest quotients, targets against their rule, the mix against its segments."""

import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from gridscope.llm.mixing import BLOCK_WORDS, mix, mixed_documents, sainte_lague, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quotas(weights, seats, most):
    out = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if weights[i] > 0 and out[i] < most[i]]
        if not open_:
            break
        best = max(open_, key=lambda i: (Fraction(weights[i]) / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


@pytest.mark.parametrize("seed", range(12))
def test_quotas_against_loops(seed):
    draw = random.Random(seed)
    weights = [draw.choice([0, 1, 5, 5, draw.randrange(1, 1000)]) for _ in range(draw.randrange(1, 12))]
    most = [draw.choice([0, 3, 20, 10**6]) for _ in weights]
    for seats in (0, 1, 7, 200):
        assert sainte_lague(weights, seats, most).tolist() == plain_quotas(weights, seats, most)
    if any(weights):
        assert sainte_lague(weights, 300).tolist() == plain_quotas(weights, 300, [10**9] * len(weights))


def test_many_seats():
    got = sainte_lague([1e12, 3e12, 0], 10**12)
    assert got.tolist() == [25 * 10**10, 75 * 10**10, 0]
    assert sainte_lague([], 5).tolist() == []


def plain_targets(sizes, weights, most):
    """Water level by bisection: each target is the lesser of its cap and its share."""
    share = [weights[k % len(weights)] for k in range(len(sizes))]
    low, high = Fraction(0), Fraction(most * sum(sizes) + 1)
    for _ in range(200):
        level = (low + high) / 2
        total = sum(min(Fraction(most * s), level * w) for s, w in zip(sizes, share))
        low, high = (level, high) if total < sum(sizes) else (low, level)
    return [float(min(Fraction(most * s), high * w)) for s, w in zip(sizes, share)]


@pytest.mark.parametrize("sizes", [[100, 1, 1, 50, 3], [0, 0], [7], [], [5, 0, 9, 1000, 2, 2, 2], [10, 10, 10]])
def test_targets(sizes):
    assert source_targets(sizes) == pytest.approx(plain_targets(sizes, (5, 2, 1), 3), abs=1e-9)


def check(rows, docs, tolerance):
    """rows of mix() for docs (doc_id, source, text): sizes, targets, bounds, totals."""
    size = {d: len(WORD.findall(t or "")) for d, _, t in docs}
    sources = defaultdict(int)
    for d, s, _ in docs:
        sources[s] += size[d]
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, source_targets([sources[s] for s in order])))
    source = {d: s for d, s, _ in docs}
    taken = defaultdict(int)
    assert sorted(map(str, size)) == sorted(str(r["doc_id"]) for r in rows)
    for r in rows:
        own = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]]
        assert r["source_size"] == sources[own]
        assert r["target"] == pytest.approx(targets[own], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == sum(b - a for a, b in r["segments"])
        assert all(0 <= a < b <= r["size"] for a, b in r["segments"])
        taken[own] += r["taken"]
    for s in order:
        assert abs(taken[s] - targets[s]) <= tolerance


def test_documents(spark, table):
    docs = table("documents")
    rows = mix(docs, shard_rows=5).collect()
    check(rows, [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()], 8 * BLOCK_WORDS)
    again = mix(docs.repartition(7), shard_rows=5).collect()
    assert sorted(rows) == sorted(again)
    assert sorted(rows) != sorted(mix(docs, shard_rows=5, seed=7).collect())
    assert sum(len(r["segments"]) > 1 or r["taken"] % max(1, r["size"]) > 0 for r in rows) > 0


def test_odd_rows(spark, frame):
    docs = [(1, "b", "a b c"), (2, None, "x " * 5000), (3, "", ""), (4, "a", None), (5, "é", "one"), (6, "b", "w " * 400), (None, "b", "n n")]
    rows = frame("doc_id long, source string, text string, size string, target string, taken int", *[(*d, "s", "t", 1) for d in docs])
    check(mix(rows).collect(), docs, 4 * BLOCK_WORDS)
    assert mix(rows.limit(0)).collect() == []
    empty = mix(rows.filter("doc_id in (3, 4)")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2
    twice = rows.filter("doc_id = 6")
    assert sum(r["taken"] for r in mix(twice.union(twice)).collect()) == 800


def test_mixed_documents_hold_the_words_taken(spark, table):
    docs = table("documents").drop("lang")
    plan = {r["doc_id"]: r for r in mix(docs, shard_rows=20).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    made = mixed_documents(docs, shard_rows=20)
    assert made.columns == docs.columns
    got = defaultdict(list)
    for r in made.collect():
        got[r["doc_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
        assert r["text"] in texts[r["doc_id"]]
    for doc_id, r in plan.items():
        words = WORD.findall(texts[doc_id])
        want = sorted(words[a:b] for a, b in r["segments"])
        assert sorted(WORD.findall(t) for t in got[doc_id]) == want
