"""The index against plain cosines, the whole query by brute force, and odd tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscope.llm.queries import op6_nearest_toxic
from gridscope.llm.toxicity import BlockMaxIndex, TermCounter, ToxicityModel, association, fit_toxicity, toxic_documents, weights, without_toxic

from ..conftest import DATA


def plain_weights(counts, weight):
    raw = {t: (1 + math.log(n)) * weight[t] for t, n in counts.items()}
    size = math.sqrt(sum(x * x for x in raw.values()))
    return {t: x / size for t, x in raw.items()}


def index_of(vectors, terms):
    sizes = [len(t) for t, _ in vectors]
    return BlockMaxIndex(np.repeat(np.arange(len(vectors)), sizes), np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors]), len(vectors), terms)


def model_of(weight, examples):
    """examples: (id, toxic, counts)."""
    flat = [(t, n) for *_, c in examples for t, n in c.items()]
    as_ints = lambda values: np.array(list(values), np.int64)
    return ToxicityModel(
        {}, np.asarray(weight, np.float64), as_ints(e[0] for e in examples), as_ints(e[1] for e in examples),
        as_ints(len(e[2]) for e in examples), as_ints(t for t, _ in flat), as_ints(n for _, n in flat),
    )


@pytest.mark.parametrize("seed", range(6))
def test_nearest_against_all_cosines(seed):
    draw = random.Random(seed)
    terms, weight = 40, np.array([draw.uniform(1, 6) for _ in range(40)])
    vector = lambda: dict(sorted(Counter(draw.choices(range(terms), k=draw.randrange(1, 9))).items()))
    examples = [vector() for _ in range(700)]
    index = index_of([weights(e, weight) for e in examples], terms)
    plain = [plain_weights(e, weight) for e in examples]
    for _ in range(30):
        query = vector()
        own = plain_weights(query, weight)
        cosines = sorted(((sum(x * e.get(t, 0) for t, x in own.items()), i) for i, e in enumerate(plain)), reverse=True)
        least = max(1e-12, cosines[14][0] - 1e-9)
        want = {i: c for c, i in cosines if c >= least}
        near, found = index.nearest(*weights(query, weight), 15)
        assert set(near.tolist()) == set(want) and found.tolist() == sorted(found.tolist(), reverse=True)
        assert found.tolist() == pytest.approx([want[i] for i in near.tolist()], abs=1e-12)
    assert index.scored_blocks <= 30 * index.blocks


def test_blocks_are_skipped():
    # One block of close examples, many that share only a weak term.
    weight = np.array([1.0, 5.0])
    index = index_of([weights({1: 1}, weight)] * 64 + [weights({0: 1}, weight)] * 6400, 2)
    near, cosines = index.nearest(*weights({0: 1, 1: 3}, weight), 15)
    # All that are as near as the fifteenth.
    assert near.tolist() == list(range(64)) and len(set(cosines.tolist())) == 1
    assert index.scored_blocks == 4


def test_terms():
    counter = TermCounter({"idiot": 0, "abcd": 1, "réeu*": 2, "abcd*": 3, "id*": 4})
    text = "Idiot, réeuxment RÉEUX abcd abcde idiot!"
    assert counter(text) == {0: 2, 1: 1, 2: 2, 3: 2} and list(counter(text)) == [0, 1, 2, 3]
    assert counter.present(text) == {0, 1, 2, 3}
    for nothing in (None, "", "other"):
        assert counter(nothing) == {} and counter.present(nothing) == set()
    assert TermCounter({})(text) == {}


def test_votes():
    model = model_of(np.ones(3), [(1, 1, {0: 1}), (2, 0, {1: 1}), (3, 0, {}), (4, 0, {}), (5, 1, {2: 1})])
    base = 2.5 / 7
    assert model.base == base and model.score({}) == (base, [])
    score, near = model.score({0: 1})
    assert [(c, model.ids[i]) for c, i in near] == [(1.0, 1)] and score == pytest.approx((10 + base) / 11)
    both = model.score({0: 1, 1: 1})
    assert sorted(model.ids[i] for _, i in both[1]) == [1, 2] and 0.4 < both[0] < 0.5
    # Twenty equal examples all vote, so the order of their ids doesn't decide.
    equal = [model_of(np.ones(1), [(k, int((k < 10) == first), {0: 2}) for k in range(20)]).score({0: 1})[0] for first in (True, False)]
    assert equal[0] == pytest.approx(equal[1]) and equal[0] == pytest.approx(0.5, abs=0.01)
    nothing = model_of(np.empty(0), [])
    assert nothing.score({}) == (0.25, [])


def test_association():
    clean, toxic = np.array([0, 90, 1, 0]), np.array([10, 10, 0, 1])
    found = association(clean, toxic, 90, 10)
    assert found[0] > 5 and found[1:].tolist() == [0, 0, 0] or found[0] > 5 and found[3] < 2
    assert association(clean, toxic, 0, 10).tolist() == [0] * 4 and association(clean[:0], toxic[:0], 1, 1).tolist() == []


def brute_scores(rows, labels):
    """All scores by plain dictionaries: every example, every term, every cosine."""
    words = [Counter(re.findall(r"\w+", (t or "").lower())) for _, t in rows]
    fold = lambda d: zlib.crc32(str(d).encode()) % 5
    texts = {d: w for (d, _), w in zip(rows, words)}
    examples = [(d, labels[d]) for d in sorted(labels) if d in texts and fold(d)]
    starts = lambda w: [f"{w[:n]}*" for n in (3, 4, 5, 6, 7) if len(w) >= n]
    having = Counter(), Counter()
    for d, toxic in examples:
        having[toxic].update(set(texts[d]) | {b for w in texts[d] for b in starts(w)})
    terms = sorted(having[0].keys() | having[1].keys())
    sizes = [sum(t == k for _, t in examples) for k in (0, 1)]
    chance = math.sqrt(2 * math.log(len(terms)))

    def strength(term):
        c, t = having[0][term], having[1][term]
        share = (c + t) / sum(sizes)
        return max(0.0, (t / sizes[1] - c / sizes[0]) / math.sqrt(share * (1 - share) * (1 / sizes[0] + 1 / sizes[1]) + 1e-12) - chance)

    strong = {t: strength(t) for t in terms}
    known = {t for t in terms if strong[t] > 0 or not t.endswith("*")}

    def counts(own):
        out = Counter()
        for w, n in own.items():
            for t in (w, *starts(w)):
                if t in known:
                    out[t] += n
        return out

    counted = [counts(w) for w in words]
    holding = Counter(t for c in counted for t in c)
    weight = {t: (1 + math.log((1 + len(rows)) / (1 + holding[t]))) * (0.1 + strong[t]) for t in known}
    vectors = [(toxic, plain_weights(counts(texts[d]), weight)) for d, toxic in examples]
    base = (sizes[1] + 0.5) / (len(examples) + 2)
    out = []
    for c in counted:
        own = plain_weights(c, weight) if c else {}
        cosines = [(sum(x * v.get(t, 0) for t, x in own.items()), toxic) for toxic, v in vectors]
        ranked = sorted((x for x, _ in cosines), reverse=True)
        least = max(ranked[14] - 1e-9, 1e-15)
        votes = [(1 / (1.1 - min(x, 1)), toxic) for x, toxic in cosines if x >= least]
        out.append((sum(v for v, t in votes if t) + base) / (sum(v for v, _ in votes) + 1))
    return out, base


def test_whole_query_against_brute_force(spark, table):
    rows = [(r["doc_id"], r["text"]) for r in table("documents").orderBy("doc_id").collect()]
    labels = {r["doc_id"]: int(r["toxic"] > 0) for r in table("labels").collect()}
    want, base = brute_scores(rows, labels)
    got = {r["doc_id"]: r for r in op6_nearest_toxic(spark, DATA).collect()}
    assert [got[d]["score"] for d, _ in rows] == pytest.approx(want, abs=1e-9)
    # Evidence lacks only where no term is shared.
    assert all(got[d]["nearest"] or abs(w - base) < 1e-9 for (d, _), w in zip(rows, want))


def test_held_out_documents(spark):
    rows = op6_nearest_toxic(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    held = [[r["score"] for r in rows if r["held_out"] and r["toxic"] == k] for k in (0, 1)]
    assert sum(clean) <= 0.01 * len(clean)
    assert sum(s >= 0.5 for s in held[1]) >= 4 and sum(s >= 0.5 for s in held[0]) == 0
    pairs = [(t > c) + 0.5 * (t == c) for t in held[1] for c in held[0]]
    assert sum(pairs) / len(pairs) > 0.9


def test_odd_rows(spark, frame):
    bad, good = "you stupid loser {}", "kind words here {}"
    rows = [(k, (bad if k % 3 == 0 else good).format("x" * k)) for k in range(90)]
    rows += [(90, None), (91, ""), (None, "stupid"), (93, "stupid"), (93, "stupid"), (94, "fine " * 40_000 + "stupid loser")]
    docs = frame("doc_id long, text string, toxic string, score string, toxicity int, row int", *[(*r, "t", "s", k, -k) for k, r in enumerate(rows)])
    labels = frame("doc_id long, quality int, toxic int, text string", *[(k, 1, int(k % 3 == 0), "t") for k in range(90)], (None, 0, 1, "t"), (91, 0, None, "t"), (1, 0, 0, "again"))
    found = toxic_documents(docs, labels)
    # A given column of the struct's name stays as it was.
    assert found.columns == [*docs.columns, "toxicity_"]
    got = found.select("doc_id", "text", "toxicity", F.col("toxicity_.score").alias("value")).collect()
    assert sorted(r["toxicity"] for r in got) == list(range(len(rows)))
    assert all((r["value"] >= 0.5) == ("stupid" in (r["text"] or "")) for r in got)
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns
    want = [(*r, "t", "s", k, -k) for k, r in enumerate(rows) if "stupid" not in (r[1] or "")]
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert toxic_documents(docs.limit(0), labels).collect() == []
    assert without_toxic(docs, labels.limit(0)).count() == len(rows)
    # Labels of the held-out fold aren't learned from.
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    flipped = labels.withColumn("toxic", F.when(fold == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxic_documents(docs, flipped).select("doc_id", "text", "toxicity", F.col("toxicity_.score").alias("value")).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_bound_on_examples_holds_for_repeated_ids(spark, frame):
    rows = [(k % 40, f"word{k % 7} text{k}") for k in range(400)]
    labels = frame("doc_id long, toxic int", *[(k, k % 2) for k in range(40)])
    model = fit_toxicity(frame("doc_id long, text string", *rows), labels, most_examples=10)
    assert len(model.ids) == 10 == len(set(model.ids.tolist()))


def test_nearest_adds_up_terms_in_their_order():
    """Cosines are, bit for bit, the sums of an example's terms in ascending order."""
    import numpy as np

    from gridscope.llm.toxicity import BlockMaxIndex

    draw = np.random.default_rng(3)
    dense = draw.random((300, 40)) * (draw.random((300, 40)) < 0.3)
    owner, term = dense.nonzero()
    index = BlockMaxIndex(owner, term, dense[owner, term], 300, 40)
    for _ in range(20):
        terms = np.sort(draw.choice(40, 12, replace=False))
        values = draw.random(12)
        sums = np.zeros(300)
        for t, v in zip(terms, values):
            sums += dense[:, t] * v
        near, cosines = index.nearest(terms, values, 15)
        assert (cosines == sums[near]).all() and set(near[:15]) == set(np.argsort(-sums, kind="stable")[:15])
