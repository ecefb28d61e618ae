"""The near-duplicate stage against the overlap of all pairs, by plain loops."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from corpus_pipeline import simhash_dedup
from gridscope.llm import similar
from gridscope.llm.common import stored
from gridscope.llm.similar import Signer, apart_pairs, cells, reference_fingerprints, shingles, signed, sketches, without_similar

from ..conftest import DATA


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """The smallest id of each component of pairs with a Jaccard overlap of 0.8 or more."""
    sets = {d: plain_shingles(t) for d, t in rows}
    label, links = {d: d for d in sets}, []
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    for _ in links:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return set(label.values()), links


def test_documents_against_all_pairs(spark, table):
    docs = table("documents")
    want, links = plain_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = simhash_dedup(spark, docs, DATA)
    assert {r["doc_id"] for r in kept.collect()} == want and len(links) > 10
    assert kept.columns == docs.columns


def test_near_and_not_near(spark, frame):
    draw = random.Random(5)
    rows = []
    for k in range(60):
        own = [f"w{draw.randrange(3000)}" for _ in range(200)]
        other = list(own)
        # Each change takes five shingles of 196: the overlap is 0.86, 0.81 or 0.77.
        for at in range(10, 10 + 20 * (3 + k % 3), 20):
            other[at] = "changed"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    want, links = plain_kept(rows)
    kept = {r["doc_id"] for r in without_similar(frame("doc_id long, text string", *rows)).collect()}
    assert kept == want and len(links) == 40


def test_all_pairs_of_a_bucket(spark, frame):
    # Chains: each text is near the one before it, and few are near the smallest.
    draw = random.Random(6)
    own, rows = [f"w{draw.randrange(3000)}" for _ in range(300)], []
    for k in range(40):
        rows.append((k, " ".join(own)))
        for at in draw.sample(range(300), 4):
            own[at] = f"n{draw.randrange(3000)}"
    want, _ = plain_kept(rows)
    assert {r["doc_id"] for r in without_similar(frame("doc_id long, text string", *rows)).collect()} == want


def test_odd_rows(spark, frame):
    text = "alpha beta gamma delta"
    rows = [(3, text), (2, text), (2, text), (2, "Alpha beta gamma delta"), (5, "other words here"), (None, "no id at all"), (None, "no id at all"), (None, text), (7, None), (6, "")]
    docs = frame("doc_id long, text string, component_id long, bands string", *[(*r, 1, "f") for r in rows])
    kept = without_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "5", "6", "None"]
    assert without_similar(docs.limit(0)).collect() == []


def group(size, changes, seed=9):
    """Texts of 200 words with some words changed: about half of the shingles of two are the same."""
    draw = random.Random(seed)
    own, rows = [f"w{draw.randrange(3000)}" for _ in range(200)], []
    for k in range(size):
        other = list(own)
        for at in draw.sample(range(200), changes):
            other[at] = f"n{draw.randrange(30)}"
        rows.append((k, " ".join(other)))
    return rows


def test_pairs_of_a_group_that_is_apart(spark, frame):
    """Texts below the overlap share buckets, but their pairs end at the sketches."""
    made = {}
    for size in (50, 100, 200):
        rows = group(size, 6)
        own = stored(signed(frame("doc_id long, text string", *rows)).withColumn("node", F.col("doc_id")))
        rooted = own.select(F.lit(7).alias("key"), "node", F.col("node").alias("root"))
        made[size] = apart_pairs(rooted, sketches(own), 0.8, block=64).collect()
        sets = {d: shingles(t.split()) for d, t in rows}
        near = {(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
        assert near <= {(r["a"], r["b"]) for r in made[size]} and len(made[size]) == len(set(made[size]))
    assert len(made[200]) < 0.05 * 200 * 199 / 2


def test_blocks_lose_no_pair(spark, frame):
    rows = group(60, 3)
    own = stored(signed(frame("doc_id long, text string", *rows)).withColumn("node", F.col("doc_id")))
    rooted = own.select(F.lit(7).alias("key"), "node", (F.col("node") % 9).alias("root"))
    found = [{(r["a"], r["b"]) for r in apart_pairs(rooted, sketches(own), 0.8, block).collect()} for block in (7, 4096)]
    assert found[0] == found[1] and len(found[0]) > 100
    assert all(a > b and a % 9 != b % 9 for a, b in found[0])


def test_group_against_all_pairs(spark, frame):
    rows = [(3 * d + k, t) for k, changes in enumerate((2, 4, 5)) for d, t in group(40, changes)]
    want, links = plain_kept(rows)
    kept = without_similar(frame("doc_id long, text string", *rows))
    assert {r["doc_id"] for r in kept.collect()} == want and 1 < len(want) < len(rows) and links


def test_names_and_values_come_back(spark, frame):
    names = ("row", "key_1", "key_2", "node", "root", "bands", "_row", "_id", "words_1", "first")
    rows = [(1, "a b c", *range(10)), (1, "a b c", *range(10)), (1, "a b c", *range(1, 11)), (2, "x", *[None] * 10), (None, None, *range(10))]
    docs = frame("doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names), *rows)
    kept = without_similar(docs)
    assert kept.columns == docs.columns
    got = sorted((tuple(r) for r in kept.collect()), key=str)
    # Of rows with one id and text, the same one stays whatever their order.
    assert got == sorted((tuple(r) for r in without_similar(docs.orderBy(F.desc("node"))).collect()), key=str)
    assert {r[0] for r in got} == {1, 2, None} and len(got) == 3 and set(got) <= set(rows)


def test_near_texts_meet_at_the_same_pivots():
    """Fingerprints' votes and pivots alone bring pairs at an overlap of 0.8 together, and few others."""
    draw, signer = random.Random(11), Signer()
    pairs = []
    for k in range(1000):
        size = (9, 36, 180, 900)[k % 4]
        own = [b"%d" % draw.randrange(1 << 60) for _ in range(size * 10 // 9)]
        pairs.append([signer(set(own[:size]))[0], signer(set(own[size // 9 :]))[0]])
    pivots = reference_fingerprints()
    first, second = (cells(np.array(side), pivots) for side in zip(*pairs))
    assert (first == second).any(axis=1).mean() > 0.99
    # Each pair's first text against the next pair's.
    assert (first == np.roll(first, 1, axis=0)).any(axis=1).mean() < 0.01
    # Of any batch the same.
    assert (cells(np.array([pairs[7][0]]), pivots) == first[7]).all()


def test_a_group_of_near_copies_costs_a_pair_per_text(spark, frame, monkeypatch):
    """Texts are compared with the one they share most buckets with, and further only where that left them apart."""
    compared = []
    check = similar.overlapping
    monkeypatch.setattr(similar, "overlapping", lambda pairs, *more: compared.append(pairs.count()) or check(pairs, *more))
    rows = group(60, 1)
    want, _ = plain_kept(rows)
    assert {r["doc_id"] for r in without_similar(frame("doc_id long, text string", *rows)).collect()} == want and len(want) < 5
    assert sum(compared) <= 2 * len(rows)
