"""Fingerprints and components against plain loops."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from gridscope.llm.simhash import components, fingerprint, fingerprints, linked_pairs, near_duplicates, pivots


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable over pairs at three or fewer bits, by rounds of minima."""
    label = {k: k for k in prints}
    keys = list(prints)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if (prints[a] ^ prints[b]).bit_count() <= 3]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return label


def test_documents_against_loops(spark, table):
    docs = table("documents")
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    label = plain_components(prints)
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(prints)
    assert {r["doc_id"]: r["fingerprint"] % 2**64 for r in rows} == prints
    assert {r["doc_id"]: r["component_id"] for r in rows} == label


def test_odd_rows(spark, frame):
    texts = [(5, None), (4, ""), (3, " \n"), (2, "One"), (1, "oNe"), (9, "a b"), (9, "a b"), (None, "c d e f"), (7, "x " * 40_000)]
    docs = frame("doc_id long, text string, fingerprint string, component_id int", *[(*t, "f", 0) for t in texts])
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    found = {r["doc_id"]: (r["fingerprint"] % 2**64, r["component_id"]) for r in rows}
    assert all(found[k] == (0, 3) for k in (3, 4, 5))
    assert found[1] == found[2] == (plain_fingerprint("one"), 1)
    assert found[None] == (plain_fingerprint("c d e f"), None)
    assert near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_no_pair_is_lost(spark, frame, seed):
    draw = random.Random(seed)
    values = set()
    for _ in range(60):
        value = draw.getrandbits(64)
        values.add(value)
        for _ in range(6):
            for bit in draw.sample(range(64), draw.randint(1, 3)):
                value ^= 1 << bit
            values.add(value)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = frame("fingerprint long", *signed).select(F.lit(2).alias("number"), "fingerprint")
    got = {tuple(sorted((r["a"], r["b"]))) for r in linked_pairs(rows).collect()}
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 3}
    assert got == want
    assert len(set(pivots())) == len(pivots())


def test_components_of_chains(spark, frame):
    draw = random.Random(4)
    names = draw.sample(range(-1000, 1000), 300)
    links = [(names[i], names[i + 1]) for i in range(299) if i % 60 != 59] + [(names[0], names[0])]
    draw.shuffle(links)
    got = {r["node"]: r["root"] for r in components(frame("a long, b long", *links)).collect()}
    for at in range(0, 300, 60):
        own = names[at : at + 60]
        assert all(got[n] == min(own) for n in own if n != min(own))


def test_shingles_follow_the_hash_of_spark(spark, frame):
    docs = frame("doc_id long, text string", (1, "alpha beta Gamma"))
    (row,) = fingerprints(docs).collect()
    assert row["prints"][0] == docs.select(F.xxhash64(F.lit("alpha beta gamma")).alias("h")).first()["h"]


def test_components_of_stars_take_no_round(spark, frame, monkeypatch):
    """A graph that is stars already is stored once; further links are only looked at by their roots."""
    from gridscope.llm import simhash, similar

    made, store = [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df: made.append(df) or store(df))
    links = frame("a long, b long", *((9 + k, 1 + k % 2) for k in range(40)))
    assert {r["node"]: r["root"] for r in components(links).collect()} == {9 + k: 1 + k % 2 for k in range(40)}
    assert len(made) == 1
    roots = similar.roots_of(frame("node long", *range(1, 60)), links)
    got = {r["node"]: r["root"] for r in similar.with_links(roots, frame("a long, b long", (10, 13), (48, 50), (3, 51))).collect()}
    assert got == {n: n for n in range(1, 60)} | {9 + k: 1 for k in range(40)} | {2: 1, 50: 1, 51: 3}
    assert similar.with_links(roots, frame("a long, b long", (9, 10)).limit(0)) is roots
