"""Packing: whole documents, every constraint, few sequences, both selection rules."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridscope.llm.packing import CAPACITY, best_fit, packed, pack_sequences, token_pieces

from .test_direct_codes import brute


def plain_best_fit(lengths, capacity, most_documents, most_attention, weights, rule):
    """The same choice by plain loops over all bins."""
    full, bins, where = (capacity, most_documents, most_attention), [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = (lengths[i], 1, lengths[i] ** 2)
        best = None
        for b, left in enumerate(bins):
            if all(x >= y for x, y in zip(left, need)):
                if rule == "norm":
                    merit = -sum(w * ((x - y) / f) ** 2 for w, x, y, f in zip(weights, left, need, full))
                else:
                    merit = sum(w * x * y / f**2 for w, x, y, f in zip(weights, left, need, full))
                if best is None or merit > best[0] + 1e-12:
                    best = (merit, b)
        if best is None:
            bins.append(list(full))
            best = (0, len(bins) - 1)
        where[i] = best[1]
        bins[best[1]] = [x - y for x, y in zip(bins[best[1]], need)]
    return where, len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(100, 100, 10_000), (100, 3, 10_000), (100, 100, 2500)])
def test_best_fit_against_loops(rule, caps):
    lengths = np.random.default_rng(3).integers(1, 50, 150)
    bins, offsets = best_fit(lengths, *caps, (1.0, 0.3, 0.2), rule)
    where, count = plain_best_fit(lengths.tolist(), *caps, (1.0, 0.3, 0.2), rule)
    assert len(set(bins.tolist())) == count
    assert len(set(zip(bins.tolist(), where))) == count
    for b in set(bins.tolist()):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1].tolist()]
        assert lengths[own].sum() <= caps[0] and len(own) <= caps[1] and (lengths[own] ** 2).sum() <= caps[2]


def check(rows, texts):
    """rows of packed() against the library, and against the contract of sequences."""
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r["doc_id"]].append(r)
        per_sequence[r["sequence_id"]].append(r)
    ids = dict(zip(texts, brute([t or "" for t in texts.values()], "word_bpe_49k.json")))
    for doc_id in texts:
        own, want = sorted(per_doc[doc_id], key=lambda r: r["piece"]), np.array([*ids[doc_id], 0], "<u4")
        assert [r["piece"] for r in own] == list(range(-(-len(want) // CAPACITY)))
        for r in own:
            assert r["start"] == r["piece"] * CAPACITY
            part = want[r["start"] : r["start"] + CAPACITY]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    for own in per_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= CAPACITY
    return len(per_sequence), sum(r["length"] for r in rows)


def test_documents_fill_their_sequences(table):
    docs = table("documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    count, total = check(packed(docs).collect(), texts)
    assert count <= 1 + 1.02 * total / CAPACITY


def test_odd_rows(spark, frame):
    texts = {None: "a b", 1: None, 2: "", 3: "word " * 9000, 4: "same", 5: "same"}
    docs = frame("doc_id long, text string, offset string, length string", *[(k, v, "x", "y") for k, v in texts.items()])
    check(packed(docs).collect(), texts)
    assert packed(docs.limit(0)).collect() == []
    twice = docs.filter("doc_id = 4").union(docs.filter("doc_id = 4"))
    rows = packed(twice).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 2
    assert pack_sequences(token_pieces(twice), 2, most_documents=1).select("sequence_id").distinct().count() == 2


def test_a_piece_over_a_capacity():
    with pytest.raises(ValueError):
        best_fit(np.array([5]), 4)


def test_a_worker_remembers_so_many_words():
    from gridscope.llm.tokens import TextEncoder, tokenizer_file

    texts = [" ".join(f"word{k % 50} x{k}" for k in range(j, j + 90)) for j in range(40)]
    path = tokenizer_file("word_bpe_49k.json")
    whole, few = TextEncoder(path, False), TextEncoder(path, False, remembered=30)
    for at in range(0, 40, 10):
        for a, b in zip(whole.encode(texts[at : at + 10]), few.encode(texts[at : at + 10])):
            assert a.tolist() == b.tolist()
    assert len(few.known) == 30 < len(whole.known) and len(few.starts) == 31
