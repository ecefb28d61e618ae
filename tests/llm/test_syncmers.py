"""Syncmer anchors, edited texts and likeness against plain loops."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridscope.llm import syncmers as S
from gridscope.llm.syncmers import anchors, edited_fingerprints, fingerprints, in_order, likeness


def plain_anchors(text, k, s):
    if not text:
        return []
    padded = [0] * (k - 1) + [ord(c) for c in text] + [0] * (k - 1)

    def value(part):
        h = 0
        for c in part:
            h = (h * S.FACTOR + c) % 2**64
        h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD % 2**64
        h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 % 2**64
        return h ^ (h >> 33)

    out = []
    for i in range(len(padded) - k + 1):
        inner = [value(padded[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, value(padded[i : i + k])))
    return out


@pytest.mark.parametrize("k, s", [(20, 8), (7, 3), (5, 4)])
def test_anchors_against_loops(monkeypatch, k, s):
    draw = random.Random(k)
    texts = ["", "a", "é𝄞", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "", *("".join(draw.choices("ab c", k=n)) for n in (3, 40, 300))]
    want = [plain_anchors(t, k, s) for t in texts]
    for windows in (500_000, 17):
        monkeypatch.setattr(S, "WINDOWS", windows)
        got = [list(zip(at.tolist(), h.tolist())) for at, h in anchors(texts, k, s)]
        assert got == want


def test_anchors_are_free_of_context():
    draw = random.Random(1)
    passage = "".join(draw.choices("abcdefgh ", k=200))
    inside = [set(h[(at >= 19 + n) & (at < 19 + n + 181)].tolist()) for n, (at, h) in zip((0, 33), anchors([passage, "x" * 33 + passage]))]
    assert inside[0] == inside[1] and inside[0]


def test_in_order():
    draw = random.Random(2)
    for _ in range(50):
        line = [draw.randrange(12) for _ in range(8)]
        best = 0
        for mask in range(256):
            some = [x for i, x in enumerate(line) if mask >> i & 1]
            if all(a < b for a, b in zip(some, some[1:])):
                best = max(best, len(some))
        assert in_order(np.array(line)) == best


def test_likeness():
    draw = random.Random(3)
    text = "".join(draw.choices("abcdefghij ", k=4000))
    other = "".join(draw.choices("abcdefghij ", k=4000))
    a, b, half, swapped, empty = fingerprints([text, other, text[:2000] + other[:2000], text[2000:] + text[:2000], ""])
    assert likeness(a, a) == likeness(empty, empty) == 1
    # Anchors that reach into the padding hold a character or two.
    assert likeness(a, b) < 0.01 and likeness(a, empty) == 0
    assert 0.25 < likeness(a, half) < 0.75
    assert 0.3 < likeness(a, swapped) < 0.95


def plain_likeness(a, b):
    """Over all anchors, by dictionaries of first positions."""
    first = [{}, {}]
    for own, text in zip(first, (a, b)):
        for at, h in plain_anchors(text, S.K, S.S):
            own.setdefault(h % 2**32, at)
    line = [first[1][h] for h, _ in sorted(first[0].items(), key=lambda e: e[1]) if h in first[1]]
    longest = []
    for k, p in enumerate(line):
        longest.append(1 + max((n for n, q in zip(longest, line[:k]) if q < p), default=0))
    return 2 * max(longest, default=0) / (len(first[0]) + len(first[1])) if any(first) else 1.0


def test_likeness_counts_all_anchors():
    draw = random.Random(8)
    text = "".join(draw.choices("abcdefghij ", k=1500))
    others = [text[:700] + "x" * 40 + text[700:], text[900:] + text[:900], text * 2, text[:750] + text[:750][::-1], "", "short"]
    for other in others:
        a, b = fingerprints([text, other])
        assert likeness(a, b) == pytest.approx(plain_likeness(text, other), abs=1e-12)
    # More anchors than a sketch of the smallest hashes would hold, and all can be read back.
    whole = fingerprints([text])[0]
    told = np.frombuffer(base64.b64decode(whole.text()), np.uint8).reshape(-1, 5)
    assert len(told) == len(plain_anchors(text, S.K, S.S)) > 150
    assert np.cumsum(told[:, 4]).tolist() == whole.positions.tolist()
    assert told[:, :4].copy().view("<u4")[:, 0].tolist() == whole.hashes.tolist()


def test_distances_fit_a_byte():
    draw = random.Random(9)
    texts = ["a" * 3000, "ab" * 2000, "".join(draw.choices("ab", k=5000)), "\n" * 50 + "x"]
    for found in fingerprints(texts):
        assert np.diff(found.positions, prepend=0).max() <= S.K - S.S + 1


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        x, y, z = fingerprints([text, edited, following])
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((doc_id, len(text), digest, x.text(), y.text(), likeness(x, y), likeness(x, z)))
    return sorted(out, key=repr)


def test_documents(spark, table):
    docs = table("documents")
    got = [tuple(r) for r in edited_fingerprints(docs).collect()]
    assert sorted(got, key=repr) == expected([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert np.mean([r[5] for r in got]) > 0.4 and np.mean([r[6] for r in got]) < 0.1


@pytest.mark.parametrize("pieces", [1, 2_000_000])
def test_odd_rows(spark, frame, monkeypatch, pieces):
    monkeypatch.setattr("gridscope.llm.common.PIECE_CHARS", pieces)
    rows = [(5, "five"), (5, "again"), (5, "five"), (None, "none"), (None, None), (3, ""), (2, None), (1, "é" * 5), (8, "ab " * 60_000)]
    docs = frame("doc_id long, text string, range string, guest string", *[(*r, "x", "y") for r in rows])
    for some in (rows, rows[:1], rows[3:5]):
        part = docs if some is rows else docs.filter(F.col("text") == "five").limit(1) if some == rows[:1] else docs.filter("doc_id is null")
        assert sorted((tuple(r) for r in edited_fingerprints(part).collect()), key=repr) == expected(some)
    assert edited_fingerprints(docs.limit(0)).collect() == []
