"""Licence scans: automaton, statistics, anchors and chains against plain loops; odd tables."""

import random
import re

import pytest

from gridscope.llm.licence_texts import BASE_PHRASES, PHRASES, TEMPLATES
from gridscope.llm.licences import LicenceScanner, SuffixAutomaton, chained, licence_digest, licence_spans, words_of

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def inside(part, text):
    return any(text[k : k + len(part)] == part for k in range(len(text) - len(part) + 1))


def places_of(words, phrase):
    return [k for k in range(len(words) - len(phrase) + 1) if words[k : k + len(phrase)] == phrase]


def longest_suffix(words, stop, text):
    return max(n for n in range(stop + 1) if inside(words[stop - n : stop], text))


def plain_anchors(words, text, least):
    """(file, template, words) of the matches that can't go on, by trying all of them."""
    sizes = [longest_suffix(words, stop, text) for stop in range(1, len(words) + 1)]
    out = set()
    for k, n in enumerate(sizes):
        if n >= least and (k + 1 == len(sizes) or sizes[k + 1] != n + 1):
            out |= {(k + 1 - n, at, n) for at in places_of(text, words[k + 1 - n : k + 1])}
    return out


def base_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = sorted((k, label) for label, phrase in BASE_PHRASES for k in places_of(words, phrase.split()))
    ends = (found[0][0], found[-1][0]) if found else (None, None)
    return (len(words), len(found), *ends, ",".join(sorted({x for _, x in found})))


@pytest.mark.parametrize("seed", range(30))
def test_statistics_and_anchors(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(3) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 4))]
    machine = SuffixAutomaton(texts)
    file = [rng.randrange(4) for _ in range(60)]
    for stop, (state, n) in enumerate(machine.stream(file), 1):
        assert n == max(longest_suffix(file, stop, t) for t in texts)
        want = {(k, at + n - 1) for k, t in enumerate(texts) for at in places_of(t, file[stop - n : stop])} if n else set()
        assert set(machine.ends[state]) == want and len(machine.ends[state]) == len(want)

    name = lambda numbers: " ".join(f"w{x}" for x in numbers)
    phrases = [(str(k), name(rng.choices(range(3), k=2 + k)), True) for k in range(2)]
    scanner = LicenceScanner(phrases, [(str(k), name(t)) for k, t in enumerate(texts)], least_anchor=2)
    words = name(file).encode().split()
    anchors: dict = {}
    places: list = []
    scanner_chained = {}
    for k, t in enumerate(texts):
        scanner_chained[k] = plain_anchors(words, name(t).encode().split(), 2)
    numbers = [scanner.number.get(w, -1) for w in words]
    begin = 0
    for at, number in enumerate([*numbers, -1]):
        if number < 0:
            scanner._run(numbers[begin:at], begin, places, anchors)
            begin = at + 1
    for k in range(len(texts)):
        found = anchors.get(len(phrases) + k, [])
        assert set(found) == scanner_chained[k] and len(found) == len(set(found))
    assert sorted(places) == sorted((k, at) for k, (_, p, _) in enumerate(phrases) for at in places_of(words, p.encode().split()))
    assert sorted(scanner.scan(words)[0]) == sorted(places)


@pytest.mark.parametrize("seed", range(20))
def test_best_chain(seed):
    """The best chain against all ways to go on, without windows."""
    rng = random.Random(seed)
    anchors = sorted({(rng.randrange(80), rng.randrange(40), rng.randint(4, 9)) for _ in range(25)}, key=lambda a: (a[0] + a[2], a[1] + a[2], a[2]))
    most = []
    for j, (a, b, n) in enumerate(anchors):
        best = n
        for i, (c, d, m) in enumerate(anchors[:j]):
            if c + m < a + n and d + m < b + n and a - c - m <= 10 and b - d - m <= 10:
                more = n - max(0, c + m - a, d + m - b)
                best = max(best, most[i] + more) if more > 0 else best
        most.append(best)
    found = chained(anchors, 10)
    assert max(covered for *_, covered in found) == max(most)
    assert all(0 <= first < last and covered > 0 for first, last, covered in found)


def test_templates():
    scanner = LicenceScanner([(a, b, True) for a, b in BASE_PHRASES] + [(a, b, False) for a, b in PHRASES], TEMPLATES)
    for k, (_, text) in enumerate(TEMPLATES):
        words = words_of(text)
        _, spans, share = scanner.scan([b"zu", b"viel", *words, b"danach"])
        own = [s for s in spans if s.template == k and s.covered == len(words)]
        assert [(s.first, s.last) for s in own] == [(2, 2 + len(words))] and share == 1
        # Every tenth word is another, and a stretch is missing.
        torn = [w if i % 10 else b"anders" for i, w in enumerate(words)]
        del torn[20:26]
        _, spans, share = scanner.scan(torn)
        assert max(s.covered for s in spans if s.template == k) >= 0.6 * len(words)
    assert scanner.scan(words_of("the software is what the terms of the license are not"))[2] < 0.6


def test_documents(spark, table):
    docs = table("documents")
    want = {r["doc_id"]: base_of(r["text"]) for r in docs.select("doc_id", "text").collect()}
    found = licence_digest(licence_spans(docs))
    assert found.columns == COLUMNS
    got = found.collect()
    assert len(got) == len(want) and any(r["n_base"] for r in got)
    for r in got:
        assert tuple(r[1:6]) == want[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert (r["score"] == 1) >= (r["n_base"] > 0) and 0 <= r["score"] <= 1


def test_odd_rows(spark, frame):
    mit = TEMPLATES[0][1]
    rows = [
        (1, None), (1, None), (2, ""), (3, "All rights\nRESERVED. cc-by; CC by, General public LICENSE"), (None, "cc by cc by"),
        (4, "ccby c c by"), (5, "... ---"), (6, f"before {mit} after"), (7, "cc by " * 100_000), (8, "x" * 300_000),
        (9, "Licensed under CC BY-NC 4.0."), (10, "the the the general public licensee"), (11, mit.upper().replace("COPY,", "CLONE,")),
    ]
    docs = frame("doc_id long, text string, spans string, score string, n_words string", *[(*r, "a", "b", "c") for r in rows])
    found = licence_spans(docs)
    got = {(r["doc_id"], r["n_words"]): r for r in licence_digest(found).collect()}
    assert found.count() == len(rows)
    for doc_id, text in rows:
        n, *base = base_of(text)
        assert list(got[doc_id, n][2:6]) == base
    by_id = {key[0]: r for key, r in got.items()}
    assert by_id[6]["labels"] == by_id[11]["labels"] == "mit" and by_id[6]["score"] == 1 > by_id[11]["score"] > 0.9
    assert by_id[9]["labels"] == "cc-by,cc-by-nc" and by_id[7]["n_base"] == 100_000
    assert by_id[1]["score"] == 0 and by_id[1]["labels"] == ""
    spans = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert [(s["label"], s["first"], s["last"], s["covered"]) for s in spans[6]] == [("mit", 1, 1 + len(words_of(mit)), len(words_of(mit)))]
    assert licence_digest(licence_spans(docs.limit(0))).collect() == []
    with pytest.raises(ValueError):
        licence_spans(docs, phrases=[("none", "...")])
