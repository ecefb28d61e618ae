"""Best segmentations against all segmentations, counts against plain sums."""

import random
from collections import Counter

import pytest
import public_tokenizers
import regex

from gridscope.llm import trie_counts as C
from gridscope.llm.tokens import tokenizer_file
from gridscope.llm.trie_counts import PreTokenTrie, piece_scores, terminal_counts, unigram_token_counts


def all_segmentations(data):
    if not data:
        yield []
    for n in range(1, len(data) + 1):
        for rest in all_segmentations(data[n:]):
            yield [data[:n], *rest]


def best(data, scores):
    """(score, pieces) over all segmentations; a lone unknown byte is a piece."""
    known = lambda p: p in scores or len(p) == 1
    found = [s for s in all_segmentations(data) if all(map(known, s))]
    return max((sum(scores.get(p, C.UNKNOWN) for p in s), -len(s)) for s in found)


def test_trie_against_all_segmentations():
    draw = random.Random(9)
    scores = {"".join(draw.choices("abé", k=draw.randrange(1, 5))).encode(): -draw.randrange(1, 9) for _ in range(40)}
    trie = PreTokenTrie(scores)
    tokens = list({"".join(draw.choices("abcé", k=draw.randrange(1, 8))) for _ in range(120)})
    for token, node in zip(tokens, trie.nodes(tokens).tolist()):
        score, pieces = best(token.encode(), scores)
        assert (trie.best[node], -trie.count[node]) == (score, pieces)
    prefixes = {t.encode()[:k] for t in tokens for k in range(len(t.encode()) + 1)}
    assert len(trie.best) == len(prefixes)


def viterbi(token, scores):
    data, top = token.encode(), [(0, 0)]
    for end in range(1, len(data) + 1):
        top.append(max((top[a][0] + scores[data[a:end]], top[a][1] - 1) for a in range(end) if data[a:end] in scores))
    return top[-1]


@pytest.fixture(scope="module")
def scores():
    return piece_scores(tokenizer_file("byte_bpe_50k.tiktoken"))


def expected(rows, scores):
    find, out = regex.compile(public_tokenizers.PATTERN).findall, []
    for doc_id, text in rows:
        tokens = find(text or "")
        found = [viterbi(t, scores) for t in tokens]
        out.append((str(doc_id), len(text or ""), len(tokens), len(set(tokens)), -sum(n for _, n in found), sum(s for s, _ in found) / C.MILLION))
    return sorted(out)


def test_documents(table, scores, monkeypatch):
    docs = table("documents").filter("n_chars < 2000").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for nodes in (1_500_000, 10):
        monkeypatch.setattr(C, "MOST_NODES", nodes)
        got = sorted((str(r[0]), *tuple(r)[1:]) for r in unigram_token_counts(docs).collect())
        assert [g[:5] for g in got] == [w[:5] for w in expected(rows, scores)]
        assert [g[5] for g in got] == pytest.approx([w[5] for w in expected(rows, scores)])
    find = regex.compile(public_tokenizers.PATTERN).findall
    counts = Counter(t for _, text in rows for t in find(text))
    assert {r["pretoken"]: (r["occurrences"], r["n_tokens"]) for r in terminal_counts(docs).collect()} == {t: (n, -viterbi(t, scores)[1]) for t, n in counts.items()}


def test_odd_rows(spark, frame, scores):
    rows = [(1, None), (2, ""), (None, "it's é日 12"), (3, "again"), (3, "again"), (4, "  \n\n "), (5, "x" * 300), (6, "ab cd " * 20_000)]
    docs = frame("doc_id long, text string, n_chars string, pretoken int", *[(*r, "n", 1) for r in rows])
    got = sorted((str(r[0]), *tuple(r)[1:5]) for r in unigram_token_counts(docs).collect())
    assert got == [w[:5] for w in expected(rows, scores)]
    assert unigram_token_counts(docs.limit(0)).collect() == [] and terminal_counts(docs.limit(0)).collect() == []
