"""The trie's probabilities and the unigram against plain loops."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridscope.llm import ppm as P
from gridscope.llm.ppm import language_scores, string_probabilities



class PlainTrie:
    """Counts per context in a dictionary, and prediction with escapes, byte by byte."""

    def __init__(self, texts, order=5):
        self.order, self.counts = order, defaultdict(Counter)
        for text in texts:
            data = b"\0" * order + text + b"\0"
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.counts[data[i - k : i]][data[i]] += 1

    def byte(self, context, symbol):
        excluded, logp = set(), 0.0
        for k in range(self.order, -1, -1):
            seen = self.counts.get(context[self.order - k :])
            if not seen:
                continue
            rest = {s: n for s, n in seen.items() if s not in excluded}
            if rest:
                total = sum(rest.values())
                if symbol in rest:
                    return logp + math.log10((rest[symbol] - 0.5) / total)
                logp += math.log10(len(rest) / 2 / total)
            excluded |= set(seen)
        return logp - math.log10(256 - len(excluded))

    def score(self, text):
        data = b"\0" * self.order + text + b"\0"
        return sum(self.byte(data[i - self.order : i], data[i]) for i in range(self.order, len(data)))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(rows):
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5
    train = [words(t) for d, t in rows if fold(d) != 1]
    counts = Counter(w for t in train for w in [*t, "\0end"])
    n, v = sum(counts.values()), len(counts)
    trie = PlainTrie([" ".join(t).encode() for t in train])
    out = []
    for d, t in rows:
        own = [*words(t), "\0end"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        out.append((d, fold(d) == 1, len(own), sum(counts[w] > 0 for w in own), n, base, trie.score(" ".join(own[:-1]).encode())))
    return out


def same(got, want):
    line = lambda r: (str(r[0]), *r[1:5], round(r[6], 4))
    got, want = sorted(map(tuple, got), key=line), sorted(want, key=line)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("frequent", [2_000_000, 500, 1])
def test_documents(spark, table, frequent):
    docs = table("documents").filter("n_chars < 1500").limit(60)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = language_scores(docs, frequent=frequent).collect()
    want = expected(rows)
    same(got, want)
    assert any(r["held_out"] for r in got) and not all(r["held_out"] for r in got)


def test_odd_rows(spark, frame):
    rows = [(k, f"some text {k} of é words\n") for k in range(8)] + [(8, None), (9, ""), (10, " \n"), (None, "x"), (3, "again"), (3, "again"), (11, "nul \0 byte"), (12, "ab " * 30_000)]
    docs = frame("doc_id long, text string, uid string, train int, score string", *[(*r, "u", 1, "s") for r in rows])
    got = language_scores(docs).collect()
    same(got, expected(rows))
    assert language_scores(docs.limit(0)).collect() == []
    alone = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1][:1]
    same(language_scores(docs.filter(f"doc_id = {alone[0][0]}").limit(1)).collect(), expected(alone))


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(6)
    data = rng.choice(np.frombuffer(b"aabbcd ", np.uint8), 3000).astype(np.int64)
    codes = sum(data[k : len(data) - 5 + k] << (8 * (5 - k)) for k in range(6))
    pairs = np.zeros((256, 256), np.int64)
    np.add.at(pairs, ((codes >> 8) & 255, codes & 255), 1)
    names, counts = np.unique(codes, return_counts=True)
    middle = (names >> 8) & 0xFFFF
    for context in [*np.unique(names >> 8)[:40], (120 << 32) | (names[0] >> 8) & 0xFFFFFFFF]:
        asked = (int(context) << 8) | np.arange(256)
        own = middle == (int(context) & 0xFFFF)
        every = np.union1d(names[own], asked)
        train = np.zeros(len(every), np.int64)
        train[np.searchsorted(every, names[own])] = counts[own]
        p = 10 ** string_probabilities(every, train, pairs)
        assert p[np.searchsorted(every, asked)].sum() == pytest.approx(1, abs=1e-9)
    assert P.word_key(b"a") != P.word_key(b"b")


def test_strings_are_counted_in_order_and_added():
    """Counts of several pieces are one ascending table; each text has a string per byte and one for its end."""
    texts = ["ab ab", "", "  Éa\tB ", "ab ab"]
    split = P._words(texts)[-1]
    strings, sizes = P._strings(split)
    plain = [b"\0" * 5 + " ".join(words(t)).encode() + b"\0" for t in texts]
    want = [int.from_bytes(x[i : i + 6], "big") for x in plain for i in range(len(x) - 5)]
    assert strings.tolist() == want and sizes.tolist() == [len(x) - 5 for x in plain]
    half = np.array(want[:7], np.int64), np.array(want[7:], np.int64)
    names, n = P._added(*(P._counted(x) for x in half))
    assert dict(zip(names.tolist(), n.tolist())) == Counter(want) and names.tolist() == sorted(set(want))
    many = [[P.END_WORD]] * (P.MOST_TEXTS + 1)
    assert [x.stop - x.start for x in P._portions(many)] == [P.MOST_TEXTS, 1]
