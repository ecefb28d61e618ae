"""Importance resampling: hashes, table and whole draw against plain Python; odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from gridscope.llm import importance
from gridscope.llm.buffers import text_bytes
from gridscope.llm.common import stored
from gridscope.llm.importance import RunTable, Runs, Words, bucket_counts, importance_draw, numbered, word_checksums, xxhash64

FIND = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = FIND((text or "").translate(LOW))
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def draw(rows, target, share=5, least=20):
    """(doc_id, n_words, n_features, weight, score, rank) by plain Python."""
    counts = [Counter(bucket(f) for t in texts for f in features(t)) for texts in ([t for _, t in rows], target)]
    s, t = (sum(c.values()) for c in counts)
    gain = lambda b: math.floor(1000 * math.log((counts[1][b] + 1) * (s + 10_000) / ((counts[0][b] + 1) * (t + 10_000))))
    out = []
    for doc_id, text in rows:
        found = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(FIND((text or "").translate(LOW))), len(found), weight, weight + noise, None])
    eligible = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(eligible[: share * len(eligible) // 100], 1):
        r[5] = k
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def random_texts(rng):
    atoms = ["a", "B", "é", "Z9", "日本", " ", "  ", ".", "\n", "x" * rng.choice([1, 40, 70, 200, 9000])]
    return ["".join(rng.choices(atoms, k=rng.choice([0, 1, 2, 5, 60]))) for _ in range(rng.randint(0, 9))]


def test_runs_of_random_texts():
    rng = random.Random(5)
    gains = np.random.default_rng(5).integers(-5000, 5000, 10_000)
    for _ in range(150):
        texts = random_texts(rng)
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        found, want = Runs(data, offsets), [features(t) for t in texts]
        assert found.n_runs.tolist() == list(map(len, want))
        assert found.weights(gains).tolist() == [sum(int(gains[bucket(f)]) for f in w) for w in want]
        counts = Counter(bucket(f) for w in want for f in w)
        assert dict(enumerate(found.bucket_counts(10_000))) == {b: counts[b] for b in range(10_000)}
        assert len(found.filled) == len({f for w in want for f in w})
        words = Words(data, offsets)
        first, _, sizes = words.runs()
        raw = [bytes(words.data[a : a + n]) for a, n in zip(words.starts[first].tolist(), sizes.tolist())]
        assert xxhash64(words, words.starts[first], sizes).tolist() == [xxhash.xxh64_intdigest(r) for r in raw]
        assert word_checksums(words).tolist() == [zlib.crc32(w.encode()) for t in texts for w in FIND(t.translate(LOW))]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(importance, "xxhash64", lambda words, starts, sizes: np.full(len(starts), 7, np.uint64))
    texts = ["one two one two three", "two one", "a b c d " + "long" * 30 + " " + "long" * 30 + "x"]
    words = Words(*text_bytes(pa.array(texts)))
    first, count, sizes = words.runs()
    table = RunTable(words, first, sizes)
    runs = [f for n in (1, 2, 3) for t in texts for f in (" ".join(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1))]
    for i, a in enumerate(runs):
        for j, b in enumerate(runs):
            assert (table.slots[i] == table.slots[j]) == (a == b)
        assert table.count[table.slots[i]] == runs.count(a)


def test_documents(spark, table):
    docs, target = table("documents"), table("benchmark")
    want = draw([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], [r["text"] for r in target.collect()])
    got = importance_draw(docs, target).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert ordered(got) == ordered(want)
    assert sum(r["rank"] is not None for r in got) == 5 * sum(r["n_words"] >= 20 for r in got) // 100 > 0


def test_odd_rows(spark, frame):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(["the", "Cat", "sat", "é"], k=rng.randint(15, 40)))) for k in range(40)]
    rows += [(1, rows[1][1])] * 3 + [(None, rows[2][1]), (None, rows[3][1]), (50, None), (51, ""), (52, "word " * 100_000), (53, "x" * 300_000)]
    docs = frame("doc_id long, text string, score string, rank string, _tie int, _part int, weight int", *[(*r, "s", "r", 1, 2, 3) for r in rows])
    target = frame("text string, bucket int", ("the cat", 1), (None, 2), ("", 3))
    got = importance_draw(docs, target, share=30).collect()
    assert ordered(got) == ordered(draw(rows, ["the cat", None, ""], share=30))
    assert importance_draw(docs.limit(0), target).collect() == []
    got = importance_draw(docs, target.limit(0), share=100).collect()
    assert ordered(got) == ordered(draw(rows, [], share=100))


def test_ranks_over_partitions(spark):
    rows = stored(spark.range(0, 5000, 1, 7).selectExpr("id", "id % 3 AS score"))
    got = numbered(rows, rows["score"].desc()).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))
    by_rank = sorted(got, key=lambda r: r["rank"])
    assert [r["score"] for r in by_rank] == sorted((r["score"] for r in got), reverse=True)


def test_counts_do_not_depend_on_partitions(spark, table):
    texts = table("documents").select("text")
    assert (bucket_counts(texts) == bucket_counts(texts.repartition(7))).all()
