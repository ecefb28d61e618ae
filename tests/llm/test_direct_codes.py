"""Token files: every token against the tokenizers library, random access, odd tables."""

import zlib

import random

import numpy as np
import pytest

from gridscope.llm.direct_codes import DirectCodes, encode_codes, token_file_digest
from gridscope.llm.tokens import TextEncoder, tokenizer_file

ODD = [
    "", " ", "  a  b ", "one two's  three\n four \tfive", "a\n\n b", " x   y", "x ́y", "!? ?! 12 345",
    "é ü 日本語 текст", " lead", "trail ", "a\x1cb \x1c c", "<|endoftext|> and <|startoftext|>", "I'M it's 'tis '", "ΟΔΥΣΣΕΥΣ ΣΣ",
]


def brute(texts, name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file(name))
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name, keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_those_of_the_library(table, monkeypatch, name, keep):
    texts = ODD + [r["text"] for r in table("documents").select("text").limit(80).collect()]
    encoder = TextEncoder(tokenizer_file(name), keep)
    want = brute(texts, name)
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [x.tolist() for x in encoder.encode(texts)] == want
    monkeypatch.setattr("gridscope.llm.tokens.REMEMBERED", 10)
    small = TextEncoder(tokenizer_file(name), keep)
    assert [x.tolist() for x in small.encode(texts[:30]) + small.encode(texts[30:])] == want


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
    codes = DirectCodes(encode_codes(ids))
    assert len(codes) == n
    assert codes.slice(0, n).tolist() == ids.tolist()
    for i in rng.integers(0, n, min(n, 200)):
        assert codes[int(i)] == ids[i]
        assert codes.slice(int(i), min(n, int(i) + 70)).tolist() == ids[i : i + 70].tolist()
    with pytest.raises(IndexError):
        codes[n]


def expected(rows):
    """Digest of (doc_id, text) rows by the library alone."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out, start = [], 0
    for (doc_id, _), ids in zip(rows, brute([t or "" for _, t in rows], "byte_bpe_50k.json")):
        ids = np.array([*ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=lambda r: r[1])


def test_digest_of_the_documents(spark, table):
    docs = table("documents")
    got = sorted((tuple(r) for r in token_file_digest(docs).collect()), key=lambda r: r[1])
    assert got == expected([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_nulls_ties_and_other_columns(spark, frame):
    rows = [(3, "b"), (3, "a"), (None, "x y"), (1, None), (1, None), (2, ""), (9, "long text " * 3000)]
    docs = frame("doc_id long, text string, range int, payload string", *[(*r, 1, "p") for r in rows])
    got = sorted((tuple(r) for r in token_file_digest(docs).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    assert token_file_digest(docs.limit(0)).collect() == []


@pytest.mark.parametrize("name, keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_new_words_are_asked_for_together(name, keep):
    """Many new words are one text of the library, lines are parts, and odd texts keep their ids."""
    encoder = TextEncoder(tokenizer_file(name), keep)
    library, asked = encoder.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    encoder.tokenizer = Counting()
    draw = random.Random(3)
    odd = ["".join(draw.choices("ab0 \n\n  .'sAΣé́　\t\r\x1cĠ1", k=draw.randrange(30))) for _ in range(500)]
    plain = ["\n".join(" ".join(f"w{draw.randrange(1, 10)}x{k}y{j}." for j in range(1, 9)) for k in range(1, 9)) for _ in range(20)]
    for texts in (odd, plain):
        asked.clear()
        want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode(texts)] == want
    assert len(asked) < len({w for t in plain for w in t.split()}) / 5
