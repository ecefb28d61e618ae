"""Fill-in-middle examples against plain string work, their way back, and odd tables."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridscope.llm import infilling
from gridscope.llm.buffers import byte_pieces, text_array, text_bytes
from gridscope.llm.infilling import filled, infilling_examples, rebuilt, with_restored

FORMS = ["plain", "psm", "spm"]


def numbers_of(doc_id):
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def example(doc_id, text, rate=100, suffix_first=50):
    """(n, form, prefix_chars, middle_chars, output) by string work."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b, c, d = numbers_of(doc_id)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= rate:
        return len(units), "plain", None, None, text
    low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if d % 100 < suffix_first:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("chunk", [7, 4_000_000])
@pytest.mark.parametrize("rate", [100, 40])
def test_random_texts(monkeypatch, chunk, rate):
    monkeypatch.setattr(infilling, "CHUNK", chunk)
    rng = random.Random(chunk + rate)
    atoms = ["a", "é", "\n", "日本", "<", "P", ">", "<P", "S>", "x", "\n\n", "🙂"]
    for first in range(150):
        texts = ["".join(rng.choices(atoms, k=rng.choice([0, 1, 2, 5, 40]))) for _ in range(rng.randint(0, 9))]
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        ids = range(first, first + len(texts))
        drawn = np.array([numbers_of(i) for i in ids], np.int64).reshape(-1, 4)
        found = filled(data, offsets, drawn, rate, 50)
        outputs = text_array(found["output"], found["offsets"]).to_pylist()
        for k, (doc_id, text) in enumerate(zip(ids, texts)):
            n, form, prefix, middle, output = example(doc_id, text, rate)
            assert (found["n"][k], FORMS[found["form"][k]], outputs[k]) == (n, form, output)
            if form != "plain":
                assert (found["prefix_chars"][k], found["middle_chars"][k]) == (prefix, middle)
        again = text_array(*rebuilt(found["output"], found["offsets"], found["form"] == 0))
        assert again.to_pylist() == texts


def test_text_bytes_of_slices_and_nulls():
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["ab", None, "", "é", "xyz"], kind)
        for part in (column, column.slice(1, 3), column.slice(4), column.slice(0, 0), pa.nulls(3, kind)):
            assert text_array(*text_bytes(part)).to_pylist() == [t or "" for t in part.to_pylist()]
    batch = pa.record_batch({"text": ["a" * n for n in (3, 0, 9, 1, 1)]})
    got = [(rows.num_rows, bytes(data), offsets.tolist()) for rows, data, offsets in byte_pieces([batch], 4)]
    assert got == [(2, b"aaa", [0, 3, 3]), (1, b"a" * 9, [0, 9]), (2, b"aa", [0, 1, 2])]


def test_documents(spark, table):
    docs = table("documents")
    want = {r["doc_id"]: (example(r["doc_id"], r["text"]), r["text"]) for r in docs.select("doc_id", "text").collect()}
    got = with_restored(infilling_examples(docs)).collect()
    assert len(got) == len(want)
    for r in got:
        assert (tuple(r[1:6]), r["restored"]) == (want[r["doc_id"]][0], want[r["doc_id"]][1])


def test_odd_rows(spark, frame):
    rows = [
        (1, None), (1, None), (2, ""), (None, "a\nb\nc\n"), (None, "a\nb\nc\n"), (3, "one line"), (4, "with <M> inside\nx"),
        (5, "\n"), (6, "é\r\nü\n" * 200_000), (7, "\x00\n a"), (-8, "a\nb"),
    ]
    docs = frame("doc_id long, text string, n string, form string, output string, h0 string, restored string", *[(*r, "n", "f", "o", "h", "r") for r in rows])
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted((tuple(r) for r in with_restored(infilling_examples(docs)).collect()), key=key)
    assert got == sorted(((d, *example(d, t), t or "") for d, t in rows), key=key)
    assert with_restored(infilling_examples(docs.limit(0))).collect() == []
    some = infilling_examples(docs, rate=0).collect()
    assert {r["form"] for r in some} == {"plain"} and {r["output"] for r in some} == {t or "" for _, t in rows}
