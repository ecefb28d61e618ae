"""Closed-syncmer fingerprints of texts.

A k-mer of characters is a closed syncmer if the smallest hash of its s-mers is that of its
first or its last s-mer. The choice looks at the k-mer alone, so the same passage gives the
same anchors wherever it stands. A fingerprint holds all anchors by position; two
fingerprints are compared by the anchors they share in the same order.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.llm.common import edges, partitions, pieces, range_of, records, texts_of

#: Characters of an anchor and of its inner strings: one of 6.5 k-mers is an anchor.
K, S = 20, 8
#: Windows that are hashed at once, whatever the length of a text.
WINDOWS = 500_000
FACTOR = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(FACTOR, n, 1 << 64))


def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every window of the length, from those of half the length."""
    if length == 1:
        return codes
    half = length // 2
    part = _hashes(codes, half)
    n = len(codes) - length + 1
    both = part[:n] * _power(half) + part[half : half + n]
    return both if length % 2 == 0 else both * _power(1) + codes[length - 1 : length - 1 + n]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of the width."""
    low, have = values, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


def _window_anchors(codes: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    inner = _mixed(_hashes(codes, s))
    span = k - s
    low = _least(inner, span + 1)
    at = np.flatnonzero((inner[: len(low)] == low) | (inner[span : span + len(low)] == low))
    return at, _mixed(_hashes(codes, k)[at])


def anchors(texts: list[str], k: int = K, s: int = S) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and hashes of all closed syncmers of each text, ascending by position.

    A text is padded by k - 1 empty characters on either side, so the shortest text has
    anchors; positions count from the padding. An empty text has none.
    """
    gap = np.zeros(k - 1, np.uint64)
    parts, sizes = [gap], []
    for text in texts:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sizes.append(len(codes))
        parts += [codes, gap]
    codes = np.concatenate(parts)
    # The windows that begin in a text or in the padding before it; an empty text has none.
    begins = np.concatenate([[0], np.cumsum([n + k - 1 for n in sizes])])
    found = [_window_anchors(codes[a : a + WINDOWS + k - 1], k, s) for a in range(0, max(0, len(codes) - k + 1), WINDOWS)]
    at = np.concatenate([x + n * WINDOWS for n, (x, _) in enumerate(found)]) if found else np.empty(0, np.int64)
    hashes = np.concatenate([h for _, h in found]) if found else np.empty(0, np.uint64)
    cuts = np.searchsorted(at, begins)
    return [
        (at[a:b] - begin, hashes[a:b]) if n else (at[:0], hashes[:0])
        for a, b, begin, n in zip(cuts, cuts[1:], begins, sizes)
    ]


class Fingerprint:
    """All anchors of a text: 32 bits of their hashes and their positions, ascending."""

    def __init__(self, positions: np.ndarray, hashes: np.ndarray):
        self.positions, self.hashes = positions, (hashes & np.uint64(0xFFFFFFFF)).astype("<u4")
        # Distinct hashes ascending, each with its first position.
        self.distinct, first = np.unique(self.hashes, return_index=True)
        self.first = positions[first]

    def text(self) -> str:
        """Four bytes of hash and one of distance to the anchor before for every anchor, in base 64.

        No window of K - S + 1 places is without an anchor, so a distance fits a byte.
        """
        out = np.empty((len(self.hashes), 5), np.uint8)
        out[:, :4] = self.hashes.view(np.uint8).reshape(-1, 4)
        out[:, 4] = np.diff(self.positions, prepend=0)
        return base64.b64encode(out.tobytes()).decode()


def fingerprints(texts: list[str]) -> list[Fingerprint]:
    return [Fingerprint(*a) for a in anchors(texts)]


def in_order(positions: np.ndarray) -> int:
    """The most entries that ascend from left to right."""
    if len(positions) < 2 or (np.diff(positions) > 0).all():
        return len(positions)
    tails: list[int] = []
    for p in positions.tolist():
        at = bisect_left(tails, p)
        tails[at : at + 1] = [p]
    return len(tails)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1: the share of the distinct anchors of both that are common and in the same order.

    Twice the most common anchors whose first positions ascend in both, over the distinct
    anchors of the one and the other. Two empty fingerprints are alike.
    """
    total = len(a.distinct) + len(b.distinct)
    if not total:
        return 1.0
    _, x, y = np.intersect1d(a.distinct, b.distinct, assume_unique=True, return_indices=True)
    return 2 * in_order(b.first[y][np.argsort(a.first[x], kind="stable")]) / total


def edited_text(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of the other one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: n_chars, its fingerprint, that of its edited text, and how like they are.

    The next document goes by descending doc_id, the first one follows the last; null ids
    come last, rows with equal ids go by text; null texts are empty. Texts are dealt once
    into even id ranges and sorted there; the first document of a range is sent to the end
    of the range before it too, so every document meets its next one in its own task.
    """
    rows = texts_of(docs, id_column, text_column)
    cuts = edges(rows, "doc_id", partitions(docs.sparkSession))
    largest = rows.agg(F.max("doc_id").alias("m")).first()["m"]
    # Each cut is an id that occurs, so every range but the first begins with its cut.
    cuts = [c for c in cuts if c != largest]
    place = range_of(F.col("doc_id"), cuts, ascending=False)
    places = [F.struct(place.alias("range"), F.lit(False).alias("guest"))]
    as_guest = F.when(F.col("doc_id").isin(cuts), place - 1) if cuts else F.lit(None).cast("int")
    if largest is not None:
        as_guest = F.when(F.col("doc_id") == largest, F.lit(len(cuts))).otherwise(as_guest)
    places.append(F.when(as_guest.isNotNull(), F.struct(as_guest.alias("range"), F.lit(True).alias("guest"))))
    dealt = rows.select("doc_id", "text", F.explode(F.array_compact(F.array(*places))).alias("to"))
    dealt = dealt.select("to.range", "to.guest", "doc_id", "text").repartitionById(len(cuts) + 1, F.col("range"))
    dealt = dealt.sortWithinPartitions("guest", F.col("doc_id").desc_nulls_last(), "text").select("guest", "doc_id", "text")
    kinds = {
        "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
        "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
    }

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None

        def result(pairs):
            """Rows (doc_id, text, fingerprint) with the ones that follow them."""
            edited = [edited_text(a[1], b[1]) for a, b in pairs]
            out = []
            for (a, b), text, own in zip(pairs, edited, fingerprints(edited)):
                digest = hashlib.sha256(text.encode()).hexdigest()
                out.append((a[0], len(a[1]), digest, a[2].text(), own.text(), likeness(a[2], own), likeness(a[2], b[2])))
            return records(kinds, list(zip(*out)))

        for some in pieces(batches):
            line = [(doc_id, text, own, guest) for (guest, doc_id, text), own in zip(some, fingerprints([t for *_, t in some]))]
            first = first or line[0]
            if held is not None:
                line.insert(0, held)
            pairs = [(a, b) for a, b in zip(line, line[1:]) if not a[3]]
            held = line[-1]
            if pairs:
                yield result(pairs)
        if held is not None and not held[3]:
            yield result([(held, first)])

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return dealt.mapInArrow(compare, schema)
