"""Vector best-fit packing of token sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces come in descending length; each goes to the open bin that fits under every
capacity and whose residuals match best: by the smallest weighted norm of what would be
left, or by the largest weighted dot-product of demand and residual.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.llm.common import pieces, records, stored, texts_of
from gridscope.llm.tokens import tokenizer_file, worker_encoder

CAPACITY = 2048
END_ID = 0
#: Pieces that are packed together, on average; a group is one task's work.
GROUP_PIECES = 16_384


def best_fit(
    lengths: np.ndarray,
    capacity: int = CAPACITY,
    most_documents: int = CAPACITY,
    most_attention: int = CAPACITY**2,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece; pieces of equal length keep their order.

    Ties between bins go to the one opened first.
    """
    full = np.array([capacity, most_documents, most_attention], np.float64)
    scale = np.asarray(weights, np.float64) / full**2
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = np.empty((max(1, len(lengths)), 3), np.float64)
    names = np.empty(max(1, len(lengths)), np.int64)
    n_open = made = 0
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    shortest = np.minimum.accumulate(np.asarray(lengths)[order][::-1])[::-1] if len(lengths) else lengths
    for place, i in enumerate(order):
        need = np.array([lengths[i], 1, float(lengths[i]) ** 2])
        if (need > full).any():
            raise ValueError("a piece exceeds a capacity")
        fits = np.flatnonzero((left[:n_open] >= need).all(axis=1)) if n_open else np.empty(0, np.int64)
        if len(fits):
            room = left[fits]
            merit = -(((room - need) ** 2) @ scale) if rule == "norm" else room @ (scale * need)
            at = fits[np.flatnonzero(merit == merit.max())]
            at = at[np.argmin(names[at])]
        else:
            at, n_open = n_open, n_open + 1
            left[at], names[at], made = full, made, made + 1
        bins[i], offsets[i] = names[at], capacity - left[at, 0]
        left[at] -= need
        least = shortest[place + 1] if place + 1 < len(order) else np.inf
        if left[at, 0] < least or left[at, 1] < 1 or left[at, 2] < least**2:
            # No later piece fits: the last open bin takes its row.
            n_open -= 1
            left[at], names[at] = left[n_open], names[n_open]
    return bins, offsets


def token_pieces(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
    remembered: int | None = None,
) -> DataFrame:
    """doc_id, piece, start, length and the crc32 of the ids of every piece of every text.

    Null texts are empty; each document ends with id 0; only documents beyond the capacity
    are cut, into pieces of exactly the capacity and a rest. A Python worker remembers the ids of
    so many words (by default those of the library's tokens module).
    """
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_file(vocabulary), False, remembered)
        for some in pieces(batches):
            out = []
            for (doc_id, _), own in zip(some, encoder.encode([t for *_, t in some])):
                ids = np.append(own, np.uint32(END_ID)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
            yield records(kinds, list(zip(*out)))

    rows = texts_of(docs, id_column, text_column)
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_sequences(
    parts: DataFrame,
    expected: int,
    capacity: int = CAPACITY,
    most_documents: int = CAPACITY,
    most_attention: int = CAPACITY**2,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ids_crc32).

    Pieces are dealt by hash into groups of about GROUP_PIECES (expected: how many pieces
    there are, roughly), and each group is packed by itself: at most one sequence per group
    stays open, and no task grows with the table. Only lengths move, never ids. The dealing
    also takes the place of a row in its file, so repeated rows spread too. A sequence id is
    its group in the high bits and its number below.
    """
    groups = max(1, round(expected / GROUP_PIECES))
    dealt = parts.withColumn("_deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([(name, "ascending") for name in ("doc_id", "piece", "ids_crc32")])
        bins, offsets = best_fit(group["length"].to_numpy(), capacity, most_documents, most_attention, weights, rule)
        sequences = (group["_deal"].to_numpy() << 32) + bins
        return group.drop_columns("_deal").append_column("sequence_id", pa.array(sequences)).append_column("offset", pa.array(offsets))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("_deal").applyInArrow(pack, schema)


def packed(docs: DataFrame, remembered: int | None = None) -> DataFrame:
    """All texts of a table cut and packed with the production settings.

    Null and empty texts are one piece, their end id alone; a text of any length is cut whole
    into pieces. Rows with equal ids or texts are packed each for itself, in an order by id, piece
    and checksum, so ties don't change sequences; null ids are ids. Columns but id and
    text don't matter; an empty table gives an empty one.
    """
    # Lengths only; a long text has many pieces, so these are counted and not the documents.
    parts = stored(token_pieces(docs, remembered=remembered))
    return pack_sequences(parts, parts.count())
