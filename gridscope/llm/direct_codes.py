"""Directly addressable codes: token files in which any token is read without its neighbours.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every id, level 1
the next chunk of those ids that need one, and so on. A bitmap per level marks the ids that
go on, and a rank directory counts the marks before each block of 512, so the place of an
id's next chunk is one directory entry plus the marks in part of a block.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.llm.common import edges, partitions, pieces, range_of, records, shared_folder, texts_of
from gridscope.llm.tokens import tokenizer_file, worker_encoder

MAGIC = b"DAC1"
BLOCK = 512
#: Tokens after which a shard file ends; a longer document is a shard by itself.
SHARD_TOKENS = 1_000_000
END_ID = 0


def encode_codes(ids: np.ndarray) -> bytes:
    """The levels of an id sequence (unsigned, up to 32 bits)."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    levels = []
    while True:
        more = rest > 0xFF
        marks = np.packbits(more, bitorder="little")
        marks = np.pad(marks, (0, -len(marks) % (BLOCK // 8)))
        counts = np.bitwise_count(marks).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])
        levels.append((rest.astype(np.uint8), marks, ranks))
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            break
    out = [MAGIC, struct.pack("<BQ", len(levels), len(ids))]
    for chunks, marks, ranks in levels:
        out += [struct.pack("<QQQ", len(chunks), len(marks), len(ranks)), chunks.tobytes(), marks.tobytes(), ranks.tobytes()]
    return b"".join(out)


class DirectCodes:
    """Reads what encode_codes wrote, by position, without copying the buffer."""

    def __init__(self, buffer: bytes):
        if buffer[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        count, self.n = struct.unpack_from("<BQ", buffer, 4)
        at, self.levels = 13, []
        for _ in range(count):
            sizes = struct.unpack_from("<QQQ", buffer, at)
            at += 24
            level = []
            for size, kind in zip(sizes, (np.uint8, np.uint8, "<u8")):
                level.append(np.frombuffer(buffer, kind, size, at))
                at += size * np.dtype(kind).itemsize
            self.levels.append(level)
        self.end = at

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, i: int) -> int:
        _, marks, ranks = self.levels[level]
        block, byte = i // BLOCK, i // 8
        inside = marks[block * (BLOCK // 8) : byte]
        last = int(marks[byte]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(ranks[block]) + int(np.bitwise_count(inside).sum()) + last.bit_count()

    def __getitem__(self, i: int) -> int:
        """The id at a position: one chunk per level, no other id is decoded."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift, level = 0, 0, 0
        while True:
            chunks, marks, _ = self.levels[level]
            value |= int(chunks[i]) << shift
            if not (int(marks[i // 8]) >> (i % 8)) & 1:
                return value
            i, level, shift = self._rank(level, i), level + 1, shift + 8

    def slice(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """The ids from start to before stop; only their own chunks are read."""
        chunks, marks, _ = self.levels[level]
        out = chunks[start:stop].astype(np.uint32)
        first = start // 8
        bits = np.unpackbits(marks[first : (stop + 7) // 8], bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
        if bits.any():
            below = self._rank(level, start)
            out[bits] |= self.slice(below, below + int(bits.sum()), level + 1) << np.uint32(8)
        return out


def shard_file(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    """A file: the number of documents, their ids and first positions, then the codes."""
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    head = struct.pack("<Q", len(doc_ids)) + valid.tobytes() + numbers.tobytes() + starts.tobytes()
    return head + encode_codes(np.concatenate(ids))


def open_shard(buffer: bytes) -> tuple[list, np.ndarray, DirectCodes]:
    """Document ids, their first positions (and the end), and the codes of a file."""
    (n,) = struct.unpack_from("<Q", buffer, 0)
    valid = np.frombuffer(buffer, np.uint8, n, 8)
    numbers = np.frombuffer(buffer, "<i8", n, 8 + n)
    starts = np.frombuffer(buffer, "<u8", n + 1, 8 + 9 * n).astype(np.int64)
    doc_ids = [int(d) if v else None for d, v in zip(numbers, valid)]
    return doc_ids, starts, DirectCodes(memoryview(buffer)[8 + 9 * n + 8 * (n + 1) :])


def write_token_shards(
    docs: DataFrame,
    path: str,
    vocabulary: str = "byte_bpe_50k.json",
    id_column: str = "doc_id",
    text_column: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Write the token ids of all texts, in ascending doc_id order, as shard files.

    Each row of the Parquet folder `path` is one file: `range` and `number` give its place
    in the order, `before` the tokens of its range before it, `payload` its bytes. Texts
    are split into even doc_id ranges, each sorted and encoded by one task; only shards of
    about shard_tokens are held in memory. Null texts are empty; every document ends with
    id 0; null ids come first; rows with equal ids are ordered by text.
    """
    rows = texts_of(docs, id_column, text_column)
    parts = partitions(docs.sparkSession)
    cuts = edges(rows, "doc_id", parts)
    dealt = rows.select(range_of(F.col("doc_id"), cuts).alias("range"), "doc_id", "text").repartitionById(len(cuts) + 1, F.col("range"))
    kinds = {"range": pa.int32(), "number": pa.int32(), "before": pa.int64(), "n_tokens": pa.int64(), "n_docs": pa.int64(), "payload": pa.binary()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_file(vocabulary), keep_space=True)
        where, number, before = 0, 0, 0
        names, ids, size = [], [], 0

        def shard():
            return records(kinds, [[where], [number], [before], [size], [len(names)], [shard_file(names, ids)]])

        for some in pieces(batches):
            where = some[0][0]
            for (_, doc_id, _), own in zip(some, encoder.encode([t for *_, t in some])):
                names.append(doc_id)
                ids.append(np.append(own, np.uint32(END_ID)))
                size += len(ids[-1])
                if size >= shard_tokens:
                    yield shard()
                    number, before, names, ids, size = number + 1, before + size, [], [], 0
        if names:
            yield shard()

    schema = "range int, number int, before long, n_tokens long, n_docs long, payload binary"
    dealt.sortWithinPartitions("doc_id", "text").mapInArrow(encode, schema).write.option("compression", "none").parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document of written shards: doc_id, start, n_tokens and the crc32 of its ids.

    start counts the ids of all documents before it. The driver sees one total per range.
    """
    shards = spark.read.parquet(path)
    totals = shards.groupBy("range").agg(F.sum("n_tokens").alias("n")).orderBy("range").collect()
    starts, before = {}, 0
    for row in totals:
        starts[row["range"]] = before
        before += row["n"]
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, first, payload in zip(*(c.to_pylist() for c in batch.columns)):
                doc_ids, at, codes = open_shard(payload)
                crcs = [zlib.crc32(codes.slice(a, b).astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield records(kinds, [doc_ids, at[:-1] + (starts[where] + first), np.diff(at), crcs])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return shards.select("range", "before", "payload").mapInArrow(decode, schema)


def token_file_digest(docs: DataFrame) -> DataFrame:
    """Write the shards of a table to a new folder of the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    write_token_shards(docs, path)
    return read_token_shards(spark, path)
