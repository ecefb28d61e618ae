"""Importance resampling towards a target distribution over hashed n-grams.

Documents are drawn by the likeness of their runs of one to three words to those of a
target: each run falls into a bucket, a bucket's gain is the logarithm of its share in the
target over its share in the corpus, and a document weighs the sum of its gains. Gumbel
noise on the weights and the largest sums make a weighted draw without replacement.

Inside a task, the runs of a batch are interned in an open-addressed table of numpy arrays:
the xxhash64 of a run's bytes gives its slot, the bytes themselves are compared where hashes
are equal, and each distinct run has one bucket and one count. Occurrences keep slot numbers,
through which they gather the gains.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridscope.llm.buffers import byte_pieces
from gridscope.llm.common import stored

BUCKETS = 10_000
LONGEST_RUN = 3
#: Percent of the eligible documents that are drawn, and the words a document needs for it.
SHARE, LEAST_WORDS = 5, 20
SEED = 42
#: Bytes of text in one table.
TABLE_BYTES = 250_000
#: Longer runs are hashed and compared one by one; runs of 32 bytes have another way to hash.
LONG_RUN, LONG_WORD = 32, 64
_SPACE = 0x20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.zeros(256, bool)
for _first, _last in ((ord("0"), ord("9")), (ord("a"), ord("z")), (0x80, 0xFF)):
    _IS_WORD[_first : _last + 1] = True

# The primes of XXH64 and the reflected polynomial of CRC-32.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
_POLYNOMIAL = 0xEDB88320


class Words:
    """The words of texts in one buffer, A-Z in lower case, each followed by one space."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = _LOWER[data]
        inside = _IS_WORD[low]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        # Texts stand side by side; no word goes on from one to the next.
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        begins = np.flatnonzero(inside & ~before)
        self.sizes = np.flatnonzero(inside & ~after) + 1 - begins
        self.owners = np.searchsorted(offsets, begins, "right") - 1
        self.count = len(begins)
        self.starts = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        total = int(self.sizes.sum())
        # Eight more bytes, so a lane can be read at every place.
        self.data = np.full(total + self.count + 8, _SPACE, np.uint8)
        self.data[np.arange(total) + np.repeat(np.arange(self.count), self.sizes)] = low[inside]
        self.lanes = np.ascontiguousarray(np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,)))

    def runs(self, longest: int = LONGEST_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, bytes) of all runs of 1 to `longest` words inside a text."""
        first, words = [], []
        for n in range(1, longest + 1):
            whole = np.flatnonzero(self.owners[: self.count - n + 1] == self.owners[n - 1 :]) if self.count >= n else np.empty(0, np.int64)
            first.append(whole)
            words.append(np.full(len(whole), n))
        first, words = np.concatenate(first), np.concatenate(words)
        last = first + words - 1
        return first, words, self.starts[last] + self.sizes[last] - self.starts[first]


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxhash64(words: Words, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of byte ranges of the buffer."""
    h = sizes.astype(np.uint64) + _P5
    for at in range(0, LONG_RUN - 8, 8):
        on = np.flatnonzero((sizes >= at + 8) & (sizes < LONG_RUN))
        lane = _rotated(words.lanes[starts[on] + at] * _P2, 31) * _P1
        h[on] = _rotated(h[on] ^ lane, 27) * _P1 + _P4
    done = sizes & ~7
    on = np.flatnonzero((sizes & 4 > 0) & (sizes < LONG_RUN))
    h[on] = _rotated(h[on] ^ (words.lanes[starts[on] + done[on]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
    done = sizes & ~3
    for k in range(3):
        on = np.flatnonzero((sizes & 3 > k) & (sizes < LONG_RUN))
        h[on] = _rotated(h[on] ^ words.data[starts[on] + done[on] + k].astype(np.uint64) * _P5, 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(sizes >= LONG_RUN)
    view = memoryview(words.data)
    h[long] = np.fromiter((xxhash.xxh64_intdigest(view[a : a + n]) for a, n in zip(starts[long].tolist(), sizes[long].tolist())), np.uint64, len(long))
    return h


def _equal(words: Words, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the byte ranges of the given sizes at a and b hold the same bytes."""
    same = np.ones(len(a), bool)
    view = memoryview(words.data)
    for i in np.flatnonzero(sizes >= LONG_RUN).tolist():
        same[i] = view[a[i] : a[i] + sizes[i]] == view[b[i] : b[i] + sizes[i]]
    for at in range(0, LONG_RUN, 8):
        on = np.flatnonzero((sizes > at) & (sizes < LONG_RUN))
        unlike = words.lanes[a[on] + at] ^ words.lanes[b[on] + at]
        # Bytes beyond the range are shifted out.
        unlike <<= (8 * (8 - np.minimum(sizes[on] - at, 8))).astype(np.uint64)
        same[on] &= unlike == 0
    return same


class RunTable:
    """An open-addressed table of the distinct runs of a batch.

    slots[i] is the slot of run i; of a slot, `holder` is one of its runs (-1: empty) and
    `count` the number of its runs.
    """

    def __init__(self, words: Words, first: np.ndarray, sizes: np.ndarray):
        starts = words.starts[first]
        keys = xxhash64(words, starts, sizes)
        size = 1 << max(3, (2 * len(keys)).bit_length())
        self.holder = np.full(size, -1, np.int32)
        self.slots = np.empty(len(keys), np.int32)
        open_ = np.arange(len(keys), dtype=np.int32)
        at = (keys & np.uint64(size - 1)).astype(np.int32)
        while len(open_):
            free = self.holder[at] < 0
            # Of several runs at a free slot one is written; the others compare with it.
            self.holder[at[free]] = open_[free]
            held = self.holder[at]
            found = held == open_
            like = np.flatnonzero(~found & (keys[held] == keys[open_]) & (sizes[held] == sizes[open_]))
            found[like] = _equal(words, starts[held[like]], starts[open_[like]], sizes[open_[like]])
            self.slots[open_[found]] = at[found]
            open_, at = open_[~found], (at[~found] + 1) & (size - 1)
        self.count = np.bincount(self.slots, minlength=size)


def _crc_steps() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(_POLYNOMIAL), x >> 1)
    return x


_STEP = _crc_steps()


def _after_zeros(x: np.ndarray) -> np.ndarray:
    """The CRC register after one more zero byte."""
    return _STEP[x & 0xFF] ^ (x >> 8)


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Per number of zero bytes below LONG_WORD, what each byte of the register becomes; then for LONG_WORD times 1, 2, 4, ..."""
    few = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    few = [np.stack(few)]
    for _ in range(LONG_WORD):
        few.append(_after_zeros(few[-1]))
    many = [few.pop()]
    while len(many) < 32:
        many.append(_applied(many[-1], many[-1]))
    return np.stack(few), many


def _applied(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 0xFF] ^ table[1][(x >> 8) & 0xFF] ^ table[2][(x >> 16) & 0xFF] ^ table[3][x >> 24]


_FEW, _MANY = _shift_tables()


def _shifted(x: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Registers after so many zero bytes each; CRC-32 is linear in its register."""
    low = zeros % LONG_WORD
    x = _FEW[low, 0, x & 0xFF] ^ _FEW[low, 1, (x >> 8) & 0xFF] ^ _FEW[low, 2, (x >> 16) & 0xFF] ^ _FEW[low, 3, x >> 24]
    high = zeros // LONG_WORD
    k = 0
    while high.any():
        on = np.flatnonzero(high & 1)
        x[on] = _applied(_MANY[k], x[on])
        high, k = high >> 1, k + 1
    return x


def word_checksums(words: Words) -> np.ndarray:
    """CRC-32 of every word."""
    crc = np.full(words.count, 0xFFFFFFFF, np.uint32)
    on = np.flatnonzero(words.sizes < LONG_WORD)
    at = 0
    while len(on):
        crc[on] = _STEP[(crc[on] ^ words.data[words.starts[on] + at]) & 0xFF] ^ (crc[on] >> 8)
        at += 1
        on = on[words.sizes[on] > at]
    crc = ~crc
    view = memoryview(words.data)
    for i in np.flatnonzero(words.sizes >= LONG_WORD).tolist():
        crc[i] = zlib.crc32(view[words.starts[i] : words.starts[i] + words.sizes[i]])
    return crc


def run_checksums(words: Words, checksums: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """CRC-32 of runs of words joined by one space, from those of the words."""
    out = checksums[first]
    for k in range(1, int(count.max(initial=1))):
        on = np.flatnonzero(count > k)
        # The register takes a space, then the next word: shifted by its bytes, joined with its checksum.
        so_far = ~_STEP[(~out[on] ^ np.uint32(_SPACE)) & 0xFF] ^ (~out[on] >> 8)
        following = first[on] + k
        out[on] = _shifted(so_far, words.sizes[following]) ^ checksums[following]
    return out


class Runs:
    """All runs of a batch of texts, interned, each distinct one with its bucket."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST_RUN):
        words = Words(data, offsets)
        first, count, sizes = words.runs(longest)
        self.table = RunTable(words, first, sizes)
        self.filled = np.flatnonzero(self.table.holder >= 0)
        kept = self.table.holder[self.filled]
        crc = run_checksums(words, word_checksums(words), first[kept], count[kept])
        self.bucket = np.zeros(len(self.table.holder), np.int64)
        self.bucket[self.filled] = crc % buckets
        self.owners = words.owners[first]
        texts = len(offsets) - 1
        self.n_words = np.bincount(words.owners, minlength=texts)
        self.n_runs = np.bincount(self.owners, minlength=texts)

    def bucket_counts(self, buckets: int) -> np.ndarray:
        # Sums of whole numbers far below 2^53 are exact.
        return np.bincount(self.bucket[self.filled], self.table.count[self.filled], buckets).astype(np.int64)

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """The sum of each text's gains, one per occurrence of a run."""
        gain = gains[self.bucket][self.table.slots]
        return np.bincount(self.owners, gain, len(self.n_words)).astype(np.int64)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> np.ndarray:
    """How many runs of all texts (the only column) fall into each bucket; one row per task and bucket is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, data, offsets in byte_pieces(batches, TABLE_BYTES):
            total += Runs(data, offsets, buckets, longest).bucket_counts(buckets)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(total[on])], names=["bucket", "n"])

    found = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in found:
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the corpus, rounded down."""
    n = len(corpus)
    all_corpus, all_target = float(corpus.sum()) + n, float(target.sum()) + n
    ratios = ((t + 1) * all_corpus / ((s + 1) * all_target) for s, t in zip(map(float, corpus.tolist()), map(float, target.tolist())))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """Noise from the seed and the id, in thousandths, rounded down; a null id counts as empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def numbered(rows: DataFrame, *order) -> DataFrame:
    """Rows with a column rank (1, 2, 3, ...) by the order, without one task that sees all.

    The sorted rows are stored, and each partition counts on from the rows before it. Equal
    rows are told apart by their place in the input, which must be stored.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    tied = stored(tied.orderBy(*order, "_tie").drop("_tie"))
    # Of the id, the lower 33 bits count inside a partition.
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = tied.select("*", F.spark_partition_id().alias("_part"), inside.alias("_inside"))
    sizes = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    # One row per partition.
    found = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _before long"))
    return placed.join(found, "_part").select(*rows.columns, (F.col("_before") + F.col("_inside") + 1).alias("rank"))


def importance_draw(
    docs: DataFrame,
    target: DataFrame,
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    longest: int = LONGEST_RUN,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_features, weight, score and rank.

    target has a text column of the same name. Of the rows with least_words words or more,
    share percent (rounded down) are drawn, those with the largest scores; their rank counts
    from 1, all others' is null. Ties go by doc_id, null ids last, then in no given order.
    Null and empty texts have no features and weigh nothing; repeated rows count each time;
    an empty target or an empty table gives gains of their smoothed shares alone. Equal ids
    have equal noise. Other columns don't matter. A text of any length is read whole.

    The texts are read twice and never shuffled. The driver and every task hold one number
    per bucket; ranks are counted over stored, sorted rows of a few numbers each.
    """
    texts = F.col(text_column).alias("text")
    gains = bucket_gains(bucket_counts(docs.select(texts), buckets, longest), bucket_counts(target.select(texts), buckets, longest))
    names = ("doc_id", "n_words", "n_features", "weight", "score")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in byte_pieces(batches, TABLE_BYTES):
            runs = Runs(data, offsets, buckets, longest)
            weights = runs.weights(gains)
            noise = np.fromiter((gumbel(i, seed) for i in rows.column(0).to_pylist()), np.int64, rows.num_rows)
            columns = [rows.column(0), *(pa.array(x.astype(np.int64)) for x in (runs.n_words, runs.n_runs, weights, weights + noise))]
            yield pa.RecordBatch.from_arrays(columns, names=list(names))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), texts)
    weighed = stored(rows.mapInArrow(weigh, ", ".join(f"{c} long" for c in names)))
    eligible = F.col("n_words") >= least_words
    drawn = share * weighed.filter(eligible).count() // 100
    ranked = numbered(weighed.filter(eligible), F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(weighed.filter(~eligible).withColumn("rank", F.lit(None).cast("long")))
