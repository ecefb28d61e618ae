"""SimHash fingerprints of word shingles, linked through tables of pivot distances.

The Hamming distance of two fingerprints is at least the largest difference between their
distances to any third fingerprint. Each distinct fingerprint gets its distances to fixed
pivots once. Pairs meet where two of five bit fields agree (three changed bits leave two of
five fields whole, so none is lost) and the first pivot distances lie in neighbouring cells;
the other pivot distances discard most of them, and a bit count verifies the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscope.llm.common import WORD, lower_ascii, pieces, records, stored, texts_of

SEED = 42
BITS = 64
#: Widths of the bit fields that pairs meet by: distance + 2 fields.
MOST_BITS = 3
PIVOTS = 8
#: Width of a cell of first pivot distances; partners lie in the same or a neighbouring one.
CELL = MOST_BITS + 1


def _remixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Other hashes of the same shingles; number 0 leaves them as they are."""
    if not number:
        return hashes
    x = hashes ^ np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fingerprint(words: list[str], width: int = 3, prints: int = 1) -> list[int]:
    """The fingerprints of a text from its words, repeats included; zeros without words.

    The first one takes the shingles' hashes as they are, the others mix them further.
    """
    if not words:
        return [0] * prints
    joined = " ".join(words).encode()
    at = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(at + 1).tolist()], [*at.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]
    counts = np.zeros((prints, BITS), np.int64)
    for k in range(0, len(hashes), 65_536):
        some = np.array(hashes[k : k + 65_536], dtype="<u8")
        for number in range(prints):
            own = _remixed(some, number)
            counts[number] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def row_key() -> Column:
    """A hash of a row's id and text, equal for equal rows."""
    return F.xxhash64("doc_id", "text")


def fingerprints(docs: DataFrame, width: int = 3, prints: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, row_key and prints (array of long, the same 64 bits) of each row.

    The text is read whole; null texts have no words; A-Z count as a-z.
    """
    kinds = {"doc_id": pa.int64(), "row_key": pa.int64(), "prints": pa.list_(pa.int64())}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        find = re.compile(WORD).findall
        for some in pieces(batches):
            found = np.array([fingerprint(find(text), width, prints) for *_, text in some], np.uint64)
            yield records(kinds, [[r[0] for r in some], [r[1] for r in some], list(found.view(np.int64))])

    rows = texts_of(docs, id_column, text_column).select("doc_id", row_key().alias("row_key"), lower_ascii(F.col("text")).alias("text"))
    return rows.mapInArrow(sign, "doc_id long, row_key long, prints array<long>")


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints, as signed longs: the hash of 0, 1, 2, ..."""
    return [xxhash.xxh64_intdigest(str(k), SEED) - (1 << 63) for k in range(count)]


def _fields(fields: int) -> list[tuple[int, int]]:
    """(first bit, width) of even bit fields."""
    ends = [BITS * k // fields for k in range(fields + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def linked_pairs(prints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Pairs (number, a, b) of distinct fingerprints at most_bits or fewer.

    prints: distinct (number, fingerprint); only fingerprints of the same number are
    compared. Every pair is found, maybe more than once. Shuffled: 10 rows per fingerprint
    on one side and 20 on the other, each with its pivot distances in one long; no bucket is
    listed pair by pair before the distances are compared, and the join's skewed keys may
    be split.
    """
    value = F.col("fingerprint")
    distances = [F.bit_count(value.bitwiseXOR(F.lit(p))).cast("long") for p in pivots()]
    table = distances[0]
    for k, distance in enumerate(distances[1:], 1):
        table = table.bitwiseOR(F.shiftleft(distance, 8 * k))
    twos = list(combinations(_fields(most_bits + 2), 2))
    keys = []
    for k, two in enumerate(twos):
        mask = sum(((1 << width) - 1) << first for first, width in two)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct((F.col("number") * len(twos) + k).cast("int").alias("pair"), value.bitwiseAND(F.lit(mask)).alias("bits")))
    met = prints.select("number", value, table.alias("table")).select("*", F.explode(F.array(*keys)).alias("key"))
    met = met.withColumn("cell", F.floor(F.col("table").bitwiseAND(255) / (most_bits + 1)).cast("int"))
    right = met.select("key.pair", "key.bits", "cell", "fingerprint", "table")
    near = F.explode(F.array(F.col("cell"), F.col("cell") + 1)).alias("near")
    left = met.select("number", "key.pair", "key.bits", near, "cell", "fingerprint", "table")
    a, b = left.alias("a"), right.alias("b")
    entry = lambda side, k: F.shiftright(f"{side}.table", 8 * k).bitwiseAND(255)
    joined = a.join(
        b,
        (F.col("a.pair") == F.col("b.pair"))
        & (F.col("a.bits") == F.col("b.bits"))
        & (F.col("a.near") == F.col("b.cell"))
        # Within a cell each pair once; across cells the lower one looks up.
        & ((F.col("a.cell") != F.col("b.cell")) | (F.col("a.fingerprint") < F.col("b.fingerprint")))
        & (F.greatest(*(F.abs(entry("a", k) - entry("b", k)) for k in range(PIVOTS))) <= most_bits)
        & (F.bit_count(F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint"))) <= most_bits),
    )
    return joined.select("number", F.col("a.fingerprint").alias("a"), F.col("b.fingerprint").alias("b"))


def are_stars(links: DataFrame) -> bool:
    """Whether each node with links (a, b), a > b, has either one link down or only links up."""
    end = lambda node, down, up: F.struct(F.col(node).alias("node"), F.lit(down).alias("down"), F.lit(up).alias("up"))
    sides = links.select(F.explode(F.array(end("a", 1, 0), end("b", 0, 1))).alias("end")).groupBy("end.node").agg(F.sum("end.down").alias("down"), F.max("end.up").alias("up"))
    return not sides.agg(F.max((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over links (a, b), for nodes with a link.

    Rounds of two steps: neighbours above a node point to the smallest one near it, then the
    node and its lower neighbours do. Grouped minima and equal joins only. Each round is stored,
    so the lineage stays short; the number of rounds grows with the logarithm of the longest
    chain. Stars are the end, which a look at the links' ends tells without a further round.
    """
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    while not are_stars(now):
        up = now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        both = now.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("link")).select("link.*")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # At most a row per link, repeats included.
        large = up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small step: each node's links go down only.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        now = stored(large.join(least, "a").select(down.alias("link")).select("link.*").filter("a != b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, row_key, fingerprint (long) and component_id of each row.

    Rows with equal fingerprints are one class, whose smallest doc_id stands for it; only
    classes are linked, so copies are never paired. component_id is the smallest doc_id
    reachable; where a class has only null ids, it is null. Without near classes it is the
    class's own smallest doc_id.
    """
    rows = stored(fingerprints(docs, width).select("doc_id", "row_key", F.col("prints")[0].alias("fingerprint")))
    classes = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    roots = components(linked_pairs(classes.select(F.lit(0).alias("number"), "fingerprint"), most_bits))
    # Components are of fingerprints; the smallest doc_id of each then names it.
    named = with_roots(roots).join(classes, F.col("node") == F.col("fingerprint"))
    best = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    far = named.join(best, "root").select("fingerprint", "component_id")
    final = classes.join(far, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "first_id").alias("component_id"))
    return rows.join(final, "fingerprint", "left").select("doc_id", "row_key", "fingerprint", "component_id")


def with_roots(found: DataFrame) -> DataFrame:
    """The nodes of components, their roots included."""
    return found.union(found.select(F.col("root").alias("node"), "root")).distinct()
