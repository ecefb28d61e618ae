"""Near-duplicate texts: five-word shingles with a Jaccard overlap of 0.8 or more.

At that overlap about 39 of 256 fingerprint bits differ, so no bit fields find the pairs. Tables
of pivots, which are reference fingerprints, do: a text's distance to a pivot is measured by the
votes behind its bits, so bits that are nearly even hardly count, and texts meet where the same
pivots of a table are the ones they tell most about. What meets is told apart by numbers alone,
before any text moves: by SimHash fingerprints of 256 bits (pivot distance tables discard pairs
by their largest difference, then the bits are counted) and by parities of the shingles, whose
differing bits are never more than the shingles that only one text has. The exact overlap
verifies what is left.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscope.llm.common import WORD, lower_ascii, pieces, records, stored, wrapped
from gridscope.llm.simhash import SEED, components, with_roots

#: Words of a shingle and the least Jaccard overlap of texts that are near duplicates.
WIDTH, LEAST_OVERLAP = 5, 0.8
#: Texts meet if in a table the same STRONGEST of its pivots are nearest or farthest: TABLES
#: tables, at an overlap of 0.8 each finds about 1 pair in 17, other texts 1 in 22 million.
TABLES, TABLE_PIVOTS, STRONGEST = 110, 256, 3
#: Texts that are compared with all pivots at once.
AT_ONCE = 32
#: 64-bit words of a fingerprint, and bits that near duplicates may differ in: at an overlap of
#: 0.8 it is 39 on average with a deviation of 6. Few shingles deviate more, so below MOST_FEW of
#: both texts only parities count.
PRINTS, MOST_BITS, MOST_FEW = 4, 66, 160
PIVOTS = 8
#: 64-bit words of the parities.
PARITIES = 8
#: Texts of a bucket in one block; larger buckets are compared block by block.
BLOCK = 4096


def shingles(words: list[str], width: int = WIDTH) -> set[bytes]:
    """The distinct runs of width words; a shorter text is one run."""
    if not words:
        return set()
    joined = " ".join(words).encode()
    at = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(at + 1).tolist()], [*at.tolist(), len(joined)]
    return {joined[a:b] for a, b in zip(starts, ends[width - 1 :])} or {joined}


def overlap(a: set[bytes], b: set[bytes]) -> float:
    """Jaccard overlap; texts without words are equal."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


#: C(k, j) for j from 1.
_CHOOSE = [np.array([math.comb(k, j) for k in range(TABLE_PIVOTS)]) for j in range(1, STRONGEST + 1)]


def reference_fingerprints() -> np.ndarray:
    """The pivots of all tables, one per column, as 1 and -1 for the bits of a fingerprint."""
    bits = np.random.default_rng(SEED).integers(0, 2, (64 * PRINTS, TABLES * TABLE_PIVOTS), np.int8)
    return (2 * bits - 1).astype(np.float32)


def cells(votes: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Per text (row of votes, one per bit) and table: the strongest pivots, whether near or far,
    and the table, in one number of 32 bits.

    All sums are whole numbers that the floats hold exactly, so cells don't depend on the batch.
    """
    out = np.empty((len(votes), TABLES), np.int32)
    for k in range(0, len(votes), AT_ONCE):
        some = votes[k : k + AT_ONCE]
        exact = np.float32 if np.abs(some).sum(axis=1).max() < 1 << 24 else np.float64
        nearness = (some.astype(exact) @ pivots.astype(exact, copy=False)).reshape(len(some), TABLES, TABLE_PIVOTS)
        strongest = np.argpartition(-np.abs(nearness), STRONGEST - 1, axis=2)[:, :, :STRONGEST]
        strongest.sort(axis=2)
        far = np.take_along_axis(nearness, strongest, 2) < 0
        # Sets of pivots are numbered by binomials: number = C(first, 1) + C(second, 2) + C(third, 3).
        number = np.zeros((len(some), TABLES), np.int64) + np.arange(TABLES) * math.comb(TABLE_PIVOTS, STRONGEST)
        for j in range(STRONGEST):
            number += _CHOOSE[j][strongest[:, :, j]]
        for j in range(STRONGEST):
            number = 2 * number + far[:, :, j]
        out[k : k + AT_ONCE] = number - (1 << 31)
    return out


class Signer:
    """Votes, fingerprint and parities of the shingles' hashes."""

    def __init__(self) -> None:
        self.mixers = np.random.default_rng(SEED).integers(0, 1 << 63, PRINTS, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, found: set[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(x, SEED) for x in found), np.uint64, len(found))
        counts = np.zeros((PRINTS, 64), np.int64)
        for k in range(0, len(hashes), 2048):
            some = hashes[k : k + 2048]
            for number, mixer in enumerate(self.mixers):
                mixed = (some ^ (some >> np.uint64(31))) * mixer
                mixed ^= mixed >> np.uint64(29)
                counts[number] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        votes = 2 * counts - len(hashes)
        prints = np.packbits(votes > 0, axis=1, bitorder="little").view(np.int64)[:, 0]
        odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES) & 1
        return votes.reshape(-1), prints, np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


_KINDS = {
    "key_1": pa.int64(), "key_2": pa.int64(), "doc_id": pa.int64(), "words_1": pa.int64(), "words_2": pa.int64(), "n": pa.int64(),
    "cells": pa.list_(pa.int32()), "prints": pa.list_(pa.int64()), "parities": pa.list_(pa.int64()),
}


def signed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: key_1 and key_2 (hashes of the row), doc_id, words_1 and words_2 (a 128-bit hash
    of its words), n (shingles), cells, prints and parities."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The pivots go with the task: workers live on, and their memory with them.
        find, signer, references = re.compile(WORD).findall, Signer(), reference_fingerprints()
        for some in pieces(batches):
            out, votes = [], []
            for *keys, text in some:
                words = find(text)
                whole = np.frombuffer(xxhash.xxh3_128_digest(" ".join(words).encode()), np.int64)
                found = shingles(words)
                own, prints, parities = signer(found)
                votes.append(own)
                out.append((*keys, *whole.tolist(), len(found), prints, parities))
            *first, prints, parities = zip(*out)
            yield records(_KINDS, [*first, list(cells(np.array(votes), references)), prints, parities])

    text = lower_ascii(F.col(f"row.`{text_column}`")).alias("text")
    rows = wrapped(docs).select("key_1", "key_2", F.col(f"row.`{id_column}`").cast("long").alias("doc_id"), text)
    kinds = "key_1 long, key_2 long, doc_id long, words_1 long, words_2 long, n long, cells array<int>, prints array<long>, parities array<long>"
    return rows.mapInArrow(sign, kinds)


def pivot_table(prints: Column) -> Column:
    """The distances to fixed reference fingerprints, eight bits each, in one long."""
    out = F.lit(0).cast("long")
    for k in range(PIVOTS):
        reference = [xxhash.xxh64_intdigest(f"{k} {j}", SEED) - (1 << 63) for j in range(PRINTS)]
        distance = sum((F.bit_count(prints[j].bitwiseXOR(F.lit(reference[j]))) for j in range(1, PRINTS)), F.bit_count(prints[0].bitwiseXOR(F.lit(reference[0]))))
        out = out.bitwiseOR(F.shiftleft(F.least(distance, F.lit(255)).cast("long"), 8 * k))
    return out


def sketches(classes: DataFrame) -> DataFrame:
    """node, n, pivots, prints and parities: what pairs are told apart by."""
    return classes.select("node", "n", pivot_table(F.col("prints")).alias("pivots"), "prints", "parities")


def may_overlap(a: str, b: str, least: float) -> Column:
    """Whether the sketches of two sides leave room for an overlap of least or more.

    Sizes and parities lose no pair: with d shingles in only one of the texts, at most d
    parities differ. Fingerprints and their pivot distances lose next to none.
    """
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    differing = lambda column, words: sum((F.bit_count(F.col(f"{a}.{column}")[j].bitwiseXOR(F.col(f"{b}.{column}")[j])) for j in range(1, words)), F.bit_count(F.col(f"{a}.{column}")[0].bitwiseXOR(F.col(f"{b}.{column}")[0])))
    entry = lambda side, k: F.shiftrightunsigned(f"{side}.pivots", 8 * k).bitwiseAND(255)
    apart = F.greatest(*(F.abs(entry(a, k) - entry(b, k)) for k in range(PIVOTS)))
    few = n_a + n_b < MOST_FEW
    return (
        (F.least(n_a, n_b) >= least * F.greatest(n_a, n_b) - 1e-6)
        & (few | (apart <= MOST_BITS))
        & (differing("parities", PARITIES) * (1 + least) <= (n_a + n_b) * (1 - least) + 1e-6)
        & (few | (differing("prints", PRINTS) <= MOST_BITS))
    )


def overlapping(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text) overlap by least or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORD).findall
        for some in pieces(batches):
            near = [overlap(shingles(find(first)), shingles(find(second))) >= least for _, _, first, second in some]
            yield records({"a": pa.int64(), "b": pa.int64()}, [[r[k] for r, n in zip(some, near) if n] for k in (0, 1)])

    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
    pairs = pairs.select("a", "b", F.coalesce("text_a", F.lit("")), F.coalesce("text_b", F.lit("")))
    return pairs.mapInArrow(check, "a long, b long")


def apart_pairs(rooted: DataFrame, sketch: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Distinct pairs (a, b) that share a bucket of rooted (key, node, root), have different roots
    and may overlap, of buckets of more than two nodes: those of two are compared already.

    Only buckets with two roots or more are looked at; those of more than `block` nodes are
    dealt out in pairs of blocks.
    """
    live = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
    live = live.filter("low != high AND size > 2").select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = stored(rooted.join(live, "key").join(sketch, "node").withColumn("own", own))
    left = dealt.withColumn("other", F.explode(F.sequence("own", F.col("blocks") - 1)))
    right = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), "own")))
    met = left.alias("x").join(
        right.alias("y"),
        (F.col("x.key") == F.col("y.key"))
        & (F.col("x.own") == F.col("y.other"))
        & (F.col("x.other") == F.col("y.own"))
        & (F.col("x.root") != F.col("y.root"))
        # Inside a block each pair once.
        & ((F.col("x.own") != F.col("y.own")) | (F.col("x.node") < F.col("y.node")))
        & may_overlap("x", "y", least),
    )
    first, second = F.col("x.node"), F.col("y.node")
    return met.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b")).distinct()


def similar_roots(met: DataFrame, sketch: DataFrame, texts_of_nodes: Callable[[DataFrame], DataFrame], least: float = LEAST_OVERLAP) -> DataFrame:
    """(node, root) of all nodes of sketch, over links that join all nodes meeting in a bucket
    (key, node) at least or more: the smallest node reachable.

    texts_of_nodes gives (node, text) for a table of nodes; only texts of pairs that the
    sketches leave are asked for.

    Nodes are compared with the smallest of their buckets, by sketches that are in the buckets'
    rows, so no row is made per pair that these tell apart. The texts are compared first with the
    one that shares most buckets, then with those that this leaves in other components: a group of
    near copies costs a pair per node, not per bucket. Nodes of a bucket that are still apart have
    their sketches compared, and the pairs that these leave are verified.
    """
    own = F.struct("node", "n", "pivots", "prints", "parities")
    low = met.groupBy("key").agg(F.min("node").alias("node")).join(sketch, "node").select("key", own.alias("at_b"))
    near = met.join(sketch, "node").select("key", own.alias("at_a")).join(low, "key").filter((F.col("at_a.node") != F.col("at_b.node")) & may_overlap("at_a", "at_b", least))
    to_low = stored(near.groupBy(F.col("at_a.node").alias("a"), F.col("at_b.node").alias("b")).agg(F.count(F.lit(1)).alias("shared")))
    most = to_low.groupBy("a").agg(F.max(F.struct("shared", (-F.col("b")).alias("b"))).alias("most")).select("a", (-F.col("most.b")).alias("b"))
    links = stored(overlapping(most, texts_of_nodes(either(most)), least))
    root, others = roots_of(sketch.select("node"), links), to_low.select("a", "b")
    for side in ("a", "b"):
        others = others.join(root.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side)
    # The first pairs are linked already, or not near.
    others = stored(others.filter("root_a != root_b").select("a", "b").join(most, ["a", "b"], "left_anti"))
    root = with_links(root, stored(overlapping(others, texts_of_nodes(either(others)), least)))
    rooted = stored(met.join(root, "node").select("key", "node", "root"))
    further = stored(apart_pairs(rooted, sketch, least).join(to_low.select("a", "b"), ["a", "b"], "left_anti"))
    if further.isEmpty():
        return root
    return with_links(root, stored(overlapping(further, texts_of_nodes(either(further)), least)))


def roots_of(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of all nodes: the smallest node reachable over links, itself without any."""
    member = with_roots(components(links))
    return stored(nodes.join(member, "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def with_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The (node, root) of all nodes when links (a, b) are added: only the roots they join are looked at again."""
    if links.isEmpty():
        return roots
    for side in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side)
    joined = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    joined = joined.select(F.col("node").alias("root"), F.col("root").alias("lower"))
    return stored(roots.join(joined, "root", "left").select("node", F.coalesce("lower", "root").alias("root")))


def either(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs (a, b)."""
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def without_similar(docs: DataFrame, least: float = LEAST_OVERLAP, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each component of similar texts, unchanged: the one with the smallest doc_id.

    Texts are similar if their distinct five-word shingles have a Jaccard overlap of least or
    more; shorter texts are one shingle, null and empty texts are equal and similar to nothing
    else. A-Z count as a-z. Rows with the same words are one class, told by 128 bits of hash.
    Null ids come last; of rows with equal ids one stays, by a hash of all its columns, and
    rows equal in all columns are one. Whatever names docs has, its columns come back as they
    were; an empty table gives an empty one.
    """
    rows = stored(signed(docs, id_column, text_column))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key_1", "key_2", "n", "cells", "prints", "parities")
    classes = stored(rows.groupBy("words_1", "words_2").agg(F.min(first).alias("first")))
    # The classes are stored, so a class keeps its number.
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "first")
    # A cell's number holds its table's, so tables meet only their like.
    met = classes.select("node", F.explode("first.cells").alias("key"))
    shared = met.groupBy("key").count().filter("count > 1").select("key")
    met = stored(met.join(shared, "key"))
    wanted = met.select("node").distinct()
    own = stored(classes.select("node", "first.key_1", "first.key_2", "first.n", "first.prints", "first.parities").join(wanted, "node"))
    text = lower_ascii(F.col(f"row.`{text_column}`")).alias("text")

    def texts_of_nodes(nodes: DataFrame) -> DataFrame:
        texts = wrapped(docs).select("key_1", "key_2", text).join(own.select("node", "key_1", "key_2").join(nodes, "node"), ["key_1", "key_2"])
        # Equal rows have one text.
        return stored(texts.select("node", "text").dropDuplicates(["node"]))

    member = similar_roots(met, stored(sketches(own)), texts_of_nodes, least)
    found = classes.select("node", "first.no_id", "first.doc_id", "first.key_1", "first.key_2").join(member, "node", "left")
    stays = found.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("no_id", "doc_id", "key_1", "key_2")).alias("first"))
    stays = stays.select("first.key_1", "first.key_2")
    # Rows with equal keys are equal; the rows are dealt by their keys once for both steps.
    return wrapped(docs).join(stays, ["key_1", "key_2"], "left_semi").dropDuplicates(["key_1", "key_2"]).select("row.*")
