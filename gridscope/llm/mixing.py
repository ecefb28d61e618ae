"""Mixing sources to target weights with Sainte-Laguë quotas of equal-token blocks.

Blocks are given to sources, and inside a source to its shards, by the highest quotients
weight / (2 * blocks + 1). A shard is a few thousand documents of one source in seeded
order, seen as one stream of words cut into blocks; its quota is met by whole passes over
the stream and one seeded run of neighbouring blocks, so few documents are cut.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridscope.llm.common import WORD, stored

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
BLOCK_WORDS = 16
SHARD_ROWS = 4096
SEED = 42


def sainte_lague(weights: Sequence[float], seats: int, most: Sequence[int] | None = None) -> np.ndarray:
    """Seats of each party by highest quotients weight / (2 * seats + 1), up to most of each.

    The divisor is searched for; the seats it leaves open go one by one. Equal quotients
    go to the earlier party; parties without weight get none.
    """
    w = np.asarray(weights, np.float64)
    room = np.where(w > 0, np.inf if most is None else np.asarray(most, np.float64), 0)
    seats = int(min(seats, room.sum())) if len(w) else 0
    if seats <= 0:
        return np.zeros(len(w), np.int64)
    given = lambda x: np.minimum(np.ceil(w * x - 0.5).clip(0), room)
    low, high = 0.0, 1.0 / w.max()
    while given(high).sum() < seats:
        low, high = high, 2 * high
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        low, high = (middle, high) if given(middle).sum() <= seats else (low, middle)
    out = given(low)
    heap = [(-w[i] / (2 * out[i] + 1), i) for i in range(len(w)) if out[i] < room[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < room[i]:
            heapq.heappush(heap, (-w[i] / (2 * out[i] + 1), i))
    return out.astype(np.int64)


def source_targets(sizes: Sequence[int], weights: Sequence[int] = WEIGHTS, most_passes: int = MOST_PASSES) -> list[float]:
    """Words to take from each source, in order; weights repeat.

    The total stays that of the sizes: a target above most_passes times its source is cut
    to that, and the excess is shared by weight among the others until none is above.
    """
    share = [weights[k % len(weights)] for k in range(len(sizes))]
    most = [most_passes * s for s in sizes]
    rest, weight, targets = sum(sizes), sum(share), [Fraction(0)] * len(sizes)
    # The ones that reach their limit first; each that is cut raises what a weight of one gets.
    order = sorted(range(len(sizes)), key=lambda k: Fraction(most[k], share[k]))
    for at, k in enumerate(order):
        if share[k] * Fraction(rest, weight) <= most[k]:
            for j in order[at:]:
                targets[j] = share[j] * Fraction(rest, weight)
            break
        targets[k] = Fraction(most[k])
        rest, weight = rest - most[k], weight - share[k]
    return [float(t) for t in targets]


def mix(
    docs: DataFrame,
    keep: Sequence[str] = (),
    weights: Sequence[int] = WEIGHTS,
    most_passes: int = MOST_PASSES,
    block_words: int = BLOCK_WORDS,
    shard_rows: int = SHARD_ROWS,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, and segments; and the columns keep.

    segments are the taken stretches of the document as (first, last) word numbers, last
    excluded, whole passes first; taken is their total. Null texts have no words; a null
    source is a source, the last; rows with equal id and text lie side by side in a shard.
    An empty table gives an empty one; texts of any length are counted whole. The names in
    keep must not be those of the result. Only ids and sizes are shuffled, and the columns in keep. The driver sees one row per
    source; shard quotas are computed per source from one row per shard.
    """
    spark = docs.sparkSession
    source, text = F.col(source_column), F.col(text_column)
    order = F.xxhash64(F.lit(seed), F.col(id_column), text)
    base = docs.select(
        F.col(id_column).alias("doc_id"),
        # A key that is never null: sources begin with =.
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("_source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("_order"),
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_keep") if keep else F.lit(None).cast("int").alias("_keep"),
    )
    narrow = stored(base.drop("_keep"))
    found = narrow.groupBy("_source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    # Null last: it alone has the empty key.
    found.sort(key=lambda r: (r["_source"] == "", r["_source"]))
    sizes = [r["size"] for r in found]
    targets = source_targets(sizes, weights, most_passes)
    blocks = sainte_lague(targets, round(sum(sizes) / block_words)).tolist()
    table = [
        (r["_source"], r["size"], t, int(b), -(-r["rows"] // shard_rows)) for r, t, b in zip(found, targets, blocks)
    ]
    plan = spark.createDataFrame(table, "_source string, source_size long, target double, _blocks long, _shards int")
    plan = F.broadcast(plan) if len(table) <= 10_000 else plan

    def sharded(rows: DataFrame) -> DataFrame:
        return rows.join(plan, "_source").withColumn("_shard", F.pmod(F.shiftright("_order", 20), F.col("_shards")).cast("int"))

    shards = sharded(narrow).groupBy("_source", "_shard").agg(F.sum("size").alias("_words"), F.first("_blocks").alias("_blocks"))

    def quotas(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_shard")
        count = -(-rows["_words"] // block_words)
        rows["_count"], rows["_quota"] = count, sainte_lague(rows["_words"].to_numpy(), int(rows["_blocks"].iloc[0]), (most_passes * count).to_numpy())
        return rows[["_source", "_shard", "_words", "_count", "_quota"]]

    shards = shards.groupBy("_source").applyInPandas(quotas, "_source string, _shard int, _words long, _count long, _quota long")
    rows = sharded(base if keep else narrow)
    stream = Window.partitionBy("_source", "_shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.sum("size").over(stream)).withColumn("_start", F.col("_end") - F.col("size"))
    rows = rows.join(shards, ["_source", "_shard"])
    count, quota = F.greatest("_count", F.lit(1)), F.col("_quota")
    passes, run = F.floor(quota / count), quota % count
    first = F.pmod(F.xxhash64(F.lit(seed), "_source", "_shard"), count)
    rows = rows.withColumns({"_passes": passes.cast("int"), "_a": first * block_words, "_b": (first + run) * block_words})

    def overlap(a, b):
        a, b = F.greatest(a, "_start") - F.col("_start"), F.least(b, "_end") - F.col("_start")
        return F.struct(a.alias("first"), b.alias("last"))

    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("first"), F.col("size").alias("last")), F.col("_passes"))
    # The run goes on at the start of the stream where it reaches the end.
    run_parts = F.array(overlap(F.col("_a"), F.least("_b", "_words")), overlap(F.lit(0).cast("long"), F.col("_b") - count * block_words))
    segments = F.filter(F.concat(whole, run_parts), lambda s: s["last"] > s["first"])
    rows = rows.withColumn("segments", segments)
    taken = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "segments", *(F.col(f"_keep.`{c}`").alias(c) for c in keep if c != "doc_id"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents with the same columns: one row per segment.

    A whole pass gives the row unchanged; a stretch gives its words with the white space
    between them, and n_chars, if there is such a column, counts the new text. Whatever other
    names docs has, their values come back as they were. Rows without words, null texts
    among them, have no segments and go; repeated rows are taken like others; an empty table
    gives an empty one.
    """
    whole_row = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = mix(whole_row, keep=["row"], **settings).select("row", "size", F.explode("segments").alias("part"))
    text = F.col("row.text")
    words = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    some = F.array_join(F.slice(words, (F.col("part.first") + 1).cast("int"), (F.col("part.last") - F.col("part.first")).cast("int")), "")
    whole = (F.col("part.first") == 0) & (F.col("part.last") == F.col("size"))
    rows = rows.select("row", whole.alias("whole"), F.when(~whole, some).alias("some"))
    row = F.col("row").withField("text", F.coalesce("some", text))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.char_length("some")).cast(docs.schema["n_chars"].dataType))
    return rows.select(row.alias("row")).select("row.*")
