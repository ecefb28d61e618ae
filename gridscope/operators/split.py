"""Exact, repeatable train/test split, by class where that is possible."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridscope.functions.columns import grouping_key, quoted
from gridscope.functions.tables import pin, stored


class SplitError(ValueError):
    """The rows cannot be split as asked."""


@dataclass(frozen=True)
class SplitPlan:
    """What is known about a split before any row is assigned."""

    row_count: int
    test_count: int
    class_count: int
    stratified: bool

    @property
    def train_count(self) -> int:
        return self.row_count - self.test_count


def test_row_count(row_count: int, test_size: float | int) -> int:
    return math.ceil(row_count * test_size) if isinstance(test_size, float) else int(test_size)


def can_stratify(classes: int, smallest: int, rows: int, test_rows: int) -> bool:
    return classes >= 2 and smallest >= 2 and test_rows >= classes and rows - test_rows >= classes


def plan_split(
    df: DataFrame, label: str | None, test_size: float | int = 0.2, stratify: bool = True
) -> SplitPlan:
    """Sizes of a split, from one grouped count of the label."""
    key = F.lit(0) if label is None else F.col(quoted(label))
    groups = df.groupBy(key.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    row = groups.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest")
    ).first()
    rows = row["rows"] or 0
    if rows < 2:
        raise SplitError("a split needs at least 2 rows")
    test_rows = test_row_count(rows, test_size)
    if not 0 < test_rows < rows:
        raise SplitError(f"a test set of {test_rows} of {rows} rows leaves one side empty")
    stratified = (
        stratify
        and label is not None
        and can_stratify(row["classes"], row["smallest"], rows, test_rows)
    )
    return SplitPlan(rows, test_rows, row["classes"], stratified)


def class_quotas(groups: DataFrame, plan: SplitPlan) -> DataFrame:
    """Test rows per class: proportional, rounded by largest remainder.

    Ties go to the smaller label. `groups` has one row per class (label, n).
    """
    product = F.col("n").cast("decimal(20,0)") * F.lit(plan.test_count).cast("decimal(18,0)")
    total = F.lit(plan.row_count).cast("decimal(18,0)")
    shares = groups.select(
        "label",
        "n",
        F.floor(product / total).cast("bigint").alias("whole"),
        (product % total).alias("rest"),
    )
    left_over = plan.test_count - shares.agg(F.sum("whole")).first()[0]
    extra = shares.orderBy(F.desc("rest"), "label").limit(left_over)
    extra = extra.select(F.col("label").alias("e_label"), F.lit(1).alias("one"))
    return shares.join(extra, F.col("label").eqNullSafe(F.col("e_label")), "left").select(
        "label",
        "n",
        (F.col("whole") + F.coalesce(F.col("one"), F.lit(0))).alias("quota"),
    )


def row_hash(key: Sequence[Column], seed: int) -> Column:
    """A fixed pseudo-random order of the rows: MD5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in key]))


def bucket_digits(row_count: int) -> int:
    """Hex digits so that buckets per class and rows per bucket are both near sqrt(n)."""
    return max(1, min(7, round(math.log2(max(row_count, 2)) / 8)))


def split_train_test(
    df: DataFrame,
    label: str | None = None,
    key: Sequence[str] | None = None,
    test_size: float | int = 0.2,
    seed: int = 42,
    stratify: bool = True,
    plan: SplitPlan | None = None,
    column: str = "split",
) -> DataFrame:
    """The rows with a column telling test from train; test sizes are exact, in total and per class.

    The test rows of a class are the first ones by MD5 of seed and key. Ranking all
    rows would put a whole class into one task. Instead rows are counted per hash
    prefix, a running sum of those counts finds the one prefix where a class fills
    its quota, and only hashes with that prefix are counted one by one. That gives
    the last test hash per class, and the table itself is then read once, unshuffled.

    Without a key all columns are hashed. Rows that share the cut hash are told apart
    by their content; rows equal in every column are interchangeable.
    """
    plan = plan or plan_split(df, label, test_size, stratify)
    parts = [F.col(quoted(name)) for name in key] if key else _texts(df, df.columns)
    group = F.col(quoted(label)) if plan.stratified else F.lit(0)
    hashed = df.withColumns({"__class": group, "__hash": row_hash(parts, seed)}).withColumn(
        "__bucket", F.substring("__hash", 1, bucket_digits(plan.row_count))
    )

    # One row per class and hash prefix, then one row per class.
    buckets = hashed.groupBy(F.col("__class").alias("label"), F.col("__bucket").alias("part")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    # A row per class is broadcast if there are few; else it is found by class and prefix,
    # a key of which no value holds more than about the root of a class's rows.
    few_classes = plan.class_count <= BROADCAST_CLASSES or not plan.stratified
    settle = pin if few_classes else stored
    buckets = stored(buckets)
    classes = buckets.groupBy("label").agg(F.sum("rows").alias("n"))
    if plan.stratified:
        quotas = class_quotas(classes, plan)
    else:
        quotas = classes.withColumn("quota", F.lit(plan.test_count).cast("bigint"))
    edges = settle(_crossing(buckets, quotas))

    # Inside that prefix, the hash where the quota is filled: again one row per class.
    at_edge = (F.col("__bucket") == F.col("part")) & F.col("__class").eqNullSafe(F.col("label"))
    near = (
        hashed.select("__class", "__bucket", "__hash")
        .join(F.broadcast(edges) if few_classes else edges, at_edge)
        .groupBy("label", F.col("__hash").alias("part"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    cuts = _crossing(near, edges.select("label", F.col("missing").alias("quota")))
    cuts = settle(
        cuts.select(F.col("label").alias("__label"), F.col("part").alias("__cut"), "missing", "rows")
    )
    same = F.col("__class").eqNullSafe(F.col("__label"))
    if few_classes:
        placed = hashed.join(F.broadcast(cuts), same, "left")
    else:
        cut_of = buckets.select("label", "part").join(cuts, F.col("label").eqNullSafe(F.col("__label")), "left")
        at_bucket = F.col("__class").eqNullSafe(F.col("label")) & (F.col("__bucket") == F.col("part"))
        placed = hashed.join(cut_of, at_bucket, "left").drop("label", "part")
    columns = [F.col(quoted(name)) for name in df.columns]
    # A class with a quota of 0 has no cut: all its rows are for training.
    split = F.when(F.col("__hash") <= F.col("__cut"), "test").otherwise("train").alias(column)
    if not cuts.where(F.col("missing") < F.col("rows")).take(1):
        return placed.select(*columns, split)

    # Several rows share a cut hash and only some of them are for testing: their
    # content decides, by the same search for the part where the quota is filled.
    content = F.sha2(F.concat_ws("|", *_texts(df, df.columns)), 256)
    at_cut = F.coalesce(F.col("__hash") == F.col("__cut"), F.lit(False))
    tied = placed.where(at_cut).withColumn("__content", content)
    contents = tied.groupBy(F.col("__label").alias("label"), F.col("__content").alias("part")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    last = _crossing(
        contents, cuts.select(F.col("__label").alias("label"), F.col("missing").alias("quota"))
    ).select("label", F.col("part").alias("__last"), F.col("missing").alias("__wanted"))
    last = settle(last)
    decided = tied.join(F.broadcast(last) if few_classes else last, F.col("__label").eqNullSafe(F.col("label")))
    before = F.when(F.col("__content") < F.col("__last"), "test").otherwise("train").alias(column)
    return (
        placed.where(~at_cut)
        .select(*columns, split)
        .unionByName(decided.where(F.col("__content") != F.col("__last")).select(*columns, before))
        .unionByName(
            _divided_copies(decided.where(F.col("__content") == F.col("__last")), columns, column)
        )
    )


def _texts(df: DataFrame, names: Sequence[str]) -> list[Column]:
    """Short texts that tell rows apart, null included."""
    types = {name: field.dataType for name, field in zip(df.columns, df.schema)}
    return [
        F.coalesce(grouping_key(F.col(quoted(name)), types[name]).cast("string"), F.lit("\u0000"))
        for name in names
    ]


COPIES_PER_PIECE = 100_000


def _divided_copies(copies: DataFrame, columns: list[Column], column: str) -> DataFrame:
    """Equal rows, `__wanted` of them for testing.

    Copies are counted and made again, so a row that fills a third of the table
    never meets itself in one task: counts merge before the shuffle, and pieces of
    limited size are spread before they are unfolded.
    """
    names = [f"c{i}" for i in range(len(columns))]
    counted = copies.groupBy(
        "__label", "__wanted", *[c.alias(n) for c, n in zip(columns, names)]
    ).agg(F.count(F.lit(1)).alias("n"))
    sides = counted.select(
        *names,
        F.inline(
            F.array(
                F.struct(F.lit("test").alias("side"), F.col("__wanted").alias("n")),
                F.struct(F.lit("train").alias("side"), (F.col("n") - F.col("__wanted")).alias("n")),
            )
        ),
    ).where("n > 0")
    pieces = sides.withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES_PER_PIECE)))
    ).repartition(int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = F.least(F.lit(COPIES_PER_PIECE), F.col("n") - F.col("piece") * COPIES_PER_PIECE)
    rows = pieces.select(*names, "side", F.explode(F.sequence(F.lit(1), size.cast("int"))).alias("copy"))
    originals = copies.select(*columns).columns
    return rows.select(
        *[F.col(n).alias(original) for n, original in zip(names, originals)],
        F.col("side").alias(column),
    )


def numbered_copies(df: DataFrame, column: str) -> DataFrame:
    """The rows with a column that numbers equal ones from 1, whatever the partitions.

    Equal rows are counted and made again in pieces of limited size, as at the cut.
    """
    counted = df.groupBy(*[F.col(quoted(name)) for name in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    pieces = counted.withColumn(
        "__piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / COPIES_PER_PIECE)))
    ).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = F.col("__piece") * COPIES_PER_PIECE
    numbers = F.sequence(first + 1, F.least(F.col("__n"), first + COPIES_PER_PIECE))
    return pieces.select(*[F.col(quoted(name)) for name in df.columns], F.explode(numbers).alias(column))


# Up to this many classes their edges and cuts, a short row each, are broadcast.
BROADCAST_CLASSES = 100_000


def _crossing(parts: DataFrame, quotas: DataFrame) -> DataFrame:
    """Per label, the part in which the running row count reaches the quota.

    `missing` rows of that part are still needed. Parts are ordered by value.
    """
    through = F.sum("rows").over(W.partitionBy("label").orderBy("part"))
    wanted = quotas.select(F.col("label").alias("q_label"), "quota")
    before = F.col("through") - F.col("rows")
    return (
        parts.withColumn("through", through)
        .join(wanted, F.col("label").eqNullSafe(F.col("q_label")))
        .where((F.col("through") >= F.col("quota")) & (before < F.col("quota")))
        .select("label", "part", "rows", (F.col("quota") - before).alias("missing"))
    )
