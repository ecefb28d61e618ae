"""Random forests by histograms: every tree draws its rows from all rows that are learned.

Features are binned once, by cuts of all rows. Rows of equal codes and labels are counted as one
from then on: of n of them, a tree with Poisson weights draws Poisson(n). What is left, at most one
row per combination of bins and label, is a block that tasks grow a few trees from each, level by
level over all nodes at once. Of more than a block, the upper nodes are split by sums over all blocks
until the cells of a node are no more than one. Trees are rows of a Parquet table that is saved with the model, so
the driver never holds them. Rows are predicted once per combination of bins.
"""

from __future__ import annotations

import json
import math
import weakref
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.functions.tables import remove_folder, scratch_folder
from gridscope.operators.boosting import SUM_BITS, Bins, Scale, _find_package, feature_bins

#: Bins of a number, as many as Spark's forests have unless told otherwise.
BINS = 32
#: Merged rows of a block, and cells of a node that one task grows on.
BLOCK_ROWS = 1 << 21
#: Trees that a task grows.
TASK_TREES = 10
#: Scores of a block of cells that are predicted together.
BLOCK_SCORES = 1 << 20
#: Slots up to which a node's are drawn by sorting all of them.
FEW_SLOTS = 64
#: Scores are whole multiples of this part of their span, so their sums have one value.
FINEST = 2.0**-30


@dataclass(frozen=True)
class ForestSettings:
    """What a forest is grown by. classes: 0 for numbers, else the number of classes."""

    classes: int
    trees: int = 100
    depth: int | None = None
    least_rows: int = 1
    # Features that a node looks at: "all", or "sqrt" of them. Each category value is a feature.
    subset: str = "all"
    seed: int = 0
    # Per class what a row weighs, where it isn't 1.
    weights: list[float] = field(default_factory=list)


@dataclass(frozen=True)
class Grown:
    """A tree. Nodes are numbered by level; the k-th that is split has the children 2k + 1 and 2k + 2.

    feature: -1 for a leaf. cut: of nodes that are split, the last code that goes left, or of a
    category the only one. values: a row per leaf.
    """

    feature: np.ndarray
    cut: np.ndarray
    values: np.ndarray

    def leaves(self, codes: np.ndarray, category: np.ndarray) -> np.ndarray:
        """The leaf of each column of the codes."""
        split = self.feature >= 0
        left, leaf = 2 * np.cumsum(split) - 1, np.cumsum(~split) - 1
        cut = np.zeros(len(split), np.int64)
        cut[split] = self.cut
        at = np.zeros(codes.shape[1], np.int64)
        on = np.arange(len(at)) if split[0] else at[:0]
        while len(on):
            node = at[on]
            feature = self.feature[node]
            value = codes[feature, on]
            goes = np.where(category[feature], value == cut[node], value <= cut[node])
            at[on] = left[node] + ~goes
            on = on[split[at[on]]]
        return leaf[at]


def _allowed(settings: ForestSettings, slots: int, nodes: int, draw: np.random.Generator):
    """Whether (node, slot) is looked at, as a function of arrays of both."""
    most = slots if settings.subset == "all" else math.ceil(math.sqrt(slots))
    if most >= slots:
        return lambda node, slot: np.ones(len(node), bool)
    if slots <= FEW_SLOTS:
        chosen = np.argpartition(draw.random((nodes, slots), np.float32), most - 1, axis=1)[:, :most]
        table = np.zeros((nodes, slots), bool)
        np.put_along_axis(table, chosen, True, axis=1)
        return lambda node, slot: table[node, slot]
    # Of many slots few are drawn twice, and these are drawn anew.
    keys = np.unique((np.arange(nodes)[:, None] * slots + draw.integers(0, slots, (nodes, most))).ravel())
    while len(keys) < nodes * most:
        lack = most - np.bincount(keys // slots, minlength=nodes)
        again = np.repeat(np.arange(nodes), lack)
        keys = np.unique(np.concatenate([keys, again * slots + draw.integers(0, slots, len(again))]))

    def among(node: np.ndarray, slot: np.ndarray) -> np.ndarray:
        wanted = node * slots + slot
        return keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted

    return among


class _Rule:
    """What settings make of (statistic, node) sums: see `grown`."""

    def __init__(self, settings: ForestSettings, bins: Bins):
        self.settings, self.category = settings, bins.is_category
        # The last code of a category stands for unknown values, which no row learned from has.
        self.slots = np.concatenate([[0], np.cumsum(np.where(self.category, bins.sizes - 1, 1))])
        self.weights = np.array(settings.weights or [1.0] * settings.classes)[:, None]

    def count(self, x: np.ndarray) -> np.ndarray:
        return x.sum(axis=0) if self.settings.classes else x[0]

    def side(self, x: np.ndarray) -> np.ndarray:
        """What the impurity of a side is less by, times its weight."""
        if not self.settings.classes:
            return x[1] * x[1] / x[0]
        weighed = x * self.weights
        return (weighed * weighed).sum(axis=0) / weighed.sum(axis=0)

    def opens(self, x: np.ndarray, depth: int) -> np.ndarray:
        """Whether nodes may be split."""
        if self.settings.depth is not None and depth >= self.settings.depth:
            return np.zeros(x.shape[1], bool)
        some = self.count(x) >= 2 * self.settings.least_rows
        return some & (x.max(axis=0) < self.count(x)) if self.settings.classes else some

    def values(self, x: np.ndarray) -> np.ndarray:
        """(leaf, output) scores, of numbers as whole numbers."""
        if not self.settings.classes:
            return np.rint(x[1] / x[0])[:, None]
        weighed = x * self.weights
        return (np.rint(weighed / weighed.sum(axis=0) / FINEST) * FINEST).T


class _Level:
    """The best splits of some nodes, of those looked at so far. total: (statistic, node) sums."""

    def __init__(self, rule: _Rule, total: np.ndarray, draw: np.random.Generator):
        self.rule, self.total, nodes = rule, total, total.shape[1]
        self.whole = rule.side(total)
        # What is less than the error of the sums is no gain.
        self.gain = 1e-12 * self.whole
        self.feature, self.cut, self.left = np.full(nodes, -1, np.int16), np.zeros(nodes, np.int64), np.zeros_like(total)
        self._looked = _allowed(rule.settings, int(rule.slots[-1]), nodes, draw)

    def look(self, f: int, owner: np.ndarray, code: np.ndarray, low: np.ndarray) -> None:
        """Splits of a feature, by node and code, with the sums of the rows that would go left."""
        rule = self.rule
        rows = rule.count(low)
        least = rule.settings.least_rows
        on = np.flatnonzero((rows >= least) & (rule.count(self.total)[owner] - rows >= least))
        on = on[self._looked(owner[on], rule.slots[f] + code[on] * rule.category[f])]
        if not len(on):
            return
        owner, code, low = owner[on], code[on], low[:, on]
        found = rule.side(low) + rule.side(self.total[:, owner] - low) - self.whole[owner]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        top, own = np.maximum.reduceat(found, first), owner[first]
        best = np.flatnonzero(found == np.repeat(top, np.diff(first, append=len(found))))
        best = best[np.unique(owner[best], return_index=True)[1]]
        better = top > self.gain[own]
        own, best = own[better], best[better]
        self.gain[own], self.feature[own], self.cut[own], self.left[:, own] = top[better], f, code[best], low[:, best]


def grown(codes: np.ndarray, stats: np.ndarray, settings: ForestSettings, bins: Bins, draw: np.random.Generator, depth: int = 0) -> Grown:
    """A tree from cells with codes (feature, cell), whose root is at this depth.

    stats: per class the drawn rows of each cell, or for numbers the drawn rows and the sum of
    their labels, as whole numbers. A split has the largest gain, of Gini's impurity or of
    squares; of equals the first feature and code.
    """
    rule, category = _Rule(settings, bins), bins.is_category
    node = np.zeros(codes.shape[1], np.int64)
    orders = [np.argsort(c, kind="stable") for c in codes]
    sums = stats.sum(axis=1, keepdims=True)
    is_open = rule.opens(sums, depth)
    features, cuts, leaves = [], [], []
    while True:
        alive = np.flatnonzero(is_open)
        total = sums[:, alive]
        level = _Level(rule, total, draw)
        if len(alive):
            at = np.repeat(np.arange(len(alive)), np.bincount(node[orders[0]], minlength=len(alive)))
            before = np.cumsum(total, axis=1) - total
            for f, order in enumerate(orders):
                code = codes[f][order]
                end = np.ones(len(order), bool)
                end[:-1] = (code[1:] != code[:-1]) | (at[1:] != at[:-1])
                place = np.flatnonzero(end)
                owner, low = at[place], np.cumsum(stats[:, order], axis=1)[:, place]
                # Categories: one value against all others. Numbers: all up to a code.
                low = np.diff(low, axis=1, prepend=0) if category[f] else low - before[:, owner]
                level.look(f, owner, code[place].astype(np.int64), low)
        split = level.feature >= 0
        every = np.full(sums.shape[1], -1, np.int16)
        every[alive] = level.feature
        features.append(every)
        cuts.append(level.cut[split])
        leaves.append(sums[:, every < 0])
        if not split.any():
            break
        sums, depth = np.empty((len(stats), 2 * int(split.sum()))), depth + 1
        sums[:, 0::2], sums[:, 1::2] = level.left[:, split], (total - level.left)[:, split]
        is_open = rule.opens(sums, depth)
        # Children that stay open, by the nodes they come from; cells of other nodes are done.
        children = np.full((len(alive), 2), -1, np.int64)
        children[split] = np.where(is_open, np.cumsum(is_open) - 1, -1).reshape(-1, 2)
        cells = orders[0]
        from_, by = node[cells], level.feature[node[cells]]
        value = codes[by, cells]
        goes = np.where(category[by], value == level.cut[from_], value <= level.cut[from_])
        node[cells] = children[from_, np.where(goes, 0, 1)]
        few = is_open.sum() < 1 << 16
        for f, order in enumerate(orders):
            order = order[node[order] >= 0]
            # Sorting 16 bits takes one pass.
            orders[f] = order[np.argsort(node[order].astype(np.uint16) if few else node[order], kind="stable")]
    return Grown(np.concatenate(features), np.concatenate(cuts), rule.values(np.concatenate(leaves, axis=1)))


def _code_type(bins: Bins) -> np.dtype:
    return bins.codes(np.empty((0, len(bins.cuts)))).dtype


def _packed_codes(codes: np.ndarray) -> pa.Array:
    """(feature, row) codes as one binary value per row."""
    by_row = np.ascontiguousarray(codes.T)
    width = by_row.dtype.itemsize * by_row.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(by_row), [None, pa.py_buffer(by_row)]).cast(pa.binary())


def _unpacked_codes(packed: bytes, bins: Bins) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, _code_type(bins)).reshape(-1, len(bins.cuts)).T)


def _coded(batches: Iterator[pa.RecordBatch], bins: Bins, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The features in the first column as packed codes; the other columns as they are."""
    for batch in batches:
        flat = np.asarray(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, len(bins.cuts))
        yield pa.RecordBatch.from_arrays([_packed_codes(bins.codes(flat)), *batch.columns[1:]], names=names)


_BLOCK = "block int, codes binary, cell binary, label binary, count binary"
_TREES = "tree int, part int, top_feature binary, top_cut binary, feature binary, cut binary, values binary"
_NAMES = ["tree", "part", "top_feature", "top_cut", "feature", "cut", "values"]


def block_table(merged: DataFrame) -> DataFrame:
    """Merged rows (codes, label, count), in order, as a block per partition: codes of its cells, and cell, label and count of its rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b"".join(batch.column(0).to_pylist()), batch.column(1).to_numpy(), batch.column(2).to_numpy()) for batch in batches if batch.num_rows]
        if held:
            label, count = (np.concatenate(x) for x in list(zip(*held))[1:])
            codes = np.frombuffer(b"".join(x[0] for x in held), np.uint8).reshape(len(label), -1)
            new = np.ones(len(label), bool)
            new[1:] = (codes[1:] != codes[:-1]).any(axis=1)
            values = [codes[new], (np.cumsum(new) - 1).astype(np.int32), label.astype(np.int64), count.astype(np.int64)]
            block = pa.array([TaskContext.get().partitionId()], pa.int32())
            yield pa.RecordBatch.from_arrays([block, *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=["block", "codes", "cell", "label", "count"])

    return merged.mapInArrow(pack, _BLOCK)


def _generator(settings: ForestSettings, *of: int) -> np.random.Generator:
    return np.random.default_rng([settings.seed & (1 << 63) - 1, *of])


def _drawn(row: dict, trees: Iterable[int], settings: ForestSettings, bins: Bins) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per tree its number, and the codes and statistics of the cells of a block that it has rows of."""
    codes = _unpacked_codes(row["codes"], bins)
    cell, label, count = (np.frombuffer(row[c], t) for c, t in (("cell", np.int32), ("label", np.int64), ("count", np.int64)))
    for tree in trees:
        drawn = _generator(settings, tree, row["block"], 0).poisson(count).astype(np.float64)
        if settings.classes:
            stats = np.bincount(label * codes.shape[1] + cell, drawn, settings.classes * codes.shape[1]).reshape(settings.classes, -1)
        else:
            # Whole numbers below 2^53 add up exactly.
            stats = np.stack([np.bincount(cell, w, codes.shape[1]) for w in (drawn, drawn * label)])
        on = (stats if settings.classes else stats[:1]).any(axis=0)
        if on.any():
            yield tree, codes[:, on], stats[:, on]


def _grown_row(tree: int, part: int, top: Grown, found: Grown, settings: ForestSettings, bins: Bins, scale: float) -> pa.RecordBatch:
    values = found.values.astype(np.float32) if settings.classes else found.values / scale
    code = _code_type(bins)
    binary = (top.feature, top.cut.astype(code), found.feature, found.cut.astype(code), values)
    return pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([part], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in binary)], names=_NAMES)


def _trees_of_task(id_: int, settings: ForestSettings) -> range:
    return range(id_ * TASK_TREES, min((id_ + 1) * TASK_TREES, settings.trees))


class _Writer(MLWriter):
    def __init__(self, instance: HistogramForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> HistogramForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = HistogramForestModel(table=self.sparkSession.read.schema(_TREES).parquet(f"{path}/trees"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class HistogramForestModel(Model, MLWritable, MLReadable):
    """A fitted forest: adds prediction, and for classes probability, to rows with features.

    table: a row per tree, or where trees are large per part of one: the part's nodes, and the
    nodes above all parts, whose leaf of the part's number it grows from.
    """

    featuresCol = Param(Params._dummy(), "featuresCol", "the vector of features", TypeConverters.toString)
    facts = Param(Params._dummy(), "facts", "settings, bins and what scores are less as JSON", TypeConverters.toString)

    def __init__(self, featuresCol: str = "features", facts: str = "{}", table: DataFrame | None = None):
        super().__init__()
        self._set(featuresCol=featuresCol, facts=facts)
        self.table = table

    def describe(self) -> dict:
        return json.loads(self.getOrDefault(self.facts))

    @property
    def bins(self) -> Bins:
        told = self.describe()
        return Bins(told["cuts"], told["categories"])

    @property
    def numFeatures(self) -> int:
        return len(self.bins.cuts)

    def coded(self, dataset: DataFrame, others: list[str]) -> DataFrame:
        """The columns `others` of rows, with the combination of bins that each is in as `_cell`."""
        _find_package(dataset.sparkSession)
        bins, names = self.bins, ["_cell", *(f"_other{i}" for i in range(len(others)))]
        array = vector_to_array(self.getOrDefault(self.featuresCol)).alias("_cell")
        kinds = ", ".join(["_cell binary", *(f"{n} {dataset.schema[c].dataType.simpleString()}" for c, n in zip(others, names[1:]))])
        found = dataset.select(array, *[F.col(c).alias(n) for c, n in zip(others, names[1:])])
        found = found.mapInArrow(lambda batches: _coded(batches, bins, names), kinds)
        return found.withColumnsRenamed(dict(zip(names[1:], others)))

    def scores(self, cells: DataFrame) -> DataFrame:
        """(_cell, _scores) of distinct `_cell`: the mean of all trees, per class or for a number one."""
        _find_package(cells.sparkSession)
        told, bins = self.describe(), self.bins
        outputs = max(1, told["settings"]["classes"])
        kind = np.float32 if told["settings"]["classes"] else np.float64
        most = max(1, BLOCK_SCORES // outputs)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[bytes] = []
            for batch in batches:
                held += batch.column(0).to_pylist()
                while len(held) >= most:
                    yield pa.RecordBatch.from_pydict({"cells": [b"".join(held[:most])]})
                    held = held[most:]
            if held:
                yield pa.RecordBatch.from_pydict({"cells": [b"".join(held)]})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            category, code, sums = bins.is_category, _code_type(bins), {}
            for batch in batches:
                for row in batch.to_pylist():
                    codes = _unpacked_codes(row["cells"], bins)
                    array = lambda name, dtype: np.frombuffer(row[name], dtype)  # noqa: E731, B023
                    top = Grown(array("top_feature", np.int16), array("top_cut", code), np.empty(0))
                    part = Grown(array("feature", np.int16), array("cut", code), array("values", kind).reshape(-1, outputs))
                    # The last column counts trees: one that drew no row has none.
                    own = sums.setdefault(row["cells"], np.zeros((codes.shape[1], outputs + 1)))
                    on = np.flatnonzero(top.leaves(codes, category) == row["part"])
                    own[on, :-1] += part.values[part.leaves(codes[:, on], category)]
                    own[on, -1] += 1
            for cells_, total in sums.items():
                yield pa.RecordBatch.from_pydict({"cells": [cells_], "sums": [total.tobytes()]})

        def total(table: pa.Table) -> pa.Table:
            codes = _unpacked_codes(table.column("cells")[0].as_py(), bins)
            sums = np.zeros((codes.shape[1], outputs + 1))
            for part in table.column("sums").to_pylist():
                sums += np.frombuffer(part, np.float64).reshape(sums.shape)
            return pa.Table.from_arrays([_packed_codes(codes), pa.array(list(told["low"] + sums[:, :-1] / sums[:, -1:]), pa.list_(pa.float64()))], names=["_cell", "_scores"])

        blocks = cells.select("_cell").mapInArrow(pack, "cells binary")
        # Every task of trees reads the blocks itself: neither side is dealt out from the driver.
        added = self.table.hint("shuffle_replicate_nl").crossJoin(blocks).mapInArrow(add, "cells binary, sums binary")
        return added.groupBy("cells").applyInArrow(total, "_cell binary, _scores array<double>")

    def scored(self, coded: DataFrame, cells: DataFrame) -> DataFrame:
        """The rows with prediction, and for classes probability, from the scores of their cells."""
        found = coded.join(cells, "_cell").drop("_cell")
        if not self.describe()["settings"]["classes"]:
            return found.withColumn("prediction", F.col("_scores")[0]).drop("_scores")
        # Of equal scores the first class.
        top = F.array_position("_scores", F.array_max("_scores")) - 1
        return found.withColumn("prediction", top.cast("double")).withColumn("probability", array_to_vector("_scores")).drop("_scores")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        _find_package(dataset.sparkSession)
        bins = self.bins

        @F.pandas_udf("binary")
        def cell(rows: pd.Series) -> pd.Series:
            flat = np.stack(rows.to_list()) if len(rows) else np.empty((0, len(bins.cuts)))
            return pd.Series(_packed_codes(bins.codes(flat)).to_pylist())

        coded = dataset.withColumn("_cell", cell(vector_to_array(self.getOrDefault(self.featuresCol))))
        return self.scored(coded, self.scores(coded.select("_cell").distinct()))

    def write(self) -> _Writer:
        return _Writer(self)

    @classmethod
    def read(cls) -> _Reader:
        return _Reader()


@dataclass(frozen=True)
class HistogramForest:
    """Fits a forest to rows (features vector, label).

    categories: the number of values of each slot of the vector that is an indexed category.
    """

    settings: ForestSettings
    features: str
    label: str
    categories: dict[int, int] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> HistogramForestModel:
        spark, settings = df.sparkSession, self.settings
        _find_package(spark)
        rows = df.select(vector_to_array(self.features).alias("features"), F.col(self.label).cast("double").alias("label"))
        told = rows.agg(
            F.count(F.lit(1)).alias("rows"), F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.size("features")).alias("features")
        ).first()
        if not told["rows"]:
            raise ValueError("there is no row to learn from")
        bins = feature_bins(rows, told["features"], self.categories, BINS)
        # Labels from the smallest on as whole numbers; classes are their numbers.
        low, scale = (0.0, 1.0) if settings.classes else (told["low"], Scale.of(told["rows"], told["high"] - told["low"], 0, SUM_BITS).first)
        folder = scratch_folder(spark)
        whole = rows.select("features", F.rint((F.col("label") - F.lit(low)) * F.lit(scale)).cast("long").alias("label"))
        coded = whole.mapInArrow(lambda batches: _coded(batches, bins, ["codes", "label"]), "codes binary, label long")
        try:
            coded.groupBy("codes", "label").agg(F.count(F.lit(1)).alias("count")).write.parquet(f"{folder}/merged")
            merged = spark.read.schema("codes binary, label long, count long").parquet(f"{folder}/merged")
            blocks = -(-merged.count() // BLOCK_ROWS)
            dealt = merged.coalesce(1) if blocks == 1 else merged.repartition(blocks, "codes")
            block_table(dealt.sortWithinPartitions("codes", "label")).write.parquet(f"{folder}/blocks")
            grow = self._in_tasks if blocks == 1 else self._over_blocks
            grow(spark, spark.read.schema(_BLOCK).parquet(f"{folder}/blocks"), bins, scale).write.parquet(f"{folder}/trees")
            remove_folder(spark, f"{folder}/merged")
            remove_folder(spark, f"{folder}/blocks")
        except BaseException:
            remove_folder(spark, folder)
            raise
        facts = {"settings": asdict(settings), "cuts": bins.cuts, "categories": bins.categories, "low": low}
        model = HistogramForestModel(self.features, json.dumps(facts), spark.read.schema(_TREES).parquet(f"{folder}/trees"))
        weakref.finalize(model, remove_folder, spark, folder)
        return model

    def _dealt(self, spark: SparkSession, blocks: DataFrame) -> DataFrame:
        """Every block for every task of trees, which reads it itself: it isn't dealt out from the driver."""
        tasks = -(-self.settings.trees // TASK_TREES)
        return spark.range(0, tasks, 1, tasks).hint("shuffle_replicate_nl").crossJoin(blocks)

    def _in_tasks(self, spark: SparkSession, blocks: DataFrame, bins: Bins, scale: float) -> DataFrame:
        """Whole trees from the only block."""
        settings, top = self.settings, Grown(np.array([-1], np.int16), np.empty(0), np.empty(0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    for tree, codes, stats in _drawn(row, _trees_of_task(row["id"], settings), settings, bins):
                        found = grown(codes, stats, settings, bins, _generator(settings, tree, 0, 1))
                        yield _grown_row(tree, 0, top, found, settings, bins, scale)

        return self._dealt(spark, blocks).mapInArrow(run, _TREES)

    def _over_blocks(self, spark: SparkSession, blocks: DataFrame, bins: Bins, scale: float) -> DataFrame:
        """Trees whose upper nodes are split by sums over all blocks, until the cells of a node are one block's."""
        settings, rule = self.settings, _Rule(self.settings, bins)
        trees, category = range(self.settings.trees), bins.is_category
        width = settings.classes or 2
        sums = [f"s{k}" for k in range(width + 1)]
        # Per tree its levels so far (features, cuts), whether nodes of the last level are too wide
        # for a task, and of the leaves above that level their depths and whether they stay leaves.
        levels: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in trees]
        wide = [np.ones(1, bool) for _ in trees]
        depths: list[list[int]] = [[] for _ in trees]
        closed: list[list[bool]] = [[] for _ in trees]

        def tops() -> list[Grown]:
            """The upper nodes so far; those of the last level are leaves, the last ones."""
            features = [np.concatenate([*(f for f, _ in own), np.full(len(last), -1, np.int16)]) for own, last in zip(levels, wide)]
            return [Grown(f, np.concatenate([np.empty(0, np.int64), *(c for _, c in own)]), np.empty(0)) for f, own in zip(features, levels)]

        while any(w.any() for w in wide):
            found = self._histograms(spark, blocks, bins, tops(), list(wide), sums)
            depth = max(len(levels[t]) for t in trees if wide[t].any())

            def best(table: pa.Table) -> pa.Table:
                table = table.sort_by([("feature", "ascending"), ("code", "ascending")])
                tree, node, feature, code = (table.column(n).to_numpy() for n in ("tree", "node", "feature", "code"))
                stats = np.stack([table.column(n).to_numpy() for n in sums])
                total = stats[:, feature == feature[0]].sum(axis=1, keepdims=True)
                level = _Level(rule, total[:-1], _generator(settings, int(tree[0]), depth, 2, int(node[0])))
                left = total[:, 0]
                for f in range(len(bins.cuts)) if rule.opens(total[:-1], depth)[0] else ():
                    own = feature == f
                    low = stats[:, own] if category[f] else np.cumsum(stats[:, own], axis=1)
                    level.look(f, np.zeros(low.shape[1], np.int64), code[own], low[:-1])
                    if level.feature[0] == f:
                        left = low[:, np.searchsorted(code[own], level.cut[0])]
                cells = pa.array([[left[-1], total[-1, 0] - left[-1]]], pa.list_(pa.float64()))
                values = [pa.array(tree[:1]), pa.array(node[:1]), pa.array(level.feature.astype(np.int32)), pa.array(level.cut), cells]
                return pa.Table.from_arrays(values, names=["tree", "node", "feature", "cut", "cells"])

            # One row per node that is too wide.
            rows = found.groupBy("tree", "node").applyInArrow(best, "tree int, node int, feature int, cut long, cells array<double>").collect()
            split: list[dict[int, tuple]] = [{} for _ in trees]
            for row in rows:
                if row["feature"] >= 0:
                    split[row["tree"]][row["node"]] = row
            for t in trees:
                if not wide[t].any():
                    continue
                order = sorted(split[t])
                features = np.full(len(wide[t]), -1, np.int16)
                features[order] = [split[t][node]["feature"] for node in order]
                depths[t] += [depth] * int((features < 0).sum())
                closed[t] += wide[t][features < 0].tolist()
                levels[t].append((features, np.array([split[t][node]["cut"] for node in order], np.int64)))
                wide[t] = np.array([n for node in order for n in split[t][node]["cells"]]) > BLOCK_ROWS
        for t in trees:
            depths[t] += [len(levels[t])] * len(wide[t])
            closed[t] += [False] * len(wide[t])
        top = tops()

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    for tree, codes, stats in _drawn(row, _trees_of_task(row["id"], settings), settings, bins):
                        part = top[tree].leaves(codes, category)
                        order = np.argsort(part, kind="stable")
                        for on in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                            of, code, own = int(part[on[0]]), codes[:, on], stats[:, on]
                            if closed[tree][of]:
                                # A leaf is its sums, in a cell that nothing splits.
                                code, own = np.zeros_like(code[:, :1]), own.sum(axis=1, keepdims=True)
                            values = [pa.array([tree], pa.int32()), pa.array([of], pa.int32()), pa.array([code.T.tobytes()], pa.binary()), pa.array([own.T.tobytes()], pa.binary())]
                            yield pa.RecordBatch.from_arrays(values, names=["tree", "part", "codes", "stats"])

        def grow(table: pa.Table) -> pa.Table:
            tree, part = table.column("tree")[0].as_py(), table.column("part")[0].as_py()
            codes = np.concatenate([_unpacked_codes(c, bins) for c in table.column("codes").to_pylist()], axis=1)
            stats = np.concatenate([np.frombuffer(s, np.float64).reshape(-1, width).T for s in table.column("stats").to_pylist()], axis=1)
            # The order that blocks arrive in changes nothing.
            order = np.lexsort(codes)
            found = grown(codes[:, order], stats[:, order], settings, bins, _generator(settings, tree, part, 1), depths[tree][part])
            return pa.Table.from_batches([_grown_row(tree, part, top[tree], found, settings, bins, scale)])

        parts = self._dealt(spark, blocks).mapInArrow(deal, "tree int, part int, codes binary, stats binary")
        return parts.groupBy("tree", "part").applyInArrow(grow, _TREES)

    def _histograms(self, spark: SparkSession, blocks: DataFrame, bins: Bins, top: list[Grown], wide: list[np.ndarray], sums: list[str]) -> DataFrame:
        """Statistics, and cells, per wide node of the last levels, feature and code, over all blocks."""
        settings, category, sizes = self.settings, bins.is_category, bins.sizes.tolist()

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    trees = [t for t in _trees_of_task(row["id"], settings) if wide[t].any()]
                    for tree, codes, stats in _drawn(row, trees, settings, bins):
                        above = int((top[tree].feature < 0).sum()) - len(wide[tree])
                        node = top[tree].leaves(codes, category) - above
                        on = np.flatnonzero(np.concatenate([np.zeros(above, bool), wide[tree]])[node + above])
                        weights = np.concatenate([stats[:, on], np.ones((1, len(on)))])
                        for f, size in enumerate(sizes if len(on) else ()):
                            key, place = np.unique(node[on] * size + codes[f, on], return_inverse=True)
                            same = [np.full(len(key), tree, np.int32), (key // size).astype(np.int32), np.full(len(key), f, np.int32), key % size]
                            added = [np.bincount(place, w, len(key)) for w in weights]
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in [*same, *added]], names=["tree", "node", "feature", "code", *sums])

        kinds = "tree int, node int, feature int, code long, " + ", ".join(f"{s} double" for s in sums)
        found = self._dealt(spark, blocks).mapInArrow(look, kinds)
        # Whole numbers below 2^53 add up exactly, in any order.
        return found.groupBy("tree", "node", "feature", "code").agg(*[F.sum(s).alias(s) for s in sums])
