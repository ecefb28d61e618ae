"""Gradient boosting by histograms, leaf by leaf.

Features are binned once. Rows of equal codes and labels, for numbers of equal codes, are
counted as one from then on: their derivatives add up to the same whole numbers. What is left,
at most one row per combination of bins, is kept as blocks in Parquet. A round looks at the
gradients of all rows only through sums per node, feature and bin: one grouped aggregate for
all nodes that are new. The leaf with the largest gain is split next, until a tree has as
many leaves as it may. Gradients are whole numbers after a fixed scaling, so their sums,
and with them the trees, don't depend on partitions.

A table whose merged rows fit one block is boosted by the task that holds it, with the same steps.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.functions.tables import remove_folder, scratch_folder

#: Codes in a block, and rows: sums of a block stay whole numbers in double precision.
BLOCK_CELLS, BLOCK_ROWS = 16_000_000, 1 << 20
#: Bits of a scaled gradient, and of a sum of them over all rows: whole in double precision.
GRADIENT_BITS, SUM_BITS = 32, 51
#: Bin combinations whose scores a task remembers.
KNOWN_SCORES = 200_000
#: Rounds after which the scores of the blocks are written again.
SCORED_ROUNDS = 16
# Rows of a leaf, its least second derivative, bins of a number; above so many
# rows, boosting ends when the loss of a tenth of them hasn't fallen by this in so many rounds.
LEAST_ROWS, LEAST_HESSIAN, BINS = 20, 1e-3, 255
STOPPING_ROWS, PATIENCE, TOLERANCE = 10_000, 10, 1e-7


@dataclass(frozen=True)
class Scale:
    """What derivatives and losses are multiplied by to be whole numbers: powers of two."""

    first: float
    second: float
    loss: float

    @staticmethod
    def of(rows: int, span: float, classes: int, most: int = 60) -> Scale:
        """span: the largest label less the smallest. Sums over all rows stay below 2^`most`."""
        bits = min(GRADIENT_BITS, most - math.ceil(math.log2(rows + 1)))
        if classes:
            return Scale(2.0**bits, 2.0**bits, 2.0 ** (bits - 6))
        power = math.ceil(math.log2(span)) if span > 0 else 0
        # The second derivative of half a square is one.
        return Scale(2.0 ** (bits - power), 1.0, 2.0 ** (bits - 2 * power))


@dataclass(frozen=True)
class Settings:
    """What a model is grown by. classes: 0 for numbers, else the number of classes."""

    classes: int
    rounds: int = 100
    rate: float = 0.1
    leaves: int = 31
    depth: int | None = None
    l2: float = 0.0
    least_rows: int = LEAST_ROWS
    patience: int | None = None
    tolerance: float = TOLERANCE

    @property
    def outputs(self) -> int:
        """Trees of a round."""
        return self.classes if self.classes > 2 else 1


@dataclass
class Tree:
    """Nodes by number, the root first. A leaf has feature -1.

    Rows go left whose code is at most `bin`, or for a category equals it; `threshold` is the
    largest number that goes left.
    """

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, threshold: float) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.threshold[node] = feature, bin_, threshold
        for names in (self.left, self.right):
            names[node] = len(self.feature)
            for values, new in ((self.feature, -1), (self.bin, 0), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
                values.append(new)
        return self.left[node], self.right[node]

    def nodes(self, values: np.ndarray, category: np.ndarray, binned: bool, at: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row; values are (feature, row), codes if binned and else numbers.

        at: nodes on the rows' ways to go on from, in place of the root.
        """
        feature, cut = np.array(self.feature), np.array(self.bin if binned else self.threshold)
        exact, left, right = np.append(category, False)[feature], np.array(self.left), np.array(self.right)
        at = np.zeros(values.shape[1], np.int32) if at is None else at
        on = np.flatnonzero(feature[at] >= 0)
        while len(on):
            node = at[on]
            value = values[feature[node], on]
            goes = np.where(exact[node], value == cut[node], value <= cut[node])
            at[on] = np.where(goes, left[node], right[node])
            on = on[feature[at[on]] >= 0]
        return at


@dataclass(frozen=True)
class Bins:
    """Per feature its cuts between bins; for a category the number of its values, and no cuts."""

    cuts: list[list[float]]
    categories: list[int]

    @property
    def sizes(self) -> np.ndarray:
        return np.array([n or len(c) + 1 for c, n in zip(self.cuts, self.categories)], np.int64)

    @property
    def is_category(self) -> np.ndarray:
        return np.array([n > 0 for n in self.categories], bool)

    def codes(self, values: np.ndarray) -> np.ndarray:
        """(feature, row) codes of (row, feature) numbers."""
        kind = np.uint8 if self.sizes.max(initial=0) <= 256 else np.int32
        out = np.empty((values.shape[1], len(values)), kind)
        for f, (cuts, n) in enumerate(zip(self.cuts, self.categories)):
            out[f] = values[:, f] if n else np.searchsorted(cuts, values[:, f], "left")
        return out


@dataclass
class Block:
    """Merged rows that a task holds: codes, labels, whether they only tell when to stop, scores, and how many each stands for.

    The label of a number is the sum of its rows' labels, less the base, as a whole number.
    """

    codes: np.ndarray
    label: np.ndarray
    watched: np.ndarray
    scores: np.ndarray
    count: np.ndarray
    # Of the round that is grown now: the rows of each node by tree, and derivatives.
    _at: dict[int, tuple[Tree, dict[int, np.ndarray]]] = field(default_factory=dict)
    _derivatives: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def rows_of(self, k: int, tree: Tree, category: np.ndarray) -> dict[int, np.ndarray]:
        """The rows of each leaf of a tree that is still grown; only those of new splits are dealt out."""
        held = self._at.get(k)
        rows = held[1] if held and held[0] is tree else {0: np.arange(len(self.label))}
        self._at[k] = tree, rows
        open_ = [node for node in rows if tree.feature[node] >= 0]
        while open_:
            node = open_.pop()
            on, f = rows.pop(node), tree.feature[node]
            value = self.codes[f][on]
            goes = value == tree.bin[node] if category[f] else value <= tree.bin[node]
            for child, own in ((tree.left[node], on[goes]), (tree.right[node], on[~goes])):
                rows[child] = own
                if tree.feature[child] >= 0:
                    open_.append(child)
        return rows

    def add_grown(self, trees: list[tuple[Tree, np.ndarray]], category: np.ndarray) -> None:
        """Add to the scores what a round's trees, as they were grown, give to each node."""
        for k, (tree, values) in enumerate(trees):
            for node, on in self.rows_of(k, tree, category).items():
                self.scores[k][on] += values[node]
        self._at, self._derivatives = {}, {}

    def add(self, trees: list[list[Tree]], category: np.ndarray) -> None:
        for round_ in trees:
            for k, tree in enumerate(round_):
                self.scores[k] += np.array(tree.value)[tree.nodes(self.codes, category, True)]
        self._at, self._derivatives = {}, {}

    @cached_property
    def _any_watched(self) -> bool:
        return bool(self.watched.any())

    def derivatives(self, settings: Settings, k: int, scale: Scale) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives of the loss, as whole numbers."""
        if k in self._derivatives:
            return self._derivatives[k]
        if not settings.classes:
            self._derivatives[k] = self.count * np.rint(self.scores[0] * scale.first) - self.label, self.count
            return self._derivatives[k]
        if settings.outputs == 1:
            p = 1 / (1 + np.exp(-self.scores[0]))
            first, second = p - self.label, p * (1 - p)
        else:
            p = np.exp(self.scores - self.scores.max(axis=0))
            p = p[k] / p.sum(axis=0)
            first, second = p - (self.label == k), p * (1 - p)
        self._derivatives[k] = self.count * np.rint(first * scale.first), self.count * np.rint(second * scale.second)
        return self._derivatives[k]

    def loss(self, settings: Settings, scale: Scale) -> tuple[int, int]:
        """Rows that are watched, and the sum of their losses as a whole number.

        For numbers less what no tree can change: the squares within merged rows.
        """
        scores, label, count = self.scores[:, self.watched], self.label[self.watched], self.count[self.watched]
        if not settings.classes:
            each = (scores[0] - label / scale.first / count) ** 2 / 2
        elif settings.outputs == 1:
            each = np.logaddexp(0, scores[0]) - label * scores[0]
        else:
            top = scores.max(axis=0)
            each = top + np.log(np.exp(scores - top).sum(axis=0)) - scores[label.astype(np.int64), np.arange(len(label))]
        return int(count.sum()), int((count * np.rint(each * scale.loss)).astype(np.int64).sum())

    def histograms(self, settings: Settings, bins: Bins, trees: list[Tree], wanted: list[tuple[int, int]], scale: Scale) -> np.ndarray:
        """(rows, first, second) sums per wanted (tree, node) and bin of all features, flat."""
        sizes = bins.sizes
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros((3, len(wanted), int(starts[-1])), np.int64)
        for k, tree in enumerate(trees):
            places = {node: i for i, (tree_, node) in enumerate(wanted) if tree_ == k}
            if not places:
                continue
            rows = self.rows_of(k, tree, bins.is_category)
            derivatives = (self.count, *self.derivatives(settings, k, scale))
            for node, place in places.items():
                on = rows[node]
                if self._any_watched:
                    on = on[~self.watched[on]]
                # The root has all rows, so they need not be gathered.
                whole = len(on) == len(self.label)
                weights = derivatives if whole else [d[on] for d in derivatives]
                for f, size in enumerate(sizes.tolist()):
                    code = self.codes[f] if whole else self.codes[f][on]
                    for row, weight in enumerate(weights):
                        # Whole numbers below 2^53 add up exactly.
                        out[row, place, starts[f] : starts[f + 1]] += np.bincount(code, weight, size).astype(np.int64)
        return out


def _gain(first, second, l2):
    return first * first / (second + l2)


@dataclass
class Leaf:
    """A node with its sums, the histogram they come from, and its best split."""

    tree: int
    node: int
    depth: int
    sums: np.ndarray
    histogram: np.ndarray
    gain: float = 0.0
    feature: int = -1
    bin: int = 0
    left: np.ndarray | None = None


def best_split(leaf: Leaf, settings: Settings, bins: Bins, scale: Scale) -> None:
    """The split of the largest gain, of equals the first feature and bin."""
    n, first, second = leaf.sums
    if n < 2 * settings.least_rows or second / scale.second < LEAST_HESSIAN or settings.depth is not None and leaf.depth >= settings.depth:
        return
    at = 0
    for f, (size, exact) in enumerate(zip(bins.sizes.tolist(), bins.is_category.tolist())):
        part = leaf.histogram[:, at : at + size]
        at += size
        # Numbers: all bins up to one. Categories: one against all others.
        low = part if exact else np.cumsum(part, axis=1)[:, :-1]
        high = leaf.sums[:, None] - low
        fits = (low[0] >= settings.least_rows) & (high[0] >= settings.least_rows)
        fits &= (low[2] / scale.second >= LEAST_HESSIAN) & (high[2] / scale.second >= LEAST_HESSIAN)
        if not fits.any():
            continue
        a, b = ((side[1] / scale.first, side[2] / scale.second) for side in (low, high))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = _gain(*a, settings.l2) + _gain(*b, settings.l2) - _gain(first / scale.first, second / scale.second, settings.l2)
        gain = np.where(fits, gain, -np.inf)
        best = int(np.argmax(gain))
        if gain[best] > leaf.gain:
            leaf.gain, leaf.feature, leaf.bin, leaf.left = float(gain[best]), f, best, low[:, best]


Histograms = Callable[[list[Tree], list[tuple[int, int]]], np.ndarray]


def grown(settings: Settings, bins: Bins, scale: Scale, histograms: Histograms, roots: np.ndarray) -> tuple[list[Tree], list[tuple[Tree, np.ndarray]]]:
    """The trees of one round, and as they were grown with the value of each node there.

    They come from the histograms of their roots and of the nodes they ask for. Leaves are split in order of their gains. All nodes that the order needs next are asked
    for at once; of two siblings only the one with fewer rows, the other is the rest.
    """
    trees = [Tree() for _ in range(settings.outputs)]
    known: dict[tuple[int, int], Leaf] = {}
    for k in range(len(trees)):
        known[k, 0] = Leaf(k, 0, 0, roots[:, k, : int(bins.sizes[0])].sum(axis=1), roots[:, k])
        best_split(known[k, 0], settings, bins, scale)
    while True:
        asked: list[tuple[Leaf, int, int, bool]] = []
        chosen = []
        for k, tree in enumerate(trees):
            leaves, open_ = 1, [known[k, 0]]
            order = []
            while leaves < settings.leaves and open_:
                leaf = min(open_, key=lambda x: (-x.gain, x.node))
                if leaf.gain <= 0:
                    break
                open_.remove(leaf)
                leaves += 1
                if tree.feature[leaf.node] < 0:
                    cuts = bins.cuts[leaf.feature]
                    threshold = float(leaf.bin) if bins.categories[leaf.feature] else cuts[leaf.bin]
                    left, right = tree.split(leaf.node, leaf.feature, leaf.bin, threshold)
                else:
                    left, right = tree.left[leaf.node], tree.right[leaf.node]
                order.append(leaf)
                if (k, left) in known:
                    open_ += [known[k, left], known[k, right]]
                else:
                    small = leaf.left[0] * 2 <= leaf.sums[0]
                    asked.append((leaf, left, right, bool(small)))
            chosen.append(order)
        if not asked:
            break
        wanted = [(leaf.tree, left if small else right) for leaf, left, right, small in asked]
        found = histograms(trees, wanted)
        for i, (leaf, left, right, small) in enumerate(asked):
            sides = (found[:, i], leaf.histogram - found[:, i])
            sums = (leaf.left, leaf.sums - leaf.left)
            for node, own, total in zip((left, right), sides if small else sides[::-1], sums):
                new = known[leaf.tree, node] = Leaf(leaf.tree, node, leaf.depth + 1, total, own)
                best_split(new, settings, bins, scale)
    outcome = [_finished(tree, order, k, known, settings, scale) for k, (tree, order) in enumerate(zip(trees, chosen))]
    return [tree for tree, _ in outcome], [(tree, values) for tree, (_, values) in zip(trees, outcome)]


def _finished(grown_: Tree, order: list[Leaf], k: int, known: dict, settings: Settings, scale: Scale) -> tuple[Tree, np.ndarray]:
    """The tree of the chosen splits alone, with the values of its leaves, and those by the nodes it was grown with."""
    split = {leaf.node for leaf in order}
    tree, numbers = Tree(), {0: 0}
    for leaf in order:
        at = numbers[leaf.node]
        children = tree.split(at, leaf.feature, leaf.bin, grown_.threshold[leaf.node])
        numbers[grown_.left[leaf.node]], numbers[grown_.right[leaf.node]] = children
    for node, at in numbers.items():
        if node not in split:
            _, first, second = known[k, node].sums
            total = second / scale.second + settings.l2
            tree.value[at] = float(-settings.rate * (first / scale.first) / total) if total > 0 else 0.0
    # Nodes that were split to no use have the value of the leaf above them.
    values = np.zeros(len(grown_.feature))
    for node, (feature, left, right) in enumerate(zip(grown_.feature, grown_.left, grown_.right)):
        if node in numbers:
            values[node] = tree.value[numbers[node]]
        if feature >= 0:
            values[[left, right]] = values[node]
    return tree, values


def stops(losses: list[float], settings: Settings) -> bool:
    """Whether none of the last losses is below the one before them by more than the tolerance."""
    if settings.patience is None or len(losses) <= settings.patience:
        return False
    *_, before = losses[: -settings.patience]
    return min(losses[-settings.patience :]) >= before - settings.tolerance


def boosted(settings: Settings, bins: Bins, scale: Scale, histograms, loss, done) -> list[list[Tree]]:
    """All rounds. histograms(trees, wanted), loss() and done(trees, grown) look at the rows."""
    rounds: list[list[Tree]] = []
    losses: list[float] = []
    while len(rounds) < settings.rounds:
        if settings.patience is not None:
            losses.append(loss())
            if stops(losses, settings):
                break
        empty = [Tree() for _ in range(settings.outputs)]
        trees, raw = grown(settings, bins, scale, histograms, histograms(empty, [(k, 0) for k in range(settings.outputs)]))
        if all(len(t.feature) == 1 for t in trees):
            break
        rounds.append(trees)
        done(trees, raw)
    return rounds


def _boosted_block(block: Block, settings: Settings, bins: Bins, scale: Scale) -> list[list[Tree]]:
    def loss() -> float:
        n, total = block.loss(settings, scale)
        return total / scale.loss / n

    return boosted(
        settings, bins, scale,
        lambda trees, wanted: block.histograms(settings, bins, trees, wanted, scale), loss,
        lambda trees, raw: block.add_grown(raw, bins.is_category),
    )


_BLOCK = "rows long, codes binary, label binary, watched binary, scores binary, count binary"


def _packed(block: Block) -> dict:
    return {"rows": len(block.label), "codes": block.codes.tobytes(), "label": block.label.tobytes(), "watched": block.watched.tobytes(), "scores": block.scores.tobytes(), "count": block.count.tobytes()}


def _unpacked(row: dict, bins: Bins, settings: Settings) -> Block:
    kind = bins.codes(np.empty((0, len(bins.cuts)))).dtype
    array = lambda name, dtype: np.frombuffer(row[name], dtype)
    return Block(
        array("codes", kind).reshape(len(bins.cuts), row["rows"]), array("label", np.float64), array("watched", bool),
        array("scores", np.float64).reshape(settings.outputs, row["rows"]).copy(), array("count", np.float64),
    )


_ARROW = pa.schema([("rows", pa.int64()), *((c, pa.binary()) for c in ("codes", "label", "watched", "scores", "count"))])


def merged_rows(rows: DataFrame, bins: Bins, settings: Settings, scale: Scale, base: np.ndarray) -> DataFrame:
    """Rows (features array, label, watched) as distinct (codes, label, watched) with their count.

    For numbers as distinct (codes, watched), with the whole-number sum of the labels.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(0).flatten(), np.float64).reshape(batch.num_rows, len(bins.cuts))
            codes = np.ascontiguousarray(bins.codes(flat).T)
            label = batch.column(1).to_numpy()
            if not settings.classes:
                label = np.rint((label - base[0]) * scale.first)
            width = codes.dtype.itemsize * codes.shape[1]
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(codes), [None, pa.py_buffer(codes)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([packed, pa.array(label.astype(np.int64)), batch.column(2)], names=["codes", "label", "watched"])

    found = rows.mapInArrow(coded, "codes binary, label long, watched boolean")
    count = F.count(F.lit(1)).alias("count")
    if settings.classes:
        return found.groupBy("codes", "label", "watched").agg(count)
    return found.groupBy("codes", "watched").agg(F.sum("label").alias("label"), count).select("codes", "label", "watched", "count")


def block_table(merged: DataFrame, bins: Bins, settings: Settings, base: np.ndarray) -> DataFrame:
    """Merged rows (codes, label, watched, count) as blocks."""
    most = min(BLOCK_ROWS, max(1, BLOCK_CELLS // max(1, len(bins.cuts))))
    kind = bins.codes(np.empty((0, len(bins.cuts)))).dtype
    # Scores of numbers are less the base, as their labels are.
    start = base if settings.classes else np.zeros(1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def out() -> pa.RecordBatch:
            codes, label, watched, counts = (np.concatenate(x, axis=-1) for x in zip(*held))
            block = Block(codes, label, watched, np.repeat(start[:, None], len(label), axis=1), counts)
            return pa.RecordBatch.from_pylist([_packed(block)], schema=_ARROW)

        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind).reshape(batch.num_rows, len(bins.cuts)).T
            label, counts = (batch.column(c).to_numpy().astype(np.float64) for c in (1, 3))
            watched = batch.column(2).to_numpy(zero_copy_only=False)
            for at in range(0, batch.num_rows, most):
                end = min(batch.num_rows, at + most)
                if count + end - at > most and held:
                    yield out()
                    held, count = [], 0
                held.append((codes[:, at:end], label[at:end], watched[at:end], counts[at:end]))
                count += end - at
        if count:
            yield out()

    return merged.mapInArrow(pack, _BLOCK)


def feature_bins(rows: DataFrame, features: int, categories: dict[int, int], most: int = BINS) -> Bins:
    """Cuts between the values of each feature of the array column, or even cuts if it has more than `most`.

    categories: the number of values of features that are indexed categories.
    """
    numbers = [f for f in range(features) if f not in categories]
    value = lambda f: F.col("features")[f] + 0.0
    cuts: dict[int, list[float]] = {}
    if numbers:
        # So close to the limit the estimate may be off; a few more values are gathered then.
        found = rows.agg(*[F.approx_count_distinct(value(f), 0.02).alias(f"n{f}") for f in numbers]).first()
        few = [f for f in numbers if found[f"n{f}"] <= most]
        many = [f for f in numbers if f not in few]
        steps = [k / most for k in range(1, most)]
        facts = rows.agg(
            *[F.sort_array(F.collect_set(value(f))).alias(f"v{f}") for f in few],
            *[F.percentile_approx(value(f), steps, 20_000).alias(f"v{f}") for f in many],
        ).first()
        for f in few:
            values = facts[f"v{f}"]
            cuts[f] = [_between(a, b) for a, b in zip(values, values[1:])]
        for f in many:
            cuts[f] = sorted(set(facts[f"v{f}"]))
    return Bins([cuts.get(f, []) for f in range(features)], [categories.get(f, 0) for f in range(features)])


def _between(a: float, b: float) -> float:
    """A number from a on and below b, in the middle if there is one."""
    middle = a + (b - a) / 2
    return middle if a <= middle < b else a


class _Cells:
    """Scores by the cells that the cuts of all trees make; each cell is scored once while it is remembered."""

    def __init__(self, rounds: list[list[Tree]], category: np.ndarray):
        cuts: list[set[float]] = [set() for _ in category]
        for trees in rounds:
            for tree in trees:
                for f, cut in zip(tree.feature, tree.threshold):
                    if f >= 0:
                        cuts[f].add(cut)
        self.cuts, self.category = [np.array(sorted(c)) for c in cuts], category
        self.sizes = [len(c) + 1 for c in self.cuts]
        self.keys, self.known = np.empty(0, np.int64), None

    def cells(self, values: np.ndarray) -> np.ndarray:
        cell = np.zeros(values.shape[1], np.int64)
        for f, (cuts, size) in enumerate(zip(self.cuts, self.sizes)):
            at = np.searchsorted(cuts, values[f], "left")
            if self.category[f] and len(cuts):
                at = np.where(cuts[np.minimum(at, len(cuts) - 1)] == values[f], at, len(cuts))
            cell = cell * size + at
        return cell

    def scores(self, values: np.ndarray, each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """each(values) of all columns of the values."""
        if math.prod(self.sizes) >= 1 << 62:
            return each(values)
        keys, first, place = np.unique(self.cells(values), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        found = each(values[:, first[new]])
        out = np.empty((len(found), len(keys)))
        out[:, new] = found
        if len(self.keys):
            out[:, ~new] = self.known[:, at[~new]]
        if len(self.keys) + len(found[0]) > KNOWN_SCORES:
            self.keys, self.known = keys, out
        elif new.any():
            keys = np.concatenate([self.keys, keys[new]])
            known = found if self.known is None else np.concatenate([self.known, found], axis=1)
            order = np.argsort(keys)
            self.keys, self.known = keys[order], known[:, order]
        return out[:, place]


class BoostedTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted booster: adds prediction, and for classes probability, to rows with features."""

    featuresCol = Param(Params._dummy(), "featuresCol", "the vector of features", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "settings, base scores, categories and trees as JSON", TypeConverters.toString)

    def __init__(self, featuresCol: str = "features", trees: str = "{}"):
        super().__init__()
        self._set(featuresCol=featuresCol, trees=trees)

    def describe(self) -> dict:
        return json.loads(self.getOrDefault(self.trees))

    @property
    def numFeatures(self) -> int:
        return len(self.describe()["categories"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark = dataset.sparkSession
        _find_package(spark)
        known = spark.sparkContext.broadcast(self.getOrDefault(self.trees))

        @F.pandas_udf("array<double>")
        def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            told = json.loads(known.value)
            category = np.array(told["categories"], bool)
            rounds = [[Tree(**t) for t in trees] for trees in told["rounds"]]
            cells = _Cells(rounds, category)

            def each(values: np.ndarray) -> np.ndarray:
                out = np.repeat(np.array(told["base"])[:, None], values.shape[1], axis=1)
                for trees in rounds:
                    for k, tree in enumerate(trees):
                        out[k] += np.array(tree.value)[tree.nodes(values, category, False)]
                return out

            for rows in parts:
                values = np.stack(rows.to_list()).T if len(rows) else np.empty((len(category), 0))
                yield pd.Series(list(cells.scores(values, each).T))

        classes = self.describe()["settings"]["classes"]
        names = set(dataset.columns)
        name = "__scores"
        while name in names:
            name += "_"
        found = dataset.withColumn(name, scores(vector_to_array(self.getOrDefault(self.featuresCol))))
        score = F.col(name)
        if not classes:
            return found.withColumn("prediction", score[0]).drop(name)
        if classes <= 2:
            p = 1 / (1 + F.exp(-score[0]))
            found = found.withColumn("probability", array_to_vector(F.array(1 - p, p)))
            return found.withColumn("prediction", (score[0] > 0).cast("double")).drop(name)
        # Of equal scores the first class.
        top = F.array_max(score)
        powers = F.transform(score, lambda s: F.exp(s - top))
        total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
        found = found.withColumn("probability", array_to_vector(F.transform(powers, lambda x: x / total)))
        return found.withColumn("prediction", (F.array_position(score, top) - 1).cast("double")).drop(name)


def _find_package(spark: SparkSession) -> None:
    """Python workers find this package even if the driver runs elsewhere."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)


@dataclass(frozen=True)
class HistogramBoosting:
    """Fits boosted trees to rows (features vector, label, watched).

    categories: the number of values of each slot of the vector that is an indexed category.
    Above STOPPING_ROWS training rows, those with `watched` tell when to stop, and the others
    are learned from; below that, and if none or all are watched, every round is grown from
    all rows. `stop_below` is another tolerance, for one round instead of PATIENCE.
    """

    settings: Settings
    features: str
    label: str
    watched: str | None = None
    categories: dict[int, int] = field(default_factory=dict)
    stop_below: float | None = None
    stopping_rows: int = STOPPING_ROWS

    def fit(self, df: DataFrame) -> BoostedTreesModel:
        spark = df.sparkSession
        _find_package(spark)
        watched = F.lit(False) if self.watched is None else F.coalesce(F.col(self.watched), F.lit(False))
        rows = df.select(vector_to_array(self.features).alias("features"), F.col(self.label).cast("double").alias("label"), watched.alias("watched"))
        told = rows.agg(
            F.count(F.lit(1)).alias("rows"), F.count_if("watched").alias("watched"), F.min("label").alias("low"),
            F.max("label").alias("high"), F.max(F.size("features")).alias("features"),
        ).first()
        if not told["rows"]:
            raise ValueError("there is no row to learn from")
        settings = self.settings
        stopping = 0 < told["watched"] < told["rows"] and (self.stop_below is not None or told["rows"] > self.stopping_rows)
        if stopping:
            settings = replace(settings, patience=PATIENCE if self.stop_below is None else 1, tolerance=TOLERANCE if self.stop_below is None else self.stop_below)
        else:
            rows = rows.withColumn("watched", F.lit(False))
        bins = feature_bins(rows, told["features"], self.categories)
        scale = Scale.of(told["rows"], told["high"] - told["low"], settings.classes, SUM_BITS)
        base = self._base(rows, settings, told["low"], scale)
        folder = scratch_folder(spark)
        try:
            merged_rows(rows, bins, settings, scale, base).write.parquet(f"{folder}/merged")
            merged = spark.read.schema("codes binary, label long, watched boolean, count long").parquet(f"{folder}/merged")
            left = merged.count()
            one = left * told["features"] <= BLOCK_CELLS and left <= BLOCK_ROWS
            block_table(merged.coalesce(1) if one else merged, bins, settings, base).write.parquet(f"{folder}/0")
            fit = self._in_one_task if one else self._over_blocks
            rounds = fit(spark, folder, settings, bins, scale)
        finally:
            remove_folder(spark, folder)
        text = {
            "settings": asdict(settings), "base": base.tolist(), "categories": [n > 0 for n in bins.categories],
            "rounds": [[asdict(tree) for tree in trees] for trees in rounds],
        }
        return BoostedTreesModel(self.features, json.dumps(text))

    def _base(self, rows: DataFrame, settings: Settings, low: float, scale: Scale) -> np.ndarray:
        """The scores before the first round, from whole-number sums."""
        learned = rows.where(~F.col("watched"))
        if not settings.classes:
            whole = F.round((F.col("label") - F.lit(low)) * scale.first).cast("decimal(38,0)")
            found = learned.agg(F.sum(whole).alias("s"), F.count(F.lit(1)).alias("n")).first()
            return np.array([low + float(found["s"]) / scale.first / found["n"]])
        counts = {int(r["label"]): r["n"] for r in learned.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(counts.values())
        share = np.array([max(counts.get(k, 0), 1e-9) / total for k in range(max(2, settings.classes))])
        return np.array([math.log(share[1] / share[0])]) if settings.outputs == 1 else np.log(share)

    def _in_one_task(self, spark: SparkSession, folder: str, settings: Settings, bins: Bins, scale: Scale) -> list[list[Tree]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    rounds = _boosted_block(_unpacked(row, bins, settings), settings, bins, scale)
                    text = json.dumps([[asdict(tree) for tree in trees] for trees in rounds])
                    yield pa.RecordBatch.from_pydict({"rounds": [text]})

        (found,) = spark.read.schema(_BLOCK).parquet(f"{folder}/0").mapInArrow(run, "rounds string").collect()
        return [[Tree(**t) for t in trees] for trees in json.loads(found["rounds"])]

    def _over_blocks(self, spark: SparkSession, folder: str, settings: Settings, bins: Bins, scale: Scale) -> list[list[Tree]]:
        written, since = 0, []
        total = int(bins.sizes.sum())

        def blocks() -> DataFrame:
            return spark.read.schema(_BLOCK).parquet(f"{folder}/{written}")

        def summed(look: Callable[[Block], Iterator[tuple[int, int, int, int]]]) -> pa.Table:
            """Sums over all blocks of what each tells as (cell, n, first, second)."""
            late = list(since)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in batch.to_pylist():
                        block = _unpacked(row, bins, settings)
                        block.add(late, bins.is_category)
                        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in look(block)], names=["cell", "n", "first", "second"])

            cells = blocks().mapInArrow(run, "cell long, n long, first long, second long")
            return cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "first", "second")]).toArrow()

        def histograms(trees: list[Tree], wanted: list[tuple[int, int]]) -> np.ndarray:
            def look(block: Block):
                flat = block.histograms(settings, bins, trees, wanted, scale).reshape(3, -1)
                on = np.flatnonzero(flat[0])
                return on, *flat[:, on]

            found = summed(look)
            out = np.zeros((3, len(wanted) * total), np.int64)
            out[:, found.column("cell").to_numpy()] = [found.column(c).to_numpy() for c in ("n", "first", "second")]
            return out.reshape(3, len(wanted), total)

        def loss() -> float:
            def look(block: Block):
                n, sum_ = block.loss(settings, scale)
                return [0], [n], [sum_], [0]

            found = summed(look).to_pylist()[0]
            return found["first"] / scale.loss / found["n"]

        def done(trees: list[Tree], raw: list) -> None:
            nonlocal written
            since.append(trees)
            if len(since) < SCORED_ROUNDS:
                return
            late = list(since)

            def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in batch.to_pylist():
                        block = _unpacked(row, bins, settings)
                        block.add(late, bins.is_category)
                        yield pa.RecordBatch.from_pylist([_packed(block)], schema=_ARROW)

            blocks().mapInArrow(score, _BLOCK).write.parquet(f"{folder}/{written + 1}")
            remove_folder(spark, f"{folder}/{written}")
            written += 1
            since.clear()

        return boosted(settings, bins, scale, histograms, loss, done)
