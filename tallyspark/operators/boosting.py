"""Gradient-boosted regression trees with second-order histograms and L1/L2 penalties.

Feature values become bins once (quantile cuts over all rows, one bin for missing values), and rows become blocks of
packed bins, targets and margins. Each level of a tree is one job: every task adds up gradients and counts of its rows by
(node, feature, bin), Spark adds the tasks' histograms by node, and the task that holds a node's sum finds its best split;
the driver gets one row per node. Gradients are fixed-point integers, so sums, and with them the trees, do not depend on
how rows are partitioned.

With G and H the sums of gradients and weights of a node, T(G) = sign(G) * max(|G| - l1, 0) and score = T(G)**2 / (H + l2),
a split gains score(left) + score(right) - score(node). Splits whose children weigh less than ``leaf`` are not made; after
growing, splits of two leaves that gain less than ``gain`` are undone, from below. Missing values go to the side that
gains more. A leaf's value is -rate * T(G) / (H + l2).
"""

from __future__ import annotations

import dataclasses
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from ..sources.tables import scratch_path, staged
from .features import FEATURES, TARGET

#: Rows of one block; their summed gradients are exact in double precision.
BLOCK_ROWS = 8192
#: Rows of one task of a job that builds histograms, at least.
TASK_ROWS = 8 * BLOCK_ROWS
BINS = 256
#: Gradients are multiples of the largest first residual divided by this.
FIXED = 1 << 28
#: After so many trees margins are written anew, so a job applies at most so many, less one, to its rows: every level of every
#: tree does that again.
APPLIED = 2
_EPS = 1e-6
_MISSING = BINS - 1


@dataclasses.dataclass(frozen=True)
class Boosting:
    """Parameters of the boosted trees."""

    trees: int = 300
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    leaf: float = 5
    l1: float = 0.1
    l2: float = 1.0
    gain: float = 0.1


@dataclasses.dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. ``bin`` splits bins, ``cut`` values: left is up to and including."""

    feature: np.ndarray
    bin: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaf_of(self, columns: np.ndarray, missing: np.ndarray, split: np.ndarray) -> np.ndarray:
        """Node of each row; ``columns`` is (features, rows), the right child follows the left one."""
        node = np.zeros(columns.shape[1], np.int64)
        at = np.flatnonzero(self.feature[node] >= 0)
        while at.size:
            own = node[at]
            f = self.feature[own]
            gone = missing[f, at]
            right = np.where(gone, ~self.missing_left[own], columns[f, at] > split[own])
            node[at] = self.left[own] + right
            at = at[self.feature[node[at]] >= 0]
        return node


def _blocks(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows: packed bins (a row per feature), targets, draws, and margins of zero."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            some = batch.slice(at, BLOCK_ROWS)
            bins = np.empty((len(cuts), some.num_rows), np.uint8)
            for f, own in enumerate(cuts):
                x = some.column(f"x{f}").to_numpy(zero_copy_only=False).astype(np.float64)
                bins[f] = np.where(np.isnan(x), _MISSING, np.searchsorted(own, x, side="left"))
            y = some.column("y").to_numpy(zero_copy_only=False).astype("<f8")
            draw = some.column("draw").to_numpy(zero_copy_only=False).astype("<i8")
            packed = [bins.tobytes(), y.tobytes(), draw.tobytes(), np.zeros(len(y), "<f8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], names=["bins", "y", "draw", "margin"])


_BLOCK = "bins binary, y binary, draw binary, margin binary"


def _unpacked(batches: Iterator[pa.RecordBatch], n_features: int):
    for batch in batches:
        for row in batch.to_pylist():
            y = np.frombuffer(row["y"], "<f8")
            bins = np.frombuffer(row["bins"], np.uint8).reshape(n_features, len(y))
            yield row, bins, y, np.frombuffer(row["draw"], "<i8").view(np.uint64), np.frombuffer(row["margin"], "<f8").copy()


def _applied(bins: np.ndarray, margin: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    missing = bins == _MISSING
    for tree in trees:
        margin += tree.value[tree.leaf_of(bins, missing, tree.bin)]
    return margin


def _remargined(batches: Iterator[pa.RecordBatch], n_features: int, trees: Sequence[Tree]) -> Iterator[pa.RecordBatch]:
    for row, bins, _, _, margin in _unpacked(batches, n_features):
        packed = [row["bins"], row["y"], row["draw"], _applied(bins, margin, trees).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], names=["bins", "y", "draw", "margin"])


def mixed(draw: np.ndarray, tree: int) -> np.ndarray:
    """A hash of each row's draw and the tree's number: a whole number below 2**53."""
    x = draw + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(by))) * np.uint64(times)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64)


def drawn(draw: np.ndarray, tree: int, part: float) -> np.ndarray:
    """Whether each row takes part in a tree."""
    return mixed(draw, tree) < part * 2.0**53


def _histograms(
    batches: Iterator[pa.RecordBatch], n_features: int, trees: Sequence[Tree], grown: Tree, nodes: list[int],
    chosen: list[int], number: int, part: float, unit: float,
) -> Iterator[pa.RecordBatch]:
    """One row per node with rows in this task: summed gradients and counts by (chosen feature, bin)."""
    slot_of = np.full(len(grown.feature), -1)
    slot_of[nodes] = np.arange(len(nodes))
    sums = np.zeros((2, len(nodes), len(chosen), BINS), np.int64)
    for _, bins, y, draw, margin in _unpacked(batches, n_features):
        margin = _applied(bins, margin, trees)
        some = drawn(draw, number, part)
        bins, gradient = bins[:, some], np.rint((margin - y)[some] / unit)
        slot = slot_of[grown.leaf_of(bins, bins == _MISSING, grown.bin)]
        here = np.flatnonzero(slot >= 0)
        base, gradient = slot[here] * BINS, gradient[here]
        for j, f in enumerate(chosen):
            at = base + bins[f, here]
            for k, weights in enumerate((gradient, None)):
                found = np.bincount(at, weights, minlength=len(nodes) * BINS)
                sums[k, :, j] += found.reshape(len(nodes), BINS).astype(np.int64)
    held = np.flatnonzero(sums[1, :, 0].sum(axis=1))
    if held.size:
        packed = [[sums[k, s].tobytes() for s in held] for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), *(pa.array(p, pa.binary()) for p in packed)], names=["slot", "g", "h"]
        )


def best_split(g: np.ndarray, h: np.ndarray, params: Boosting) -> tuple:
    """(loss change, feature slot, bin, missing left, left G, left H, G, H) of the best split of one node, by (feature, bin).

    Ties: the first feature, the first bin, missing to the right. Without a split the loss change is 0.
    """
    total_g, total_h = g[0].sum(), h[0].sum()

    def score(gs, hs):
        return np.maximum(np.abs(gs) - params.l1, 0) ** 2 / np.maximum(hs + params.l2, _EPS)

    best = (0.0, -1, -1, False, 0.0, 0.0, float(total_g), float(total_h))
    left_g, left_h = g[:, :_MISSING].cumsum(axis=1), h[:, :_MISSING].cumsum(axis=1)
    parent = score(total_g, total_h)
    for missing_left in (False, True):
        lg = left_g + g[:, _MISSING:] * missing_left
        lh = left_h + h[:, _MISSING:] * missing_left
        rg, rh = total_g - lg, total_h - lh
        change = score(lg, lh) + score(rg, rh) - parent
        change[(lh < max(params.leaf, _EPS)) | (rh < max(params.leaf, _EPS))] = 0
        f, b = np.unravel_index(np.argmax(change), change.shape)
        if change[f, b] > max(best[0], _EPS):
            best = (float(change[f, b]), int(f), int(b), missing_left, float(lg[f, b]), float(lh[f, b]), float(total_g), float(total_h))
    return best


def _splits(batches: Iterator[pa.RecordBatch], n_chosen: int, unit: float, params: Boosting) -> Iterator[pa.RecordBatch]:
    """The nodes' histograms of all tasks added up, and the best split of each."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            held = sums.setdefault(row["slot"], np.zeros((2, n_chosen, BINS), np.int64))
            for k, name in enumerate("gh"):
                held[k] += np.frombuffer(row[name], np.int64).reshape(n_chosen, BINS)
    names = ["gain", "feature", "bin", "missing_left", "lg", "lh", "g", "h"]
    for slot, (g, h) in sums.items():
        found = best_split(g * unit, h.astype(np.float64), params)
        yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int32())} | {
            n: pa.array([v], pa.int32() if n in ("feature", "bin") else pa.bool_() if n == "missing_left" else pa.float64())
            for n, v in zip(names, found)
        })


_SPLIT = "slot int, gain double, feature int, bin int, missing_left boolean, lg double, lh double, g double, h double"


class _Growing:
    """A tree while it grows, as lists."""

    def __init__(self):
        self.feature, self.bin, self.cut, self.missing_left, self.left, self.gain = [-1], [0], [0.0], [False], [0], [0.0]
        self.stats = [(0.0, 0.0)]

    def split(self, node: int, feature: int, row, cut: float) -> list[int]:
        self.feature[node], self.bin[node], self.cut[node] = feature, row.bin, cut
        self.missing_left[node], self.gain[node], self.left[node] = row.missing_left, row.gain, len(self.feature)
        for stats in ((row.lg, row.lh), (row.g - row.lg, row.h - row.lh)):
            for values, empty in ((self.feature, -1), (self.bin, 0), (self.cut, 0.0), (self.missing_left, False), (self.left, 0), (self.gain, 0.0)):
                values.append(empty)
            self.stats.append(stats)
        return [self.left[node], self.left[node] + 1]

    def prune(self, least: float) -> None:
        """Undo, from below, splits of two leaves that gain less than ``least``."""
        for node in range(len(self.feature) - 1, -1, -1):
            if self.feature[node] >= 0 and self.gain[node] < least and all(self.feature[self.left[node] + k] < 0 for k in (0, 1)):
                self.feature[node], self.gain[node] = -1, 0.0

    def tree(self, params: Boosting) -> Tree:
        g, h = np.array(self.stats).T
        value = -params.rate * np.sign(g) * np.maximum(np.abs(g) - params.l1, 0) / np.maximum(h + params.l2, _EPS)
        feature = np.array(self.feature)
        return Tree(
            feature, np.array(self.bin), np.array(self.cut), np.array(self.missing_left), np.array(self.left),
            np.where(feature < 0, value, 0.0), np.array(self.gain),
        )


@dataclasses.dataclass
class BoostedTrees:
    """A fitted model. Its trees, at most ``trees * 2 ** (depth + 1)`` nodes, travel with the job that predicts."""

    base: float
    trees: list[Tree]
    features: tuple[str, ...]

    def values(self, columns: np.ndarray) -> np.ndarray:
        """Predictions of (features, rows); NaN is missing."""
        missing = np.isnan(columns)
        out = np.full(columns.shape[1], self.base)
        for tree in self.trees:
            out += tree.value[tree.leaf_of(columns, missing, tree.cut)]
        return out

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """Add the prediction to a feature table; Arrow batches, in parallel."""

        @F.pandas_udf("double")
        def scored(*columns: pd.Series) -> pd.Series:
            return pd.Series(self.values(np.array([c.to_numpy(np.float64, na_value=np.nan) for c in columns])))

        return df.withColumn(out, scored(*(F.col(f"`{f}`").cast("double") for f in self.features)))

    def importances(self, df: DataFrame, k: int = 5) -> DataFrame:
        """(feature, importance): the k features of the largest mean gain of their splits, as parts of their sum."""
        gain, count = np.zeros(len(self.features)), np.zeros(len(self.features))
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(gain, tree.feature[inner], tree.gain[inner])
            np.add.at(count, tree.feature[inner], 1)
        mean = gain / np.maximum(count, 1)
        parts = mean / (mean.sum() or 1.0)
        table = df.sparkSession.createDataFrame(
            [(f, float(w)) for f, w in zip(self.features, parts)], "feature string, importance double"
        )
        return table.orderBy(F.desc("importance"), "feature").limit(k)


def quantile_cuts(rows: DataFrame, columns: Sequence[str], bins: int = BINS, accuracy: int = 20_000) -> list[np.ndarray]:
    """Upper ends of at most ``bins`` - 2 bins of each column, from all rows; NaN and null are left out."""
    at = [i / (bins - 2) for i in range(1, bins - 2)]
    cuts = rows.agg(*(F.percentile_approx(F.when(~F.isnan(c), F.col(c)), at, accuracy).alias(c) for c in columns)).first()
    return [np.unique(np.array(cuts[c] or [], np.float64)) for c in columns]


@dataclasses.dataclass
class Prepared:
    """Training rows as written blocks of bins; several fits may share them."""

    blocks: DataFrame
    tasks: int
    cuts: list[np.ndarray]
    base: float
    unit: float
    features: tuple[str, ...]


def prepare(
    train: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET, key: Sequence[str] = (), seed: int = 42,
    cuts: list[np.ndarray] | None = None, bins: int = BINS, accuracy: int = 20_000,
) -> Prepared:
    """The rows that have a target. ``key`` tells rows apart for their draws (all features and the target, if not given);
    ``cuts`` fixes the bins' upper ends."""
    names = [f"x{i}" for i in range(len(features))]
    rows = train.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))).select(
        *(F.col(f"`{f}`").cast("double").alias(n) for f, n in zip(features, names)), F.col(target).cast("double").alias("y"),
        F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in key or [*features, target])).alias("draw"),
    )
    rows = staged(rows, "boost-rows")
    cuts = quantile_cuts(rows, names, bins, accuracy) if cuts is None else cuts
    y = rows.agg(F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"), F.count("y").alias("n")).first()
    if y.mean is None:
        raise ValueError("no row has a target")
    base = float(f"{y.mean:.12g}")  # the last digits of a mean depend on the order of its rows
    unit = (max(y.high - base, base - y.low) or 1.0) / FIXED
    tasks = -(-y.n // TASK_ROWS)  # few rows need few tasks: a job per level is short
    blocks = staged(rows.coalesce(tasks).mapInArrow(lambda it: _blocks(it, cuts), _BLOCK), "boost-blocks")
    return Prepared(blocks, tasks, cuts, base, unit, tuple(features))


def fit_boosted(
    train: DataFrame | Prepared, params: Boosting = Boosting(), features: Sequence[str] = FEATURES, target: str = TARGET,
    key: Sequence[str] = (), seed: int = 42, cuts: list[np.ndarray] | None = None, start: BoostedTrees | None = None,
) -> BoostedTrees:
    """Fit to the rows that have a target; see ``prepare``. Rows take part in a tree by a hash of their key, features by a
    draw of the driver. ``start`` is a model of fewer trees of the same parameters: its trees stay and more are grown.
    """
    ready = train if isinstance(train, Prepared) else prepare(train, features, target, key, seed, cuts)
    trees: list[Tree] = list(start.trees) if start else []
    n_features = len(ready.features)

    # Two folders in turn: one is read while the other is written.
    folders = [scratch_path(ready.blocks.sparkSession, "boost-margins") for _ in range(2)]

    def remargined(blocks: DataFrame, applied: list[Tree]) -> DataFrame:
        folders.reverse()
        return staged(blocks.mapInArrow(lambda it: _remargined(it, n_features, applied), _BLOCK), "boost-margins", folders[0])

    blocks = remargined(ready.blocks, [_constant(ready.base), *trees])
    partitions = min(ready.tasks, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    draw = random.Random(seed)
    written = len(trees)
    for number in range(params.trees):
        chosen = sorted(draw.sample(range(n_features), max(1, int(params.columns * n_features))))
        if number < len(trees):
            continue
        if number - written == APPLIED:
            blocks, written = remargined(blocks, trees[written:]), number
        growing, nodes = _Growing(), [0]
        for _ in range(params.depth):
            found = _level(blocks, partitions, n_features, trees[written:], growing.tree(params), nodes, chosen, number, ready.unit, params)
            children = []
            for row in sorted(found, key=lambda r: r.slot):
                node = nodes[row.slot]
                growing.stats[node] = (row.g, row.h)
                if row.feature >= 0:
                    feature = chosen[row.feature]
                    own = ready.cuts[feature]
                    children += growing.split(node, feature, row, float(own[row.bin]) if row.bin < len(own) else np.inf)
            nodes = children
            if not nodes:
                break
        growing.prune(params.gain)
        trees.append(growing.tree(params))
    return BoostedTrees(ready.base, trees, ready.features)


def _constant(value: float) -> Tree:
    one = np.zeros(1)
    return Tree(np.array([-1]), one, one, one.astype(bool), one.astype(int), np.array([value]), one)


def _level(blocks, partitions, n_features, trees, grown, nodes, chosen, number, unit, params) -> list[Row]:
    """The best split of each of ``nodes``: one row per node."""
    sums = blocks.mapInArrow(
        lambda it: _histograms(it, n_features, trees, grown, nodes, chosen, number, params.rows, unit), "slot int, g binary, h binary"
    )
    width = len(chosen)
    return sums.repartition(min(len(nodes), partitions), "slot").mapInArrow(lambda it: _splits(it, width, unit, params), _SPLIT).collect()
