"""Random forest of regression trees for tables whose rows Spark ML's forest cannot hold.

Feature values become bins once and rows become blocks of packed bins, as for boosted trees. A row is in a tree as often as a
Poisson draw of mean 1 says, a hash of the row and the tree; every node draws a third of the features. A level of all trees is
one job, or a few where it has many nodes: tasks add up counts and targets of their rows by (node, feature, bin), Spark adds
the tasks' sums by node, and the task that holds a node's sum finds its best split; the driver gets one row per node. Targets
are fixed-point integers, so trees do not depend on how rows are partitioned, if the bins do not.

Nodes of a tree are numbered as in a heap: the children of i are 2 i + 1 and 2 i + 2. A split lessens the summed squared
deviations of a node's targets; both sides keep ``leaf`` rows, copies counted.
"""

from __future__ import annotations

import dataclasses
import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosting import _unpacked, mixed, prepare

#: Bins of a feature, as in Spark ML.
BINS = 32
#: Rows whose trees are gone through together.
PAGE_ROWS = 1 << 16
#: Nodes of one job: a task holds their sums.
JOB_NODES = 12_800
#: Nodes of one task that adds up the sums of all tasks.
TASK_NODES = 1024
_LEAF = 255  # no bin is above it: rows of a leaf go on to the left
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
_EPS = 1e-6


def copies(draw: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is in a tree."""
    chance = mixed(draw, tree) * 2.0**-53
    found = np.zeros(len(draw), np.uint8)
    for below in _POISSON:
        found += chance >= below
    return found


def _walk(flat: np.ndarray, base: np.ndarray, feature: np.ndarray, bin_: np.ndarray, steps: int) -> np.ndarray:
    """Node of each row after so many steps; ``base`` is where the row's bins begin in ``flat``."""
    node = np.zeros(len(base), np.int64)
    for _ in range(steps):
        right = flat[base + feature[node]] > bin_[node]
        node += node
        node += 1
        node += right
    return node


def _pages(batches: Iterator[pa.RecordBatch], n_features: int):
    """(bins by row, targets, draws) of up to PAGE_ROWS rows and one block."""
    held, rows = [], 0
    for _, bins, y, draw, _ in _unpacked(batches, n_features):
        held.append((np.minimum(bins, BINS - 1).T, y, draw))
        rows += len(y)
        if rows >= PAGE_ROWS:
            yield tuple(np.concatenate(part) for part in zip(*held))
            held, rows = [], 0
    if held:
        yield tuple(np.concatenate(part) for part in zip(*held))


def _sums(
    batches: Iterator[pa.RecordBatch], n_features: int, level: int, trees: list[tuple], base: float, unit: float
) -> Iterator[pa.RecordBatch]:
    """One row per node with rows in this task: counts and summed targets by (drawn feature, bin).

    ``trees`` are (number, features and bins of its nodes so far, nodes of the level, their drawn features, first slot).
    """
    found = [np.zeros((2, drawn.shape[1], len(nodes) * BINS), np.int64) for _, _, _, nodes, drawn, _ in trees]
    for bins, y, draw in _pages(batches, n_features):
        flat, target = np.ascontiguousarray(bins).ravel(), np.rint((y - base) / unit)
        for (number, feature, bin_, nodes, drawn, _), sums in zip(trees, found):
            slot_of = np.full(len(feature), -1)
            slot_of[nodes] = np.arange(len(nodes))
            times = copies(draw, number)
            rows = np.flatnonzero(times)
            at = rows * n_features
            slot = slot_of[_walk(flat, at, feature, bin_, level)]
            here = np.flatnonzero(slot >= 0)
            rows, at, slot = rows[here], at[here], slot[here]
            weight = times[rows].astype(np.float64)
            weighed = weight * target[rows]
            cell = slot * BINS
            for j in range(drawn.shape[1]):
                own = cell + flat[at + drawn[slot, j]]
                for k, values in enumerate((weight, weighed)):
                    sums[k, j] += np.bincount(own, values, minlength=len(nodes) * BINS).astype(np.int64)
    for (_, _, _, nodes, drawn, first), sums in zip(trees, found):
        sums = sums.reshape(2, drawn.shape[1], len(nodes), BINS)
        held = np.flatnonzero(sums[0, 0].sum(axis=1))
        if held.size:
            packed = [[sums[k, :, s].tobytes() for s in held] for k in (0, 1)]
            slots = pa.array((held + first).astype(np.int32))
            yield pa.RecordBatch.from_arrays([slots, *(pa.array(p, pa.binary()) for p in packed)], names=["slot", "n", "y"])


def best_split(n: np.ndarray, y: np.ndarray, leaf: float) -> tuple:
    """(deviations lessened by, feature slot, bin, left n, left y, n, y) of a node's best split, by (feature, bin); -1: none.

    Ties: the first feature, the first bin.
    """
    all_n, all_y = float(n[0].sum()), float(y[0].sum())
    left_n, left_y = n.cumsum(axis=1)[:, :-1], y.cumsum(axis=1)[:, :-1]
    right_n, right_y = all_n - left_n, all_y - left_y
    change = left_y**2 / np.maximum(left_n, 1) + right_y**2 / np.maximum(right_n, 1) - all_y**2 / max(all_n, 1)
    change[(left_n < max(leaf, 1)) | (right_n < max(leaf, 1))] = 0
    f, b = np.unravel_index(np.argmax(change), change.shape)
    if change[f, b] <= _EPS:
        return 0.0, -1, -1, 0.0, 0.0, all_n, all_y
    return float(change[f, b]), int(f), int(b), float(left_n[f, b]), float(left_y[f, b]), all_n, all_y


def _splits(batches: Iterator[pa.RecordBatch], n_drawn: int, unit: float, leaf: float) -> Iterator[pa.RecordBatch]:
    """The nodes' sums of all tasks added up, and the best split of each."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            held = sums.setdefault(row["slot"], np.zeros((2, n_drawn, BINS), np.int64))
            for k, name in enumerate("ny"):
                held[k] += np.frombuffer(row[name], np.int64).reshape(n_drawn, BINS)
    if sums:
        found = zip(*((slot, *best_split(n.astype(np.float64), y * unit, leaf)) for slot, (n, y) in sums.items()))
        kinds = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
        names = ["slot", "gain", "feature", "bin", "ln", "ly", "n", "y"]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found, kinds)], names=names)


_SPLIT = "slot int, gain double, feature int, bin int, ln double, ly double, n double, y double"


@dataclasses.dataclass
class Forest:
    """A fitted model: by (tree, node) the feature and bin split at, the value, and the deviations the split lessens."""

    cuts: list[np.ndarray]
    depth: int
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    features: tuple[str, ...]

    def values(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Predictions of rows given by (features, rows)."""
        bins = np.stack([np.searchsorted(own, x, side="left") for own, x in zip(self.cuts, columns)], axis=1).astype(np.uint8)
        base = np.arange(len(bins)) * len(self.features)
        out = np.zeros(len(bins))
        for feature, bin_, value in zip(self.feature, self.bin, self.value):
            out += value[_walk(bins.ravel(), base, feature, bin_, self.depth)]
        return out / len(self.feature)

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """Add the prediction to a feature table; Arrow batches, in parallel."""

        @F.pandas_udf("double")
        def scored(*columns: pd.Series) -> pd.Series:
            return pd.Series(self.values([c.to_numpy(np.float64) for c in columns]))

        return df.withColumn(out, scored(*(_number(f) for f in self.features)))

    def importances(self, df: DataFrame, k: int = 5) -> DataFrame:
        """(feature, importance): the k features whose splits lessen the most of a tree's deviations, each tree in parts of its sum."""
        total = np.zeros(len(self.features))
        for feature, gain in zip(self.feature, self.gain):
            own = np.bincount(feature, gain, minlength=len(total))
            total += own / (own.sum() or 1.0)
        parts = total / (total.sum() or 1.0)
        table = df.sparkSession.createDataFrame(
            [(f, float(w)) for f, w in zip(self.features, parts)], "feature string, importance double"
        )
        return table.orderBy(F.desc("importance"), "feature").limit(k)


def _number(feature: str):
    return F.coalesce(F.col(f"`{feature}`").cast("double"), F.lit(0.0))


def grow(
    train: DataFrame, trees: int, depth: int, leaf: float, features: Sequence[str], target: str, seed: int, key: Sequence[str] = ()
) -> Forest:
    """Fit to the rows that have a target; a null feature is 0. ``key`` tells rows apart for their draws (all features and the
    target, if not given)."""
    ready = prepare(
        train.withColumns({f: _number(f) for f in features}), features, target, key, seed, bins=BINS + 2, accuracy=2_000
    )
    n_features, spark = len(features), train.sparkSession
    # Every task sends the sums of all nodes, so there are no more tasks than run at a time.
    blocks = ready.blocks.coalesce(spark.sparkContext.defaultParallelism)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = 2 ** (depth + 1) - 1
    model = Forest(
        ready.cuts, depth, np.zeros((trees, size), np.int64), np.full((trees, size), _LEAF, np.uint8),
        np.full((trees, size), ready.base), np.zeros((trees, size)), tuple(features),
    )
    n_drawn = n_features if trees == 1 else -(-n_features // 3)
    draw = random.Random(seed)
    growing = {tree: [0] for tree in range(trees)}
    for level in range(depth):
        drawn = {tree: np.array([draw.sample(range(n_features), n_drawn) for _ in nodes]) for tree, nodes in growing.items()}
        jobs: list[list[int]] = [[]]
        for tree, nodes in growing.items():
            if jobs[-1] and sum(len(growing[t]) for t in jobs[-1]) + len(nodes) > JOB_NODES:
                jobs.append([])
            jobs[-1].append(tree)
        after: dict[int, list[int]] = {}
        for job in jobs:
            spots = [(tree, i) for tree in job for i in range(len(growing[tree]))]
            starts = np.cumsum([0, *(len(growing[tree]) for tree in job)])
            given = [(t, model.feature[t], model.bin[t], growing[t], drawn[t], int(s)) for t, s in zip(job, starts)]
            found = _level(blocks, min(partitions, -(-len(spots) // TASK_NODES)), n_features, level, given, n_drawn, ready.base, ready.unit, leaf)
            for row in sorted(found, key=lambda r: r.slot):
                tree, i = spots[row.slot]
                node = growing[tree][i]
                model.value[tree, node] = ready.base + row.y / row.n
                if row.feature < 0:
                    continue
                model.feature[tree, node], model.bin[tree, node] = drawn[tree][i][row.feature], row.bin
                model.gain[tree, node] = row.gain
                model.value[tree, 2 * node + 1] = ready.base + row.ly / row.ln
                model.value[tree, 2 * node + 2] = ready.base + (row.y - row.ly) / (row.n - row.ln)
                after.setdefault(tree, []).extend((2 * node + 1, 2 * node + 2))
        growing = after
        if not growing:
            break
    for node in range(size // 2):  # rows of a leaf end in its leftmost node
        ended = model.bin[:, node] == _LEAF
        model.value[ended, 2 * node + 1] = model.value[ended, node]
    return model


def _level(blocks, partitions, n_features, level, trees, n_drawn, base, unit, leaf) -> list:
    """The best split of each of the trees' nodes: one row per node."""
    sums = blocks.mapInArrow(lambda it: _sums(it, n_features, level, trees, base, unit), "slot int, n binary, y binary")
    return sums.repartition(partitions, "slot").mapInArrow(lambda it: _splits(it, n_drawn, unit, leaf), _SPLIT).collect()
