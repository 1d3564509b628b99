"""Isolation forest (Liu, Ting, Zhou 2008): anomalies are isolated by few random cuts.

Every tree draws its own few hundred rows out of the whole table; scoring runs over the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.draws import row_hash
from ..sources.tables import staged

EULER_GAMMA = 0.5772156649015329
NODES = "tree int, node int, feature int, cut double, `left` int, `right` int, depth double, sample int"


def mean_depth(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long_tail = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long_tail))


def grow(points: np.ndarray, seed: int) -> pd.DataFrame:
    """Nodes of one tree; leaves have feature -1 and the expected depth of their points."""
    rng = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes: list[list] = [[-1, 0.0, -1, -1, 0.0]]
    work = [(0, np.arange(len(points)), 0)]
    while work:
        node, rows, depth = work.pop()
        block = points[rows]
        low, high = block.min(axis=0), block.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes[node][4] = depth + float(mean_depth(len(rows)))
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = block[:, feature] < cut
        if not goes_left.any():  # the draw hit the lowest value itself
            goes_left = block[:, feature] <= low[feature]
            cut = float(np.nextafter(low[feature], np.inf))
        left, right = len(nodes), len(nodes) + 1
        nodes += [[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]]
        nodes[node][:4] = [feature, cut, left, right]
        work += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "depth"])
    out.insert(0, "node", np.arange(len(out)))
    return out


def _tree_places(df: DataFrame, names: Sequence[str], trees: int, seed: int, key: Sequence[str], below: int) -> DataFrame:
    """(tree, _h, features, _n): per tree the rows whose 52-bit place is less than ``below``; equal ones as one row."""
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names]
    rows = df.select(row_hash(seed, *(key or names)).alias("_row"), *numbers)

    def place(tree):
        return F.struct(tree.alias("tree"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), tree, F.col("_row")), 12).alias("_h"))

    near = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), place), lambda p: p["_h"] < below)
    return rows.select(F.inline(near), *names).groupBy("tree", "_h", *names).agg(F.count(F.lit(1)).alias("_n"))


def draw_rows(
    df: DataFrame, features: Sequence[str], trees: int, rows_per_tree: int, seed: int = 42, key: Sequence[str] = ()
) -> DataFrame:
    """(tree, _h, features, _take): for every tree the rows of the whole table with the smallest places.

    A row's place in a tree is a hash of ``key`` (the features if empty) and the tree, so trees draw independently of each
    other, of partitions and of retries. Only rows below a bound are shuffled, about 1.5 times as many as are wanted; where a
    tree finds too few of them, the bound is widened, up to the whole table, so the draw is exact. Rows with equal key and
    features have one place: they are counted before the shuffle and drawn together, as many of them as there is room for.
    """
    names = list(features)
    n_rows = df.count()
    wanted = min(rows_per_tree, n_rows)
    share = (rows_per_tree + 8.0 * math.sqrt(rows_per_tree) + 64.0) / max(n_rows, 1)
    while True:
        below = min(1 << 52, math.ceil(share * (1 << 52)))
        near = staged(_tree_places(df, names, trees, seed, key, below), "places")
        full = near.groupBy("tree").agg(F.sum("_n").alias("n")).where(F.col("n") >= wanted).count()
        if full == trees or below == 1 << 52:
            break
        share *= 4.0
    before = Window.partitionBy("tree").orderBy("_h", *names).rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(rows_per_tree) - F.coalesce(F.sum("_n").over(before), F.lit(0))
    return near.withColumn("_take", F.least("_n", room)).where(F.col("_take") > 0).drop("_n")


def fit_forest(
    df: DataFrame, features: Sequence[str], trees: int = 100, rows_per_tree: int = 256, seed: int = 42,
    key: Sequence[str] = (),
) -> DataFrame:
    """Node table of the forest: at most ``trees * (2 * rows_per_tree - 1)`` rows. An empty table gives no nodes.

    Every tree draws ``rows_per_tree`` rows of the whole table (``draw_rows``) and grows in one task.
    """
    names = list(features)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_h", *names])
        tree = int(group["tree"].iloc[0])
        points = np.repeat(group[names].to_numpy(float), group["_take"].to_numpy(), axis=0)
        nodes = grow(points, seed * 100_003 + tree)
        nodes.insert(0, "tree", tree)
        return nodes.assign(sample=len(points))

    drawn = draw_rows(df, names, trees, rows_per_tree, seed, key)
    return staged(drawn.groupBy("tree").applyInPandas(fit, NODES), "forest")


def isolation_score(
    df: DataFrame, forest: DataFrame, features: Sequence[str], out: str = "isolation"
) -> DataFrame:
    """Add ``out`` in (0, 1): ``2 ** (-mean depth / c(sample))``, higher is more anomalous.

    The node table is bounded by the forest's size, not by the data, so it is shipped to all tasks.
    """
    names = list(features)
    nodes = forest.toPandas().sort_values(["tree", "node"], ignore_index=True)
    starts = nodes.groupby("tree").size().cumsum().shift(fill_value=0)
    offset = nodes["tree"].map(starts).to_numpy()
    feature, cut, depth = (nodes[c].to_numpy() for c in ("feature", "cut", "depth"))
    left = np.where(feature >= 0, nodes["left"].to_numpy() + offset, -1)
    right = np.where(feature >= 0, nodes["right"].to_numpy() + offset, -1)
    roots = starts.to_numpy()
    scale = float(mean_depth(nodes["sample"].max())) or 1.0
    shipped = df.sparkSession.sparkContext.broadcast((feature, cut, left, right, depth, roots, scale))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feature, cut, left, right, depth, roots, scale = shipped.value
        for batch in batches:
            x = batch[names].to_numpy(dtype=float, na_value=0.0)
            total = np.zeros(len(x))
            index = np.arange(len(x))
            for root in roots:
                at = np.full(len(x), root)
                active = index[feature[at] >= 0]
                while len(active):
                    here = at[active]
                    goes_left = x[active, feature[here]] < cut[here]
                    at[active] = np.where(goes_left, left[here], right[here])
                    active = active[feature[at[active]] >= 0]
                total += depth[at]
            yield batch.assign(**{out: np.exp2(-total / max(len(roots), 1) / scale)})

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    return df.mapInPandas(score, schema)
