"""Centroid clustering of integer vectors by equal-average equal-variance search.

Centroids stand sorted by the mean of their components. For a vector the scan begins at the centroid with the nearest
mean and goes outward. With L components, sums S, and deviations W = L * sum(x * x) - S * S, both exact integers,

    L * distance >= (S - S')**2 + (sqrt(W) - sqrt(W'))**2

so a centroid whose difference of means alone reaches the best distance ends the scan (all that follow lie further
out), and one whose means and deviations together exceed it is rejected; only the others get an exact integer distance.
Bounds are floating point with margins far above their errors and never reject an equal distance, so ties go to the
smaller number exactly.

A round is one pass over the vectors: each task holds the centroids (k x L integers, bounded by two parameters), adds up
its vectors by centroid, and emits k rows; Spark adds these, and k x L sums go to the driver. No vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .shared import Staging

SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
#: Components at or beyond this have squared distances that a long cannot hold for 64 of them.
LARGEST = 1 << 27
_BATCH = 4096


def _integers(batches: Iterator[pa.RecordBatch], scale: int, dimensions: int) -> Iterator[pa.RecordBatch]:
    """Ids and packed integers of the vectors that take part."""
    for batch in batches:
        vectors = batch.column("vector").cast(pa.list_(pa.float64()))
        width = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(width == dimensions)
        some = vectors.take(pa.array(rows))
        table = some.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dimensions)  # null: NaN
        with np.errstate(invalid="ignore", over="ignore"):
            table = np.floor(scale * table)
            good = (np.abs(table) < LARGEST).all(axis=1)  # neither NaN nor infinite
        table = table[good].astype("<i4")
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dimensions), len(table), [None, pa.py_buffer(table.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").cast(pa.int64()).take(pa.array(rows[good])), packed.cast(pa.binary())], names=["vec_id", "cells"]
        )


def integer_vectors(vectors: DataFrame, scale: int = SCALE, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, cells): the vectors of exactly ``dimensions`` finite components x, as 32-bit integers floor(scale * x)."""
    return vectors.mapInArrow(lambda it: _integers(it, scale, dimensions), "vec_id long, cells binary")


def _table(cells: pa.Array, dimensions: int) -> np.ndarray:
    """All vectors of a column of packed integers."""
    return np.frombuffer(b"".join(cells.to_pylist()), "<i4").reshape(len(cells), dimensions).astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the exact squared distance of each vector."""
    dimensions = vectors.shape[1]

    def moments(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = table.sum(axis=1).astype(np.float64)
        spread = table - total[:, None] / dimensions
        return total, np.sqrt(dimensions * np.einsum("ij,ij->i", spread, spread))

    order = np.argsort(centroids.sum(axis=1), kind="stable")
    total, deviation = moments(vectors)
    means, deviations = moments(centroids[order])
    n, k = len(vectors), len(centroids)
    best = np.full(n, np.iinfo(np.int64).max)
    number = np.full(n, k, np.int64)
    high = np.searchsorted(means, total)
    low = high - 1
    active = np.arange(n)
    padded = np.concatenate([[-np.inf], means, [np.inf]])
    while active.size:
        x, lo, hi = total[active], low[active], high[active]
        below, above = x - padded[lo + 1], padded[hi + 1] - x
        down = below <= above
        gap = np.where(down, below, above)
        # The nearest centroid left is too far by its mean alone: so are all others.
        limit = dimensions * best[active].astype(np.float64) * (1 + 1e-9) + 1
        go = gap * gap <= limit
        go &= np.isfinite(gap)
        active, lo, hi, down, gap, limit = active[go], lo[go], hi[go], down[go], gap[go], limit[go]
        at = np.where(down, lo, hi)
        low[active] -= down
        high[active] += ~down
        own, others = deviation[active], deviations[at]
        aside = np.maximum(np.abs(own - others) - 1e-9 * (own + others) - 1e-3, 0)
        close = gap * gap + aside * aside <= limit
        rows, which = active[close], order[at[close]]
        apart = vectors[rows] - centroids[which]
        distance = np.einsum("ij,ij->i", apart, apart)
        better = (distance < best[rows]) | ((distance == best[rows]) & (which < number[rows]))
        best[rows[better]], number[rows[better]] = distance[better], which[better]
    return number, best


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per centroid that has vectors in this task: their count, summed distance and summed components."""
    k, dimensions = centroids.shape
    count, far, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, _BATCH):
            vectors = _table(batch.column("cells").slice(at, _BATCH), dimensions)
            number, distance = nearest(vectors, centroids)
            by = np.argsort(number, kind="stable")
            held, first = np.unique(number[by], return_index=True)
            count[held] += np.bincount(number, minlength=k)[held]
            far[held] += np.add.reduceat(distance[by], first)
            total[held] += np.add.reduceat(vectors[by], first, axis=0)
    held = np.flatnonzero(count)
    sums = pa.ListArray.from_arrays(np.arange(len(held) + 1, dtype=np.int32) * dimensions, total[held].ravel())
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(count[held]), pa.array(far[held]), sums], names=["cluster", "n", "far", "sums"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _BATCH):
            some = batch.slice(at, _BATCH)
            number, distance = nearest(_table(some.column("cells"), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([some.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])


def gathered(kept: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Count, summed distance and component sums of each non-empty cluster: at most k rows of L numbers."""
    parts = kept.select("cells").mapInArrow(lambda it: _sums(it, centroids), "cluster int, n long, far long, sums array<long>")
    cells = parts.select("cluster", "n", "far", F.posexplode("sums").alias("at", "sum"))
    added = cells.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), F.sum("sum").alias("sum"))
    found: dict[int, tuple[int, int, list[int]]] = {}
    for r in sorted(added.collect()):
        found.setdefault(r.cluster, (r.n, r.far, []))[2].append(r.sum)
    return found


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS, seed: int = 3
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each row of (vec_id, vector) that takes part.

    Vectors take part if they have exactly ``dimensions`` components, none null or non-finite, and no integer
    floor(scale * x) of 2**27 or more in size, whose distances would not fit a long. The first centroids are the vectors
    with the smallest sha256 of ``seed:vec_id`` (ties: smaller integers first; a null id counts as empty text); with fewer
    vectors than clusters there are fewer centroids, with none the result is empty. Each round assigns every vector to
    its nearest centroid and moves every non-empty centroid to the floored mean. Repeated rows and repeated ids are
    vectors of their own, so an id has as many rows as it came with. Extra columns are not read.
    """
    staging = Staging(vectors.sparkSession)
    kept = staging.table(integer_vectors(vectors.select("vec_id", "vector"), scale, dimensions), "centroid-vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    cells = kept.withColumn("name", name).mapInArrow(
        lambda it: _unpacked(it, dimensions), "name string, cells array<int>"
    )
    first = cells.orderBy("name", "cells").limit(clusters).collect()
    if not first:
        return kept.selectExpr(
            "vec_id", "cast(null as int) as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256"
        )
    centroids = np.array([r.cells for r in first], np.int64)
    for _ in range(rounds):
        for number, (n, _, sums) in gathered(kept, centroids).items():
            centroids[number] = [s // n for s in sums]
    final = gathered(kept, centroids)
    far = {number: own[1] for number, own in final.items()}
    names = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in far}

    def looked_up(values: dict) -> F.Column:
        return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[F.col("cluster")]

    found = kept.mapInArrow(lambda it: _assigned(it, centroids), "vec_id long, cluster int, distance long")
    return found.select(
        "vec_id", "cluster", "distance", looked_up(far).cast("long").alias("cluster_inertia"),
        F.lit(sum(far.values())).cast("long").alias("inertia"), looked_up(names).alias("centroid_sha256"),
    )


def _unpacked(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.arange(batch.num_rows + 1, dtype=np.int32) * dimensions
        lists = pa.ListArray.from_arrays(ends, _table(batch.column("cells"), dimensions).astype(np.int32).ravel())
        yield pa.RecordBatch.from_arrays([batch.column("name"), lists], names=["name", "cells"])
