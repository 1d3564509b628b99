"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two small collections of ``TENSOR`` groups of ``ROWS`` minhashes each are computed, 2 * TENSOR * ROWS hashes
in all. Every pair (group of the first, group of the second) is a table key of 2 * ROWS rows, so TENSOR**2
tables come from about the square root of the hashes they would need on their own. A pair of similarity s
meets in some table with probability (1 - (1 - s**ROWS)**TENSOR)**2: 0.9985 at 0.8, 0.99998 at 0.9.

1. Equal sets collapse to one class; classes of fewer shingles than can match another set go no further.
2. Each table bucket is a star: its members pair with its smallest class. Confirmed pairs give components.
3. What a star can miss are links between members of different components. In every bucket that still spans
   components, ``PIVOTS`` members drawn by hash meet the members of other components; that joins most of a large group
   of near copies. In buckets that span components even then, all members outside the largest component meet the
   members of other components, bounded inside the join. No pair of a bucket that could matter is left out, none
   of one component is made.
4. Pairs that sizes and parity maps leave (both exact bounds) are confirmed on the full sets of both texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import gram_hashes, lower_ascii, mix, slices, span_hashes, staged, text_bytes, word_spans

TENSOR = 10
ROWS = 3
PERCENT = 80
PIVOTS = 8
#: Parity maps of 64 bits each per set: differing bits cannot outnumber differing shingles.
MAPS = 8
_MAPS = tuple(f"map{j}" for j in range(MAPS))
_SEEDS = mix(np.arange(1, 2 * 64 * 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of all rows, distinct and in order; a text of fewer words is one shingle."""
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    start, end, doc = word_spans(data, offsets)
    words = span_hashes(data, start, end)
    grams = gram_hashes(words, width)
    inside = doc[width - 1 :] == doc[: max(0, len(doc) - width + 1)]
    row, value = doc[: len(grams)][inside], grams[inside]
    count = np.bincount(doc, minlength=len(column))
    short = np.flatnonzero((count > 0) & (count < width))
    if short.size:
        first = np.cumsum(count) - count
        whole = []
        for r in short:
            own = words[first[r] : first[r] + count[r]]
            whole.append(mix(gram_hashes(own, len(own)) + np.uint64(len(own)))[0])
        row, value = np.concatenate([row, short]), np.concatenate([value, np.array(whole, np.uint64)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if len(row):
        new = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])]
        row, value = row[new], value[new]
    return row, value


def signatures(row: np.ndarray, value: np.ndarray, n: int, tensor: int, rows: int) -> np.ndarray:
    """2 * tensor group hashes of each row with shingles (int64); rows without any hold zeros."""
    out = np.zeros((n, 2 * tensor), np.uint64)
    some, first = np.unique(row, return_index=True)
    if some.size == 0:
        return out.view(np.int64)
    for group in range(2 * tensor):
        joined = np.zeros(len(some), np.uint64)
        for k in range(rows):
            seed = _SEEDS[group * rows + k]
            hashed = (value ^ (seed >> np.uint64(7))) * seed
            hashed ^= hashed >> np.uint64(32)
            joined = mix(joined + np.minimum.reduceat(hashed, first) * np.uint64(2 * k + 3))
        out[some, group] = joined
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], width: int, tensor: int, rows_each: int) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text"):
        n = rows.num_rows
        row, value = shingles(rows.column("text"), width)
        size = np.bincount(row, minlength=n)
        sums = np.zeros((2, n), np.uint64)
        for j, salt in enumerate((np.uint64(0x1B873593CC9E2D51), np.uint64(0x52DCE729E6546B64))):
            np.add.at(sums[j], row, mix(value ^ salt))
        groups = signatures(row, value, n, tensor, rows_each)
        parity = np.zeros(n * MAPS, np.uint64)
        np.bitwise_xor.at(parity, row * MAPS + ((value >> np.uint64(6)) % np.uint64(MAPS)).astype(np.int64), np.uint64(1) << (value & np.uint64(63)))
        parity = parity.view(np.int64).reshape(n, MAPS)
        ends = np.arange(n + 1, dtype=np.int32) * (2 * tensor)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id").cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(sums[0].view(np.int64)),
             pa.array(sums[1].view(np.int64)), pa.ListArray.from_arrays(ends, groups.ravel()), *[pa.array(parity[:, j]) for j in range(MAPS)]],
            names=["doc_id", "n_shingles", "s1", "s2", "groups", *_MAPS],
        )


def _confirm(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(iter([batch]), "text_a", 1 << 20):
            sets = []
            for name in ("text_a", "text_b"):
                row, value = shingles(rows.column(name), width)
                sets.append((np.searchsorted(row, np.arange(rows.num_rows + 1)), value))
            keep = np.zeros(rows.num_rows, bool)
            (at_a, a), (at_b, b) = sets
            for i in range(rows.num_rows):
                x, y = a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both) and len(x) > 0
            yield pa.RecordBatch.from_arrays([rows.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])


def components(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(id, comp) of all nodes: the smallest id reachable. Labels move along links and then to the label's own label.

    Every round is a written table; the number of rounds grows with the logarithm of the longest chain of
    labels, not with a group's size.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-links")
    labels = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "id"), f"{name}-labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        moved = labels.join(seen.withColumnRenamed("a", "id"), "id", "left").select(
            "id", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("comp")
        )
        ahead = labels.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        moved = moved.join(ahead, "comp", "left").select("id", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp"))
        moved = staged(moved, f"{name}-labels")
        labels = moved.select("id", "comp")
        if moved.where("comp <> old").isEmpty():
            break
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = PERCENT, tensor: int = TENSOR, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of (doc_id, text).

    A set holds the distinct ``width``-word shingles, A-Z lowered; a text of fewer words is one shingle; a null
    text or one without words has no shingle and links with nothing (its component is its own id). Documents
    link from ``percent`` percent Jaccard on. Rows with one id are one node, compared by one of their texts. A null id has no component and is
    kept. Extra columns are not read; an empty table gives an empty one.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = staged(
        read.mapInArrow(
            lambda it: _sign(it, width, tensor, rows), "doc_id long, n_shingles long, s1 long, s2 long, groups array<long>, " + ", ".join(f"{m} long" for m in _MAPS)
        ),
        "near-signs",
    )
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = staged(
        some.groupBy("s1", "s2", "n_shingles", "groups", *_MAPS).agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("top")), "near-classes"
    )
    # A set of n shingles can match another one only if n / (n + 1) reaches the similarity.
    able = classes.where(F.expr(f"100 * n_shingles >= {percent} * (n_shingles + 1)"))
    pairs_of_groups = F.expr(
        f"flatten(transform(sequence(0, {tensor - 1}), i -> transform(sequence(0, {tensor - 1}), "
        f"j -> xxhash64(i, j, groups[i], groups[{tensor} + j]))))"
    )
    keyed = able.select("id", F.explode(pairs_of_groups).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("key", "pivot")
    members = staged(keyed.join(shared, "key"), "near-members")  # rows of buckets of two classes or more
    ids = members.select("id").distinct()
    texts = staged(read.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "near-texts")
    facts = classes.select("id", F.col("n_shingles").alias("n"), *_MAPS)

    def fits(x: str, y: str) -> str:
        """What size and parity maps allow; exact, no link is lost."""
        differ = " + ".join(f"bit_count({x}.{m} ^ {y}.{m})" for m in _MAPS)
        return (
            f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"
            f" and {100 + percent} * ({differ}) <= {100 - percent} * ({x}.n + {y}.n)"
        )

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), a < b, those that link; first by size and parity maps, then on the full sets."""
        one = pairs.join(facts.withColumnRenamed("id", "a"), "a").alias("x")
        two = facts.withColumnRenamed("id", "b0").alias("y")
        fit = one.join(two, F.expr(f"x.b = y.b0 and {fits('x', 'y')}")).select("x.a", "x.b")
        left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        both = fit.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return both.mapInArrow(lambda it: _confirm(it, width, percent), "a long, b long")

    tested = staged(members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "near-tested")
    links = staged(confirmed(tested), "near-links")

    def spanning(links: DataFrame, name: str) -> DataFrame:
        """Members, with component and facts, of buckets that still span components."""
        comps = staged(components(ids, links, name), f"{name}-components")
        placed = members.select("key", "id").join(comps, "id")
        spread = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
        return staged(placed.join(spread, "key").join(facts, "id"), f"{name}-open")

    # Members drawn by hash meet their bucket's members of other components.
    open_ = spanning(links, "near")
    drawn = [F.min(F.struct(F.xxhash64("id", F.lit(i)).alias("draw"), "id", "comp")).alias(f"p{i}") for i in range(PIVOTS)]
    pivots = open_.groupBy("key").agg(*drawn).select("key", F.explode(F.array(*(f"p{i}" for i in range(PIVOTS)))).alias("p"))
    pivots = pivots.select("key", F.col("p.id").alias("pivot"), F.col("p.comp").alias("main")).distinct()
    pairs = open_.join(pivots, "key").where("comp <> main")
    pairs = pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    fresh = staged(pairs.join(tested, ["a", "b"], "left_anti"), "near-tested")
    links = staged(links.unionByName(confirmed(fresh)), "near-links")
    tested = tested.unionByName(fresh)
    # What buckets still span after that: members outside the largest component meet all of other components.
    open_ = spanning(links, "near-again")
    largest = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"))
    outside = open_.join(largest.select("key", F.col("m.comp").alias("main")), "key").where("comp <> main").drop("main")
    pairs = outside.alias("x").join(open_.alias("y"), F.expr(f"x.key = y.key and x.comp <> y.comp and {fits('x', 'y')}"))
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    fresh = staged(pairs.join(tested, ["a", "b"], "left_anti"), "near-tested")
    links = links.unionByName(confirmed(fresh))
    # Rows that share an id but not a set tie their classes together.
    tied = classes.where("id < top").select("s1", "s2", "n_shingles", F.col("id").alias("a"))
    tied = some.select("doc_id", "s1", "s2", "n_shingles").join(tied, ["s1", "s2", "n_shingles"]).select("a", F.col("doc_id").alias("b")).where("a <> b")
    links = staged(links, "near-links")
    clash = some.groupBy("doc_id").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).where("x <> y").select("doc_id")
    extra = tied.join(clash.withColumnRenamed("doc_id", "b"), "b", "left_semi").select("a", "b")
    final = components(classes.select("id").distinct(), links.unionByName(extra), "near-final")
    named = classes.select("s1", "s2", "n_shingles", "id").join(final, "id").select("s1", "s2", "n_shingles", "comp")
    out = signed.drop("groups", *_MAPS).join(named, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id")))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
