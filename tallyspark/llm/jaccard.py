"""Exact Jaccard join of documents by their word n-grams, with adaptive multi-match prefixes.

Tokens (hashes of word n-grams) stand in one global order, the rarest first. A set of n tokens that is to share
t = ceil(percent * n / 100) of them with another keeps, as its l-prefix, its first n - t + l tokens: two sets that link
have at least l tokens in common within their l-prefixes. So

* sets meet where their 1-prefixes share a token, and
* a set whose 1-prefix costs many candidates (the sum of its tokens' other holders) gets a longer prefix, l up to ``MOST``;
  a pair goes on to verification only with min(l, l') common tokens in its prefixes of that length.

The order is by counts in ``2 ** BITS`` hash buckets over all documents, as levels of one byte each: one table of fixed size
in every task. It steers cost only; any order gives the same links.

1. Equal sets collapse to one class; only classes go further.
2. Each token's holders are a star: all meet its smallest class. Verified pairs give components.
3. Tokens whose holders still span components: their holders meet ``HUBS`` holders drawn by hash.
4. Tokens that still span components: every holder outside the largest component meets all holders of other components,
   bounded inside the join by size and parity maps (both exact bounds). No holders of one component are paired, and no
   pair of different components that share a prefix token is left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .near import components, shingles
from .shared import Staging, mix, partitions, slices

WIDTH = 5
PERCENT = 80
BITS = 20
MOST = 16
HUBS = 8
#: Parity maps of 64 bits each per set: differing bits cannot outnumber differing tokens.
MAPS = 8
_MAPS = tuple(f"map{j}" for j in range(MAPS))
_BLOCK = 4096
_SALTS = (np.uint64(0x3C6EF372FE94F82B), np.uint64(0xA54FF53A5F1D36F1))


def _bucket(value: np.ndarray, bits: int) -> np.ndarray:
    return (value >> np.uint64(64 - bits)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of this task's tokens, by blocks of buckets; only buckets that are not empty."""
    counts = np.zeros(1 << bits, np.int64)
    for rows in slices(batches, "text"):
        counts += np.bincount(_bucket(shingles(rows.column("text"), width)[1], bits), minlength=1 << bits)
    for at in range(0, len(counts), _BLOCK):
        places = np.flatnonzero(counts[at : at + _BLOCK])
        if places.size:
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([at // _BLOCK], pa.int32()), "places": pa.array([places.astype("<u2").tobytes()], pa.binary()),
                "counts": pa.array([counts[at + places].astype("<i8").tobytes()], pa.binary()),
            })


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed counts of each block in this partition, four levels to a doubling."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, places, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "places", "counts"))):
            held = sums.setdefault(block, np.zeros(_BLOCK, np.int64))
            held[np.frombuffer(places, "<u2")] += np.frombuffer(counts, "<i8")
    for block, held in sums.items():
        level = np.round(4 * np.log2(1 + held)).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "level": pa.array([level.tobytes()], pa.binary())})


def rarity(docs: DataFrame, width: int = WIDTH, bits: int = BITS) -> np.ndarray:
    """Level of each of the ``2 ** bits`` buckets by its count of tokens of all documents: one byte a bucket."""
    counted = docs.select("text").mapInArrow(lambda it: _counted(it, width, bits), "block int, places binary, counts binary")
    n = partitions(docs.sparkSession)
    summed = counted.repartition(n, "block").mapInArrow(_levels, "block int, level binary")
    levels = np.zeros(1 << bits, np.uint8)
    for row in summed.collect():
        own = np.frombuffer(row.level, np.uint8)[: len(levels)]
        levels[row.block * _BLOCK : row.block * _BLOCK + len(own)] = own
    return levels


def _sums(row: np.ndarray, value: np.ndarray, n: int) -> list[np.ndarray]:
    """Two independent 64-bit sums that tell a row's set."""
    sums = np.zeros((2, n), np.uint64)
    for j, salt in enumerate(_SALTS):
        np.add.at(sums[j], row, mix(value ^ salt))
    return list(sums.view(np.int64))


def _signed(batches: Iterator[pa.RecordBatch], width: int, percent: int, most: int, bits: int, levels) -> Iterator[pa.RecordBatch]:
    level = np.frombuffer(levels.value, np.uint8)
    for rows in slices(batches, "text"):
        n = rows.num_rows
        row, value = shingles(rows.column("text"), width)
        size = np.bincount(row, minlength=n)
        s1, s2 = _sums(row, value, n)
        parity = np.zeros(n * MAPS, np.uint64)
        np.bitwise_xor.at(parity, row * MAPS + ((value >> np.uint64(6)) % np.uint64(MAPS)).astype(np.int64), np.uint64(1) << (value & np.uint64(63)))
        parity = parity.view(np.int64).reshape(n, MAPS)
        # The longest prefix that may be asked for; sets that can match no other one have none.
        long = np.where(100 * size >= percent * (size + 1), np.minimum(size, size - -(-percent * size // 100) + most), 0)
        order = np.lexsort((value, level[_bucket(value, bits)], row))
        place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
        prefix = value[order][place < long[row]].view(np.int64)  # rows stay in place under the order
        ends = np.concatenate([[0], np.cumsum(long)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id").cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(s1), pa.array(s2),
             *[pa.array(parity[:, j]) for j in range(MAPS)], pa.ListArray.from_arrays(ends, prefix)],
            names=["doc_id", "n", "s1", "s2", *_MAPS, "prefix"],
        )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, "text"):
        row, value = shingles(rows.column("text"), width)
        n = rows.num_rows
        s1, s2 = _sums(row, value, n)
        ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), pa.ListArray.from_arrays(ends, value.view(np.int64))], names=["s1", "s2", "tokens"])


def ngram_join(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bits: int = BITS, most: int = MOST, hubs: int = HUBS
) -> tuple[DataFrame, DataFrame]:
    """The links found, (a, b) pairs of classes with their ``overlap`` and sizes, and every document's class and component.

    Links hold every link that is needed for the components; copies and members of one component are not expanded into
    all pairs. The second result has doc_id, n_shingles, class_id (smallest id with the same set), component_id.
    See ``linked_documents`` for what null, empty and repeated rows give.
    """
    staging = Staging(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    levels = docs.sparkSession.sparkContext.broadcast(rarity(read, width, bits).tobytes())  # 2 ** bits bytes
    signs = read.mapInArrow(
        lambda it: _signed(it, width, percent, most, bits, levels),
        "doc_id long, n long, s1 long, s2 long, " + ", ".join(f"{m} long" for m in _MAPS) + ", prefix array<long>",
    )
    signs = staging.table(signs, "join-signs")
    kept = ["n", "s1", "s2"]
    classes = signs.where("n > 0").groupBy(*kept).agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in (*_MAPS, "prefix")))
    classes = staging.table(classes.withColumn("c", F.monotonically_increasing_id()), "join-classes")
    rows = staging.table(signs.select("doc_id", *kept), "join-rows")
    staging.drop("join-signs")

    needed = f"(({percent} * n + 99) div 100)"
    keyed = classes.select("c", F.explode(F.expr(f"slice(prefix, 1, n - {needed} + 1)")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("holders"), F.min("c").alias("hub")).where("holders > 1")
    members = staging.table(keyed.join(shared, "key"), "join-members")
    cost = members.groupBy("c").agg(F.sum(F.col("holders") - 1).alias("cost"))
    # One more common token asked for with each doubling of the cost, as far as the set has them.
    match = F.expr(f"least({most}, {needed}, 1 + cast(floor(log2(cost)) as bigint))")
    able = classes.join(cost, "c").withColumn("l", match).drop("cost")
    facts = staging.table(able.withColumn("prefix", F.expr(f"slice(prefix, 1, cast(n - {needed} + l as int))")), "join-facts")
    classes = staging.table(classes.select("c", "id", *kept), "join-names")
    staging.drop("join-classes")

    def fits(x: str, y: str) -> str:
        """What sizes and parity maps allow; exact, no link is lost."""
        differ = " + ".join(f"bit_count({x}.{m} ^ {y}.{m})" for m in _MAPS)
        return (
            f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"
            f" and {100 + percent} * ({differ}) <= {100 - percent} * ({x}.n + {y}.n)"
        )

    def prefix(side: str) -> str:
        """The prefix of one side of a pair for l matches."""
        return f"slice(prefix_{side}, 1, cast(n_{side} - (({percent} * n_{side} + 99) div 100) + l as int))"

    held: list[DataFrame] = []

    def full_sets(ids: DataFrame, name: str) -> DataFrame:
        """(c, tokens) of all classes met so far; those not met before are read from one row with their id and sums."""
        for before in held:
            ids = ids.join(before.select("c"), "c", "left_anti")
        wanted = staging.table(ids.join(facts.select("c", "id", "s1", "s2"), "c"), f"{name}-wanted")
        ours = wanted.select("id").distinct()
        texts = read.join(ours, read["doc_id"].eqNullSafe(ours["id"]), "left_semi").select("text")
        sets = texts.mapInArrow(lambda it: _sets(it, width), "s1 long, s2 long, tokens array<long>")
        sets = sets.join(wanted.select("s1", "s2", "c"), ["s1", "s2"]).groupBy("c").agg(F.first("tokens").alias("tokens"))
        held.append(staging.table(sets, f"{name}-sets"))
        return functools.reduce(DataFrame.unionByName, held)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of distinct pairs (a, b) those that link: by bounds, by matches in the prefixes, then on the full sets."""
        bounds = facts.drop("prefix", "id", "s1", "s2")
        x, y = bounds.withColumnRenamed("c", "a").alias("x"), bounds.withColumnRenamed("c", "b0").alias("y")
        fit = pairs.join(x, "a").join(y, F.expr(f"b = b0 and {fits('x', 'y')}"))
        fit = fit.select("a", "b", F.least("x.l", "y.l").alias("l"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
        for side in "ab":
            fit = fit.join(facts.select(F.col("c").alias(side), F.col("prefix").alias(f"prefix_{side}")), side)
        matched = fit.where(F.expr(f"size(array_intersect({prefix('a')}, {prefix('b')})) >= l")).select("a", "b", "n_a", "n_b")
        matched = staging.table(matched, f"{name}-matched")
        sets = full_sets(matched.select(F.col("a").alias("c")).union(matched.select("b")).distinct(), name)
        full = matched.join(sets.select(F.col("c").alias("a"), F.col("tokens").alias("tokens_a")), "a")
        full = full.join(sets.select(F.col("c").alias("b"), F.col("tokens").alias("tokens_b")), "b")
        full = full.withColumn("overlap", F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long")).drop("tokens_a", "tokens_b")
        return staging.table(full.where(f"100 * overlap >= {percent} * (n_a + n_b - overlap)").select("a", "b", "n_a", "n_b", "overlap"), name)

    def ordered(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    ids = facts.select(F.col("c").alias("id"))

    def still_open(links: DataFrame, name: str) -> DataFrame:
        """Holders, with component and facts, of tokens whose holders span components."""
        comps = components(ids, links, f"{name}-comps").withColumnRenamed("id", "c")
        placed = members.select("key", "c").join(comps, "c")
        spread = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
        return staging.table(placed.join(spread, "key"), name)

    star = members.where("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct()
    links = verified(star, "join-star-links")
    open_ = still_open(links, "join-open")
    drawn = [F.min(F.struct(F.xxhash64("c", F.lit(i)).alias("draw"), "c", "comp")).alias(f"h{i}") for i in range(hubs)]
    met = open_.groupBy("key").agg(*drawn).select("key", F.explode(F.array(*(f"h{i}" for i in range(hubs)))).alias("h"))
    met = met.select("key", F.col("h.c").alias("hub"), F.col("h.comp").alias("main")).distinct()
    pairs = open_.join(met, "key").where("comp <> main").select(*ordered("c", "hub")).distinct()
    links = links.unionByName(verified(pairs, "join-hub-links"))
    open_ = still_open(links, "join-open-after")
    largest = open_.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("held")).groupBy("key").agg(F.max(F.struct("held", "comp")).alias("m"))
    open_ = staging.table(open_.join(facts.select("c", "n", *_MAPS), "c"), "join-spanning")
    outside = open_.join(largest.select("key", F.col("m.comp").alias("main")), "key").where("comp <> main").drop("main")
    pairs = outside.alias("x").join(open_.alias("y"), F.expr(f"x.key = y.key and x.comp <> y.comp and {fits('x', 'y')}"))
    pairs = pairs.select(*ordered("x.c", "y.c")).distinct()
    links = links.unionByName(verified(pairs, "join-span-links")).dropDuplicates(["a", "b"])

    comps = components(ids, links, "join-final").withColumnRenamed("id", "c")
    smallest = comps.join(classes.select("c", "id"), "c").groupBy("comp").agg(F.min("id").alias("component_id"))
    named = comps.join(smallest, "comp").select("c", "component_id")
    named = classes.select("c", "id", *kept).join(named, "c", "left").select(
        *kept, F.col("id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id")
    )
    out = rows.join(named, kept, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return links, out


def linked_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for each row of (doc_id, text).

    A set holds the distinct ``width``-word shingles, A-Z lowered, of the whole text, whatever its length; a text of fewer
    words is one shingle; a null text or one without words has none and links with nothing (its component is its own id).
    Documents link from ``percent`` percent Jaccard on; links are exact. component_id is the smallest id reachable. Every
    row is a document of its own: repeated rows link as equal sets do, rows that share an id but not a set are not tied.
    A null id takes the smallest id that its set or its links reach, null if there is none. Extra columns are not read;
    an empty table gives an empty one.
    """
    return ngram_join(docs, width, percent)[1]
