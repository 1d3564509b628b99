"""Positions, medians and running values without a single-task window or an unbounded group.

* ``place``        cuts a totally ordered table at given row positions.
* ``first_k``      keeps the first k rows of that order.
* ``exact_median`` finds exact medians by histogram bisection.
* ``carry_forward``and ``running_position`` are running windows split by time bucket.

All of them count per bucket first (a small, map-side combined aggregate), work out from the
counts where the answer lies, and only then look at individual rows of the few buckets concerned.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .draws import DRAW_BITS, row_hash

BUCKET_BITS = 12
#: Rows among which a cut is looked for directly.
BOUND = 1 << 16
#: Digits of a digest: rows that share them all are copies.
DIGEST_DIGITS = 32
COPY_CHUNK = 1 << 16


@dataclasses.dataclass(frozen=True)
class Cut:
    """The row standing at a cut: the sort key it has, and where the cut lies in its copies."""

    lead: tuple
    hash: int
    digest: str
    below: int   # copies of the row before the cut
    copies: int
    tied: bool   # other rows have the same lead and hash


def _digest(names: Sequence[str]) -> Column:
    """Digest of a whole row; equal only for identical rows."""
    return F.md5(F.to_json(F.struct(*names)))


def find_cuts(
    df: DataFrame, cuts: Callable[[Column], Sequence[Column]], lead: Sequence[str], key: Sequence[str], seed: int, bound: int = BOUND,
    hashed: str | None = None,
) -> list[Cut]:
    """Rows at the cut positions, in order of position, by radix selection.

    Rows are counted by the first digits of their hash; only the bucket that holds a cut is counted again by its next digits,
    until at most ``bound`` rows, or only copies of one row, are left there. Two jobs, and one more for each 4,096-fold.
    """
    names, lead = [c for c in df.columns if c != hashed], list(lead)
    own = F.col(hashed) if hashed else row_hash(seed, *(key or names))
    rows = df.withColumn("_h", own).withColumn("_b", F.shiftright("_h", DRAW_BITS - BUCKET_BITS))

    # Counts per lead value and bucket, then first positions: all over small tables.
    counts = rows.groupBy(*lead, "_b").agg(F.count(F.lit(1)).alias("_m"))
    in_lead = Window.partitionBy(*lead).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_m").over(in_lead), F.lit(0)))
    sizes = counts.groupBy(*lead).agg(F.sum("_m").alias("_lead_m"))
    before = Window.orderBy(*lead or [F.lit(0)])
    offsets = sizes.select(
        *[F.col(c).alias(f"_l_{c}") for c in lead],
        F.coalesce(F.sum("_lead_m").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_lead_m").over(
            before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ).alias("_n"),
    )
    same = [starts[c].eqNullSafe(offsets[f"_l_{c}"]) for c in lead] or [F.lit(True)]
    first = F.col("_start") + F.col("_offset")
    wanted = F.array(*[F.struct(F.lit(j).alias("j"), p.cast("bigint").alias("p")) for j, p in enumerate(cuts(F.col("_n")))])
    buckets = (
        starts.join(offsets, same)
        .withColumn("_cut", F.explode(wanted))
        .where((F.col("_cut.p") >= first) & (F.col("_cut.p") < first + F.col("_m")))
        .select(*lead, "_b", "_cut.j", (F.col("_cut.p") - first).alias("_inside"), "_m")
        .collect()
    )
    if not buckets:
        return []

    # Narrow each bucket that is still too large by the next digits of the hash, then of the digest.
    shift = DRAW_BITS - BUCKET_BITS
    spots = [_Spot(tuple(k[c] for c in lead), k["_b"] << shift, ((k["_b"] + 1) << shift) - 1, "", k["j"], k["_inside"], k["_m"], False) for k in buckets]
    while any(s.rows > bound and not s.alike for s in spots):
        spots = _narrowed(rows, lead, names, spots, bound)

    # Copies of the few rows left collapse to one row with a count, then running counts.
    distinct = (
        _in_spots(rows, lead, names, spots)
        .groupBy("_spot", "_h", _digest(names).alias("_d"))
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    upto = Window.partitionBy("_spot").orderBy("_h", "_d").rowsBetween(Window.unboundedPreceding, -1)
    placed = distinct.withColumns(
        {
            "_from": F.coalesce(F.sum("_copies").over(upto), F.lit(0)),
            "_same": F.count(F.lit(1)).over(Window.partitionBy("_spot", "_h")),
        }
    )
    places = {place: i for i, place in enumerate(dict.fromkeys(s.place for s in spots))}
    inside = functools.reduce(
        lambda x, y: x | y,
        [(F.col("_spot") == places[s.place]) & (F.col("_from") <= s.inside) & (F.col("_from") + F.col("_copies") > s.inside) for s in spots],
    )
    found = placed.where(inside).collect()
    result = []
    for s in sorted(spots, key=lambda s: s.cut):
        for row in found:
            if row["_spot"] == places[s.place] and row["_from"] <= s.inside < row["_from"] + row["_copies"]:
                tied = row["_same"] > 1 or s.digest != ""  # a digest is looked at only where a hash has many rows
                result.append(Cut(s.lead, row["_h"], row["_d"], s.inside - row["_from"], row["_copies"], tied))
    return result


@dataclasses.dataclass(frozen=True)
class _Spot:
    """Where a cut lies so far: rows of a lead value whose hash is in [low, high] and whose digest begins with ``digest``."""

    lead: tuple
    low: int
    high: int
    digest: str
    cut: int
    inside: int   # rows of the spot before the cut
    rows: int
    alike: bool   # all rows are copies of one

    @property
    def place(self) -> tuple:
        return self.lead, self.low, self.high, self.digest


def _in_spots(rows: DataFrame, lead: Sequence[str], names: Sequence[str], spots: Sequence[_Spot]) -> DataFrame:
    """The rows of any spot, with the spot's number; spots are equal or apart."""
    spot = F.lit(None).cast("int")
    for i, (values, low, high, digest) in enumerate(dict.fromkeys(s.place for s in spots)):
        here = F.col("_h").between(low, high)
        for c, v in zip(lead, values):
            here &= F.col(c).eqNullSafe(F.lit(v))
        if digest:
            here &= F.startswith(_digest(names), F.lit(digest))
        spot = F.when(here, F.lit(i)).otherwise(spot)
    return rows.withColumn("_spot", spot).where(F.col("_spot").isNotNull())


def _narrowed(rows: DataFrame, lead: Sequence[str], names: Sequence[str], spots: list[_Spot], bound: int) -> list[_Spot]:
    """Spots of more than ``bound`` rows cut down to the part, one in 2**BUCKET_BITS, that holds their cut. One job.

    Parts are ranges of the hash, or three digits of the digest once a spot has one hash. The driver gets a count per part.
    """
    large = [s for s in spots if s.rows > bound and not s.alike]
    part = F.lit(None).cast("string")
    digits = len(f"{(1 << BUCKET_BITS) - 1:x}")
    for i, (_, low, high, digest) in enumerate(dict.fromkeys(s.place for s in large)):
        shift = max(0, (high - low).bit_length() - BUCKET_BITS)
        by_hash = F.lpad(F.hex(F.shiftright(F.col("_h") - F.lit(low), shift)), digits, "0")
        own = by_hash if low < high else F.substring(_digest(names), len(digest) + 1, digits)
        part = F.when(F.col("_spot") == i, own).otherwise(part)
    counts = (
        _in_spots(rows, lead, names, large).withColumn("_part", part).groupBy("_spot", "_part")
        .agg(F.count(F.lit(1)).alias("_m"), F.min("_h").alias("_low"), F.max("_h").alias("_high"))
        .collect()
    )
    by_spot: dict[int, list] = {}
    for row in sorted(counts, key=lambda r: (r["_spot"], r["_part"])):
        by_spot.setdefault(row["_spot"], []).append(row)
    places = {place: i for i, place in enumerate(dict.fromkeys(s.place for s in large))}
    out = []
    for s in spots:
        if s not in large:
            out.append(s)
            continue
        before = 0
        for row in by_spot[places[s.place]]:
            if before + row["_m"] > s.inside:
                break
            before += row["_m"]
        digest = s.digest + row["_part"] if s.low == s.high else ""
        alike = len(digest) >= DIGEST_DIGITS
        out.append(_Spot(s.lead, row["_low"], row["_high"], digest, s.cut, s.inside - before, row["_m"], alike))
    return out


def place(
    df: DataFrame,
    cuts: Callable[[Column], Sequence[Column]],
    lead: Sequence[str] = (),
    key: Sequence[str] = (),
    seed: int = 42,
    out: str = "slot",
    bound: int = BOUND,
    hashed: str | None = None,
) -> DataFrame:
    """Add ``out``: how many of the cut positions lie at or before the row's 0-based position.

    The order is ``lead`` columns, then a hash of ``key`` (all columns when empty), then a digest
    of the row. ``cuts`` maps the row count to rising positions. Sizes are exact, also when many
    rows are identical copies. ``lead`` must have few distinct values (a month, say); the hash
    spreads the rows of one lead value over 4,096 buckets.

    Rows are never ranked: a few small jobs find the rows standing at the cuts, and the result is a
    map-only comparison with them. The input is read three times and once more for each narrowing, so pass a written table if it is
    expensive, and a key if it has many computed columns. ``hashed`` names a column that holds the ``row_hash`` of seed and key
    already: it is read in place of the key, takes no part in digests, and is left out of the result.
    """
    names, lead = [c for c in df.columns if c != hashed], list(lead)
    found = find_cuts(df, cuts, lead, key, seed, bound, hashed)
    if not found:
        return df.select(*names, F.lit(0).alias(out))
    # A digest is only needed where different rows share the hash of a cut, and only for those.
    rows = df.withColumn("_h", F.col(hashed) if hashed else row_hash(seed, *(key or names)))
    tied = [c.hash for c in found if c.tied]
    if tied:
        rows = rows.withColumn("_d", F.when(F.col("_h").isin(tied), _digest(names)))
    front, digest = F.struct(*lead, "_h"), F.col("_d")

    def at(cut: Cut) -> Column:
        values = [F.lit(v).cast(df.schema[c].dataType) for c, v in zip(lead, cut.lead)]
        return F.struct(*[v.alias(c) for v, c in zip(values, lead)], F.lit(cut.hash).cast("bigint").alias("_h"))

    passed = functools.reduce(
        lambda x, y: x + y,
        [
            ((front > at(c)) | ((front == at(c)) & (digest >= c.digest)) if c.tied else front >= at(c)).cast("int")
            for c in found
        ],
        F.lit(0),
    )
    divided = {(c.lead, c.hash, c.digest): c for c in found if c.below > 0}
    if not divided:
        return rows.select(*names, passed.alias(out))

    # A cut inside a group of identical rows: rebuild the group from its count, in chunks.
    def is_copy(c: Cut) -> Column:
        return F.coalesce((front == at(c)) & (digest == c.digest), F.lit(False)) if c.tied else front == at(c)

    apart = functools.reduce(lambda x, y: x | y, [is_copy(c) for c in divided.values()])
    result = rows.where(~apart).select(*names, passed.alias(out))
    for spot, cut in divided.items():
        belows = [c.below for c in found if (c.lead, c.hash, c.digest) == spot]
        earlier = next(j for j, c in enumerate(found) if (c.lead, c.hash, c.digest) == spot)
        slot = functools.reduce(lambda x, y: x + y, [(F.col("_i") >= b).cast("int") for b in belows], F.lit(earlier))
        copies = (
            rows.where(is_copy(cut)).select(*names).limit(1)
            .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit((cut.copies - 1) // COPY_CHUNK))))
            .repartition("_chunk")
            .withColumn(
                "_i",
                F.explode(
                    F.sequence(
                        F.col("_chunk") * F.lit(COPY_CHUNK),
                        F.least(F.lit(cut.copies), (F.col("_chunk") + 1) * F.lit(COPY_CHUNK)) - 1,
                    )
                ),
            )
            .select(*names, slot.alias(out))
        )
        result = result.unionByName(copies)
    return result


def first_k(
    df: DataFrame, k: Callable[[Column], Column], key: Sequence[str] = (), seed: int = 42
) -> DataFrame:
    """Exactly ``k(n)`` rows in hash order, by a threshold instead of a sort."""
    placed = place(df, lambda n: [k(n)], key=key, seed=seed, out="_slot")
    return placed.where("_slot = 0").drop("_slot")


#: Groups whose bounds are sent to every task, and count cells that one pass sends to the driver.
FEW_GROUPS, CELLS = 4096, 1 << 16


def exact_median(df: DataFrame, group: Sequence[str], value: str, out: str, few: int = FEW_GROUPS) -> DataFrame:
    """Exact median of a BIGINT column per group; ``out`` is a double (mean of the two middles). Null groups are a group.

    Up to ``few`` groups by histogram bisection: each pass counts, per group, the values between the bounds found so far in
    equal bins, and keeps the bin that holds the middle, until it holds one value. Bounds are a broadcast table of at most two
    rows per group, counts at most ``CELLS`` rows, so no row is shuffled; passes grow with the logarithm of the range of values.
    Runs its jobs at once and reads the input once per pass, so pass a written table if it is expensive. More groups go by
    value ranges in two passes that shuffle the rows near the middle.
    """
    group = list(group)
    present = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("bigint").alias("_v"))
    spark, schema = df.sparkSession, present.select(*group).schema
    stats = present.groupBy(*group).agg(F.min("_v").alias("_l"), F.max("_v").alias("_h"), F.count(F.lit(1)).alias("_n"))
    found = [row for row in stats.limit(few + 1).collect() if row["_n"]]
    if len(found) > few:
        return _median_by_ranges(df, group, value, out)
    names = [tuple(row[c] for c in group) for row in found]
    # Two middles per group, each with its bounds and its place among the values between them.
    state = {(i, k): (row["_l"], row["_h"], (row["_n"] - (k == 0)) // 2) for i, row in enumerate(found) for k in (0, 1)}
    bounds_schema = T.StructType([*schema.fields, *(T.StructField(c, T.LongType()) for c in ("_i", "_l", "_h", "_w"))])
    while True:
        wide = sorted({(i, lo, hi) for (i, _), (lo, hi, _) in state.items() if lo < hi})
        if not wide:
            break
        bins = max(2, CELLS // len(wide))
        width = {w: -(-(w[2] - w[1] + 1) // bins) for w in wide}
        bounds = spark.createDataFrame([(*names[i], n, lo, hi, width[i, lo, hi]) for n, (i, lo, hi) in enumerate(wide)], bounds_schema)
        bounds = bounds.select(*(F.col(c).alias(f"_g{j}") for j, c in enumerate(group)), "_i", "_l", "_h", "_w")
        same = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_g{j}")) for j, c in enumerate(group)], F.lit(True))
        inside = present.join(F.broadcast(bounds), same & F.col("_v").between(F.col("_l"), F.col("_h")))
        kind = "bigint" if all(hi - lo < 1 << 63 for _, lo, hi in wide) else "decimal(20,0)"
        part = F.expr(f"(cast(_v as {kind}) - _l) div _w")
        counts: dict[int, list] = {}
        for row in inside.groupBy("_i", part.alias("_b")).agg(F.count(F.lit(1)).alias("_m")).collect():
            counts.setdefault(row["_i"], []).append((row["_b"], row["_m"]))
        at = {w: n for n, w in enumerate(wide)}
        for (i, k), (lo, hi, rank) in list(state.items()):
            if lo == hi:
                continue
            for b, m in sorted(counts[at[i, lo, hi]]):
                if rank < m:
                    break
                rank -= m
            step = width[i, lo, hi]
            state[i, k] = lo + b * step, min(hi, lo + (b + 1) * step - 1), rank
    rows = [(*name, (state[i, 0][0] + state[i, 1][0]) / 2) for i, name in enumerate(names)]
    # At most ``few`` rows: a join with them must not deal the rows of a large table by a few groups.
    return F.broadcast(spark.createDataFrame(rows, T.StructType([*schema.fields, T.StructField(out, T.DoubleType())])))


MEDIAN_SHIFT = 14


def _median_by_ranges(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """The median for any number of groups.

    First pass: counts per value range. Second pass: only rows in the range that holds the middle,
    at most 2**14 distinct values of it per group, whatever the size of the group.
    """
    group = list(group)
    present = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_v"))
    span = F.shiftright("_v", MEDIAN_SHIFT)
    counts = present.groupBy(*group, span.alias("_s")).agg(F.count(F.lit(1)).alias("_m"))
    order = Window.partitionBy(*group).orderBy("_s")
    ranges = (
        counts.withColumn(
            "_start", F.coalesce(F.sum("_m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )
        .withColumn("_n", F.sum("_m").over(Window.partitionBy(*group)))
        .withColumn("_lo", F.expr("(_n - 1) div 2"))
        .withColumn("_hi", F.expr("_n div 2"))
        .where("_start <= _hi and _start + _m > _lo")
        .select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_s").alias("_gs"), "_start", "_lo", "_hi")
    )
    same = [present[c].eqNullSafe(ranges[f"_g_{c}"]) for c in group] + [
        F.shiftright(present["_v"], MEDIAN_SHIFT) == ranges["_gs"]
    ]
    values = (
        present.join(ranges, same)
        .groupBy(*group, "_gs", "_v", "_start", "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = Window.partitionBy(*group, "_gs").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    middles = values.withColumn(
        "_from", F.col("_start") + F.coalesce(F.sum("_c").over(upto), F.lit(0))
    ).withColumn("_to", F.col("_from") + F.col("_c"))
    low = F.when((F.col("_from") <= F.col("_lo")) & (F.col("_lo") < F.col("_to")), F.col("_v"))
    high = F.when((F.col("_from") <= F.col("_hi")) & (F.col("_hi") < F.col("_to")), F.col("_v"))
    return middles.groupBy(*group).agg(((F.max(low) + F.max(high)) / 2).alias(out))


def carry_forward(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: Column, out: str
) -> DataFrame:
    """Add ``out``: last non-null ``value`` strictly before the row within ``keys`` by ``order``.

    ``bucket`` must not decrease along ``order`` (a month of the timestamp). The window runs inside
    (keys, bucket), so one heavy key is spread over its buckets; values cross bucket borders
    through a table with one row per key and bucket. Key nulls match.
    """
    keys, order = list(keys), list(order)
    rows = df.withColumn("_bkt", bucket).withColumn("_val", value)
    inside = (
        Window.partitionBy(*keys, "_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    lasts = rows.groupBy(*keys, "_bkt").agg(
        F.max_by("_val", F.when(F.col("_val").isNotNull(), F.struct(*order))).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        F.col("_bkt").alias("_cb"),
        F.last("_last", ignorenulls=True).over(across).alias("_carried"),
    )
    here = rows.withColumn("_inside", F.last("_val", ignorenulls=True).over(inside))
    same = [here[k].eqNullSafe(carried[f"_c_{k}"]) for k in keys] + [
        here["_bkt"].eqNullSafe(carried["_cb"])
    ]
    return here.join(carried, same, "left").select(
        *df.columns, F.coalesce("_inside", "_carried").alias(out)
    )


def running_position(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], out: str
) -> DataFrame:
    """Add ``out``: 0-based position of the row within ``keys`` by ``order``; buckets as above."""
    keys, order = list(keys), list(order)
    rows = df.withColumn("_bkt", bucket)
    counts = rows.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_m"))
    across = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        F.col("_bkt").alias("_cb"),
        F.coalesce(F.sum("_m").over(across), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    here = rows.withColumn("_pos", F.row_number().over(inside) - 1)
    same = [here[k].eqNullSafe(offsets[f"_c_{k}"]) for k in keys] + [
        here["_bkt"].eqNullSafe(offsets["_cb"])
    ]
    return here.join(offsets, same).select(*df.columns, (F.col("_pos") + F.col("_offset")).alias(out))
