"""Merchant descriptions for survey transactions."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.draws import digests, index, row_hashes, uniform

NO_MERCHANT = "STORE"
OTHER_CATEGORY = "Miscellaneous"
KEY = ("persona_id", "major_category", "period", "part")


def unit_regions(units: DataFrame) -> DataFrame:
    """(persona_id, region): name of the unit's region code; unknown or null is the default."""
    name = fixed.literal_map(fixed.REGIONS)[F.col("region").cast("int")]
    return units.select(
        F.col("NEWID").cast("string").alias("persona_id"),
        F.coalesce(name, F.lit(fixed.DEFAULT_REGION)).alias("region"),
    )


def merchant_pools(merchants: Mapping[str, Mapping[str, list[str]]] = fixed.MERCHANTS) -> dict[str, list[str]]:
    """"category|region" to the sorted distinct merchants: the region's own and the default ones."""
    return {
        f"{category}|{region}": sorted({*pool.get(region, pool.get("default", [])), *pool.get("default", [])})
        or [NO_MERCHANT]
        for category, pool in merchants.items()
        for region in fixed.REGIONS.values()
    }


def _ranked(
    persona: pa.Array, region: pa.Array, pools: Mapping[str, list[str]], categories: list[str], every: list[str], k: int, seed: str
) -> pa.Array:
    """Per persona, of every category, the ``k`` merchants of its pool with the least md5 of (seed, persona, category, merchant).

    ``every`` are the merchants of all pools.
    """
    at = {m: i for i, m in enumerate(every)}
    chosen = np.full((len(persona), len(categories), k), -1)
    persona = pc.fill_null(persona, "")  # no row meets a null
    names = region.to_pylist()
    for name in set(names):
        rows = np.flatnonzero([n == name for n in names])
        some = persona.take(pa.array(rows))
        for j, category in enumerate(categories):
            pool = pools[f"{category}|{name}"]
            keys = [digests(pc.binary_join_element_wise(some, f"{category}|{m}", "|"), [seed])[0].astype(np.uint64) for m in pool]
            high, low = (np.stack([(x[:, w] << np.uint64(32)) | x[:, w + 1] for x in keys]) for w in (0, 2))
            best = np.lexsort((low, high), axis=0)[:k].T
            chosen[rows, j, : best.shape[1]] = np.array([at[m] for m in pool])[best]
    sizes = (chosen >= 0).sum(axis=2).ravel()
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
        pa.array(every, pa.string()).take(pa.array(chosen[chosen >= 0])),
    )
    keys = pa.array(categories * len(persona), pa.string())
    return pa.MapArray.from_arrays(pa.array((np.arange(len(persona) + 1) * len(categories)).astype(np.int32)), keys, lists)


#: Columns that ``merchant_choices`` adds, and that of a purchase's draws.
CHOICES, DRAWS = ("region", "_pool", "_preferred"), "_draws"


def merchant_seeds(seed: int = 42) -> list[str]:
    """Seeds of the draws of a transaction: preferred or not, its merchant of either kind, number, state, city, layout."""
    return [f"{seed}{c}" for c in "qfastcl"]


def merchant_choices(
    rows: DataFrame,
    units: DataFrame,
    n_preferred: int = 3,
    merchants: Mapping[str, Mapping[str, list[str]]] = fixed.MERCHANTS,
    seed: int = 42,
    tasks: int | None = None,
) -> DataFrame:
    """Add the persona's region, the merchants of its category there, and its ``n_preferred`` ones of them, chosen by hash.

    They hang on persona and category alone: totals may get them before they are split into purchases. Preferred merchants are
    ranked once per unit and category, before the join, and per row only where the persona is no unit or the category has no pool
    of its own. The only shuffle is the join with the regions; with ``tasks`` units are dealt to as many as rows are.
    """
    pools = fixed.literal_map(merchant_pools(merchants))

    def ranked(pool: Column, category: Column) -> Column:
        hashed = F.sort_array(
            F.transform(
                pool,
                lambda m: F.concat_ws("|", F.md5(F.concat_ws("|", F.lit(f"{seed}p"), F.col("persona_id"), category, m)), m),
            )
        )
        return F.transform(F.slice(hashed, 1, n_preferred), lambda s: F.substring(s, 34, 1000))

    named = merchant_pools(merchants)
    categories, every = list(merchants), sorted({m for pool in named.values() for m in pool})

    @F.arrow_udf("map<string, array<string>>")
    def own(persona: pa.Array, region: pa.Array) -> pa.Array:
        return _ranked(persona, region, named, categories, every, n_preferred, f"{seed}p")

    regions = unit_regions(units)
    if tasks is not None:
        regions = regions.repartition(tasks)
    known = regions.withColumn("_own", own("persona_id", "region"))
    if tasks is not None:
        known = known.repartition(tasks, "persona_id")
    regional = rows.join(known, "persona_id", "left").withColumn(
        "region", F.coalesce("region", F.lit(fixed.DEFAULT_REGION))
    )
    pool = F.coalesce(
        pools[F.concat_ws("|", "major_category", "region")], pools[F.concat_ws("|", F.lit(OTHER_CATEGORY), "region")]
    )
    preferred = F.coalesce(F.col("_own")[F.col("major_category")], ranked(F.col("_pool"), F.col("major_category")))
    return regional.withColumn("_pool", pool).withColumn("_preferred", preferred).select(*rows.columns, *CHOICES)


def assign_merchants(
    txn: DataFrame,
    units: DataFrame | None = None,
    preferred_ratio: float = 0.7,
    n_preferred: int = 3,
    merchants: Mapping[str, Mapping[str, list[str]]] = fixed.MERCHANTS,
    seed: int = 42,
) -> DataFrame:
    """Add ``region`` and ``description``: merchant, store number, city and state in one of three layouts.

    A persona has ``n_preferred`` merchants per category (``merchant_choices``), which get ``preferred_ratio`` of its
    transactions. Without ``units`` the rows have their choices already. Every choice is a hash of the transaction's key, so
    nothing is grouped; hashes that came with the rows (``disaggregate``) are not found again.
    """
    rows = txn if units is None else merchant_choices(txn, units, n_preferred, merchants, seed)
    if DRAWS not in rows.columns:
        rows = rows.withColumn(DRAWS, row_hashes(merchant_seeds(seed), *KEY))

    def hashed(name: str) -> Column:
        return F.col(DRAWS)[f"{seed}{name}"]

    def pick(options: Column, name: str) -> Column:
        return F.get(options, index(F.size(options), hashed(name)))

    merchant = F.when(uniform(hashed("q")) < preferred_ratio, pick(F.col("_preferred"), "f")).otherwise(pick(F.col("_pool"), "a"))
    number = F.concat(F.lit("#"), F.lpad((F.lit(100) + index(9900, hashed("s"))).cast("string"), 4, "0"))
    states = fixed.literal_map(fixed.STATES)[F.col("region")]
    cities = F.coalesce(fixed.literal_map(fixed.CITIES)[F.col("_state")], F.array(F.lit(fixed.DEFAULT_CITY)))
    layout = index(3, hashed("l"))
    place = F.concat_ws(" ", "_city", "_state")
    text = (
        F.when(layout == 0, F.concat_ws(" ", "_merchant", "_number", place))
        .when(layout == 1, F.concat_ws(" ", "_merchant", "_number", "_state"))
        .otherwise(F.concat_ws(" ", "_merchant", place))
    )
    return (
        rows.withColumns({"_merchant": merchant, "_number": number, "_state": pick(states, "t")})
        .withColumn("_city", pick(cities, "c"))
        .withColumn("description", F.upper(text))
        .select(*(c for c in txn.columns if c not in CHOICES), "region", "description")
    )
