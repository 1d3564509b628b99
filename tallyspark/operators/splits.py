"""Splits and samples of exact size that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.order import first_k, place

SPLITS = ("train", "val", "test")


def _name(slot: str) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SPLITS]), F.col(slot) + 1)


def _share(n: Column, fraction: float) -> Column:
    # Truncation of a double product, so that 90 rows at 0.7 give 62.
    return F.floor(n.cast("double") * F.lit(fraction))


def split_by_time(
    df: DataFrame, time: str = "period", key: Sequence[str] = ("user_id", "category"),
    train: float = 0.7, val: float = 0.85, seed: int = 42,
) -> DataFrame:
    """Add ``split`` by position in time order; a period may straddle a cut. Ties by hash of key."""
    placed = place(df, lambda n: [_share(n, train), _share(n, val)], lead=[time], key=key, seed=seed)
    return placed.withColumn("split", _name("slot")).drop("slot")


def split_by_hash(
    df: DataFrame, key: Sequence[str] = (), train: float = 0.8, val: float = 0.9, seed: int = 42, hashed: str | None = None
) -> DataFrame:
    """Add ``split``: a random split of exact sizes. ``hashed`` names a column with the ``row_hash`` of seed and key, if there is one."""
    placed = place(df, lambda n: [_share(n, train), _share(n, val)], key=key, seed=seed, hashed=hashed)
    return placed.withColumn("split", _name("slot")).drop("slot")


def split_shuffled(df: DataFrame, key: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Random split 80/10/10 whose train part ends one row early.

    The first cut belongs to val: positions ``[0, 80%)`` are train, ``[80%, 90%]`` val, the rest
    test, the upper cut inclusive.
    """
    placed = place(df, lambda n: [_share(n, 0.8), _share(n, 0.9) + 1], key=key, seed=seed)
    return placed.withColumn("split", _name("slot")).drop("slot")


def ensure_split(df: DataFrame, time: str | None = None, key: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Keep an existing ``split``; else split by time if there is a time column, else at random."""
    if "split" in df.columns:
        return df
    if time is not None and time in df.columns:
        return split_by_time(df, time, key, seed=seed)
    return split_by_hash(df, key, seed=seed)


def part(df: DataFrame, split: str) -> DataFrame:
    """Rows of one split."""
    return df.where(F.col("split") == split)


def cap_sample(df: DataFrame, max_rows: int, key: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """At most ``max_rows`` train rows, a bound on what a model is fitted on; val and test stay whole."""
    train = first_k(part(df, "train"), lambda n: F.least(F.lit(max_rows), n), key=key, seed=seed)
    return train.unionByName(df.where(F.col("split") != "train"))


def sample_rows(df: DataFrame, n: int = 50, key: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """A seeded sample of ``n`` rows."""
    return first_k(df, lambda total: F.least(F.lit(n), total), key=key, seed=seed)
