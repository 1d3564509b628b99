"""Histograms and population stability."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SMOOTH = 1e-8
ALERT, RETRAIN = 0.2, 0.25
MIN_VALUES = 10


def _add(terms: Sequence[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, terms)


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 0..bins-1: number of inner edges at or below the value; the last bin is closed.

    If all values are equal every edge is equal and the last bin takes them all.
    """
    step = (high - low) / F.lit(float(bins))
    return _add([(value >= low + F.lit(float(k)) * step).cast("int") for k in range(1, bins)])


def _bounds(df: DataFrame, columns: Sequence[str]) -> Column:
    """Scalar subquery: struct of (low, high) per column, from one aggregate."""
    row = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in columns],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in columns],
    )
    return row.select(F.struct(*row.columns)).scalar()


def shared_features(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> list[str]:
    """Features present in both tables; decided on the plan."""
    both = set(reference.columns) & set(current.columns)
    return [f for f in features if f in both]


def bin_counts(reference: DataFrame, current: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature, ref_counts, cur_counts) with shared equal-width edges.

    Two passes over (side, feature, value) rows: bounds per feature, then counts per feature. Both
    aggregate right after the unpivot, so a handful of rows per task is shuffled. The bounds have
    one row per feature name, which is why they may be broadcast.
    """
    names = shared_features(reference, current, features)
    if not names:
        raise ValueError("the tables share none of the features")
    side = [
        df.select(F.lit(flag).alias("side"), *[F.col(c).cast("double").alias(c) for c in names])
        for flag, df in ((0, reference), (1, current))
    ]
    values = side[0].unionByName(side[1]).unpivot(["side"], names, "feature", "value").where(F.col("value").isNotNull())
    bounds = values.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return (
        values.join(F.broadcast(bounds), "feature")
        .withColumn("bin", bin_of(F.col("value"), F.col("low"), F.col("high"), bins))
        .groupBy("feature", "side", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("feature")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.struct("side", "bin"), "n"))).alias("m"))
        .select(
            "feature",
            *[
                F.array(
                    *[
                        F.coalesce(F.col("m")[F.struct(F.lit(s).alias("side"), F.lit(k).alias("bin"))], F.lit(0))
                        for k in range(bins)
                    ]
                ).alias(name)
                for s, name in ((0, "ref_counts"), (1, "cur_counts"))
            ],
        )
    )


def psi(reference: DataFrame, current: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature, n_ref, n_cur, psi). Bins are added in order, so the result is reproducible."""
    counted = bin_counts(reference, current, features, bins)
    totals = counted.withColumns(
        {
            "n_ref": _add([F.col("ref_counts")[k] for k in range(bins)]),
            "n_cur": _add([F.col("cur_counts")[k] for k in range(bins)]),
        }
    )

    def portion(counts: str, total: str, k: int) -> Column:
        return (F.col(counts)[k] + F.lit(SMOOTH)) / (F.col(total) + F.lit(bins * SMOOTH))

    terms = []
    for k in range(bins):
        expected, actual = portion("ref_counts", "n_ref", k), portion("cur_counts", "n_cur", k)
        terms.append((actual - expected) * F.ln(actual / expected))
    return totals.select("feature", "n_ref", "n_cur", _add(terms).alias("psi"))


def drift_report(reference: DataFrame, current: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """PSI per feature with alert and retrain flags; with under 10 values on a side there is no PSI and no flag."""
    enough = (F.col("n_ref") >= MIN_VALUES) & (F.col("n_cur") >= MIN_VALUES)
    return psi(reference, current, features, bins).select(
        "feature", "n_ref", "n_cur", F.when(enough, F.col("psi")).alias("psi"), enough.alias("enough_values"),
        (enough & (F.col("psi") > ALERT)).alias("alert"), (enough & (F.col("psi") > RETRAIN)).alias("retrain"),
    )


def drift_summary(report: DataFrame) -> DataFrame:
    """One row: drift_detected, features that alert (and do not retrain), features that retrain."""

    def named(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, F.col("feature"))))

    return report.agg(
        F.coalesce(F.bool_or("retrain"), F.lit(False)).alias("drift_detected"),
        named(F.col("alert") & ~F.col("retrain")).alias("alert_features"),
        named(F.col("retrain")).alias("retrain_features"),
    )


def by_drift(report: DataFrame) -> DataFrame:
    """Largest PSI first."""
    return report.orderBy(F.desc_nulls_last("psi"), "feature")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, n) of equal-width bins, empty ones included."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"))
    bounds = _bounds(values, ["_v"])
    counted = (
        values.withColumn("_b", bounds)
        .groupBy(bin_of(F.col("_v"), F.col("_b")["lo__v"], F.col("_b")["hi__v"], bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_bin = counted.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    step = (F.col("_b")["hi__v"] - F.col("_b")["lo__v"]) / F.lit(float(bins))
    return (
        per_bin.withColumn("_b", bounds)
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .select(
            "bin",
            (F.col("_b")["lo__v"] + F.col("bin") * step).alias("low"),
            F.when(F.col("bin") == bins - 1, F.col("_b")["hi__v"])
            .otherwise(F.col("_b")["lo__v"] + (F.col("bin") + 1) * step)
            .alias("high"),
            F.coalesce(F.col("m")[F.col("bin")], F.lit(0)).alias("n"),
        )
    )
