"""Ledger to months: one row per user, category and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.money import cents

USER, CATEGORY, MONTH = "user_id", "category", "period"


def month_totals(transactions: DataFrame) -> DataFrame:
    """Sum, counts, weekend count, first-half spend and last time per (user, category, month).

    One pass over the ledger with map-side combine. Rows without category stay (the user's month
    total needs them); rows without user or date belong to no group.
    """
    when = F.col("transaction_date").cast("timestamp_ntz")
    money = cents("amount")
    rows = transactions.where(F.col(USER).isNotNull() & F.col("transaction_date").isNotNull()).select(
        F.col(USER).cast("string").alias(USER),
        F.col("category_name").alias(CATEGORY),
        F.trunc(when.cast("date"), "MM").alias(MONTH),
        money.alias("_c"),
        when.alias("_t"),
    )
    zero = F.lit(0).cast("bigint")
    return rows.groupBy(USER, CATEGORY, MONTH).agg(
        F.coalesce(F.sum("_c"), zero).alias("spend"),
        F.count("_c").alias("txn_count"),
        F.max("_t").alias("last_txn"),
        F.count_if(F.weekday("_t") >= 5).alias("weekend_txns"),
        F.coalesce(F.sum(F.when(F.dayofmonth("_t") <= 15, F.col("_c"))), zero).alias("mid_spend"),
    )


def monthly(transactions: DataFrame) -> DataFrame:
    """``month_totals`` with the user's month total over all categories; null categories dropped.

    The total is a window over month rows: at most one row per category of a user in a month.
    """
    user_month = Window.partitionBy(USER, MONTH)
    return (
        month_totals(transactions)
        .withColumn("total", F.sum("spend").over(user_month))
        .where(F.col(CATEGORY).isNotNull())
    )


def eligible_pairs(months: DataFrame, min_months: int = 3, min_txn: float = 2) -> DataFrame:
    """(user, category) pairs with enough months and enough transactions per month."""
    return (
        months.groupBy(USER, CATEGORY)
        .agg(F.count(F.lit(1)).alias("n_months"), F.sum("txn_count").alias("n_txn"))
        .select(USER, CATEGORY, "n_months", (F.col("n_txn") / F.col("n_months")).alias("avg_txn"))
        .where((F.col("n_months") >= min_months) & (F.col("avg_txn") >= min_txn))
    )


def keep_eligible(months: DataFrame, min_months: int = 3, min_txn: float = 2) -> DataFrame:
    """Month rows of eligible pairs."""
    return months.join(eligible_pairs(months, min_months, min_txn), [USER, CATEGORY], "left_semi")


def elevated_counts(months: DataFrame, first_row: int = 1, guard: bool = False) -> DataFrame:
    """Per (user, month): categories spending over 1.2 times their mean of up to 3 prior months."""
    from .features import history  # the flag shares its window with the features

    return (
        history(months, first_row=first_row, guard=guard)
        .groupBy(USER, MONTH)
        .agg(F.sum("elevated").alias("elevated_cat_count"))
    )
