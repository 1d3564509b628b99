"""The 20 monthly trend features."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import (
    dollars, exact_mean, exact_pop_std, ratio, square,
)
from ..functions.order import exact_median
from ..sources.tables import staged
from .monthly import CATEGORY, MONTH, USER, monthly

# The features and their order in a model's input vector.
FEATURES = (
    "current_spend", "rolling_mean_1m", "rolling_mean_3m", "rolling_mean_6m",
    "rolling_std_3m", "rolling_std_6m", "deviation_ratio", "share_of_wallet",
    "hist_share_of_wallet", "txn_count", "hist_txn_count_mean", "avg_txn_size",
    "hist_avg_txn_size", "days_since_last_txn", "month_of_year", "spending_velocity",
    "weekend_txn_ratio", "total_monthly_spend", "elevated_cat_count", "budget_utilization",
)
TARGET = "next_month_spend"
MONEY = (
    "current_spend", "rolling_mean_1m", "rolling_mean_3m", "rolling_mean_6m", "rolling_std_3m",
    "rolling_std_6m", "hist_txn_count_mean", "avg_txn_size", "hist_avg_txn_size",
    "total_monthly_spend",
)
RATIOS = (
    "deviation_ratio", "share_of_wallet", "hist_share_of_wallet", "spending_velocity",
    "weekend_txn_ratio", "budget_utilization",
)
ELEVATED = 1.2


@dataclasses.dataclass(frozen=True)
class Variant:
    """How one feature set differs from another."""

    first_row: int = 1              # index of the first month with enough history
    floor: float = 1e-8             # smallest denominator of a ratio
    eligible: tuple | None = (3, 2)  # min months, min transactions per month; None keeps all
    elevated: str = "user_month"    # or "own_history": the category's own last 4 months
    elevated_from: int = 1
    elevated_guard: bool = False    # only where the prior mean is positive
    dated: bool = True              # False: rows carry a month only, no day


LEDGER = Variant()
SURVEY = Variant(first_row=3, eligible=None, elevated="own_history", dated=False)
SIMULATED = Variant(first_row=3, floor=0.01, eligible=None, elevated_from=3, elevated_guard=True)


def history(
    months: DataFrame,
    first_row: int = 1,
    guard: bool = False,
    floor: float = 1e-8,
) -> DataFrame:
    """Month rows with everything that looks at neighbouring months of the same pair.

    Frames count months present, not calendar months. All windows share one partitioning and one
    sort, a partition holding the months of one pair. A sum over the last k months is the
    difference of two running sums of integers: exact, and every row is added once instead of k
    times. Means of ratios are not integers, so these two slide over their short frames.
    """
    pair = Window.partitionBy(USER, CATEGORY)
    by_month = pair.orderBy(MONTH)
    spend, count, total = F.col("spend"), F.col("txn_count"), F.col("total")
    rows = months.withColumns(
        {
            "share": ratio(dollars(spend), dollars(total), floor),
            "size": dollars(spend) / F.greatest(count, F.lit(1)),
            "square": square(spend),
        }
    )

    def running(column: str, back: int) -> Column:
        return F.sum(column).over(by_month.rowsBetween(Window.unboundedPreceding, -back))

    rows = rows.withColumns(
        {
            "row": F.row_number().over(by_month) - 1,
            "n_months": F.count(F.lit(1)).over(pair),
            "n_txn": F.sum(count).over(pair),
            **{f"prev{k}": F.lag(spend, k).over(by_month) for k in (1, 2, 3)},
            "next_spend": F.lead(spend, 1).over(by_month),
            "prev_last_txn": F.lag("last_txn", 1).over(by_month),
            **{f"{c}_upto{k}": running(c, k) for c in ("spend", "square") for k in (1, 4, 7)},
            **{f"txn_count_upto{k}": running("txn_count", k) for k in (1, 4)},
            "hist_share": F.avg("share").over(by_month.rowsBetween(-6, -1)),
            "hist_size": F.avg("size").over(by_month.rowsBetween(-3, -1)),
        }
    )

    def last(column: str, k: int) -> Column:
        older = F.col(f"{column}_upto{k + 1}")
        return F.col(f"{column}_upto1") - F.coalesce(older, F.lit(0).cast("bigint"))

    def known(k: int) -> Column:
        return F.nullif(F.least(F.col("row"), F.lit(k)), F.lit(0))

    rows = rows.withColumns(
        {
            "sum3": last("spend", 3), "sum6": last("spend", 6), "sq3": last("square", 3), "sq6": last("square", 6),
            "n3": known(3), "n6": known(6),
        }
    ).withColumns(
        {
            "mean3": exact_mean(F.col("sum3"), F.col("n3")),
            "mean6": exact_mean(F.col("sum6"), F.col("n6")),
            "std3": exact_pop_std(F.col("sum3"), F.col("sq3"), F.col("n3")),
            "std6": exact_pop_std(F.col("sum6"), F.col("sq6"), F.col("n6")),
            "hist_count": last("txn_count", 3) / F.col("n3"),
        }
    ).withColumns(
        # With one month of history the formula gives 0 by itself; with none it is null.
        {c: F.coalesce(c, F.lit(0.0)) for c in ("std3", "std6")}
    )
    above = (F.col("row") >= first_row) & (dollars(spend) > F.col("mean3") * ELEVATED)
    if guard:
        above = above & (F.col("mean3") > 0)
    return rows.withColumn("elevated", F.coalesce(above, F.lit(False)).cast("int"))


def _days_since(month: Column, last: Column) -> Column:
    # A difference of timestamps counts whole days; datediff would count date borders.
    gap = F.extract(F.lit("DAY"), month.cast("timestamp_ntz") - last)
    return F.when(last.isNull(), F.lit(30)).otherwise(F.greatest(F.lit(0), gap)).cast("bigint")


def trend_features(
    transactions: DataFrame,
    budgets: DataFrame | None = None,
    variant: Variant = LEDGER,
    training: bool = True,
) -> DataFrame:
    """Transactions to one row of 20 features per (user, category, month).

    ``budgets`` is ``active_budgets``: one row per (user_id, category). In training, months without
    a following month are dropped and ``next_month_spend`` is added. The outlier flag needs the
    finished rows twice: write them, then ``flag_outliers`` (as ``plans.feature_table`` does).
    """
    rows = history(
        monthly(transactions), variant.elevated_from, variant.elevated_guard, variant.floor
    )
    if variant.eligible is not None:
        min_months, min_txn = variant.eligible
        rows = rows.where(
            (F.col("n_months") >= min_months) & (F.col("n_txn") / F.col("n_months") >= min_txn)
        )
    if budgets is not None:
        # Same keys as the windows above: only the budget side moves.
        rows = rows.join(budgets.select(USER, CATEGORY, "budget"), [USER, CATEGORY], "left")
    else:
        rows = rows.withColumn("budget", F.lit(0.0))
    if variant.elevated == "user_month":
        rows = rows.withColumn("elevated_n", F.sum("elevated").over(Window.partitionBy(USER, MONTH)))
    else:
        bar = F.col("mean3") * ELEVATED
        rows = rows.withColumn(
            "elevated_n",
            functools.reduce(
                lambda a, b: a + b,
                [
                    F.coalesce((dollars(s) > bar).cast("bigint"), F.lit(0))
                    for s in map(F.col, ("spend", "prev1", "prev2", "prev3"))
                ],
            ),
        )

    spend = dollars("spend")
    mean3, count = F.col("mean3"), F.col("txn_count")
    columns = {
        "current_spend": spend,
        "rolling_mean_1m": dollars("prev1"),
        "rolling_mean_3m": mean3,
        "rolling_mean_6m": F.col("mean6"),
        "rolling_std_3m": F.col("std3"),
        "rolling_std_6m": F.col("std6"),
        "deviation_ratio": F.least(ratio(spend, mean3, variant.floor), F.lit(10.0)),
        "share_of_wallet": F.col("share"),
        "hist_share_of_wallet": F.col("hist_share"),
        "txn_count": count,
        "hist_txn_count_mean": F.col("hist_count"),
        "avg_txn_size": F.col("size"),
        "hist_avg_txn_size": F.col("hist_size"),
        "days_since_last_txn": _days_since(F.col(MONTH), F.col("prev_last_txn"))
        if variant.dated
        else F.lit(15).cast("bigint"),
        "month_of_year": F.month(MONTH).cast("bigint"),
        "spending_velocity": ratio(dollars("mid_spend"), mean3, variant.floor)
        if variant.dated
        else ratio(spend, mean3, variant.floor) * 0.5,
        "weekend_txn_ratio": F.col("weekend_txns") / F.greatest(count, F.lit(1))
        if variant.dated
        else F.lit(None).cast("double"),
        "total_monthly_spend": dollars("total"),
        "elevated_cat_count": F.col("elevated_n"),
        "budget_utilization": F.when(F.col("budget") > 0, spend / F.col("budget")).otherwise(F.lit(0.0)),
    }
    rows = rows.where(F.col("row") >= variant.first_row)
    keep = [USER, CATEGORY, MONTH]
    if training:
        rows = rows.where(F.col("next_spend").isNotNull())
        columns[TARGET] = dollars("next_spend")
    return rows.select(*keep, *[c.alias(name) for name, c in columns.items()])


def category_medians(features: DataFrame) -> DataFrame:
    """Exact median of current_spend per category, whatever a category's share of the rows."""
    whole = staged(features.select(CATEGORY, F.round(F.col("current_spend") * 100).cast("bigint").alias("_c")), "spend")
    return exact_median(whole, [CATEGORY], "_c", "median_cents").select(
        CATEGORY, (F.col("median_cents") / 100.0).alias("median_spend")
    )


def flag_outliers(features: DataFrame, factor: float = 10) -> DataFrame:
    """Add ``_is_outlier``: spend above ``factor`` times the category's median."""
    medians = category_medians(features)
    return (
        features.join(medians, CATEGORY, "left")  # medians of few categories are broadcast
        .withColumn(
            "_is_outlier",
            F.col("current_spend") > F.coalesce("median_spend", F.lit(0.0)) * F.lit(float(factor)),
        )
        .select(*features.columns, "_is_outlier")
    )


def feature_vector(features: DataFrame, keys: Sequence[str] = (USER, CATEGORY, MONTH)) -> DataFrame:
    """Keys and the 20 features in model order, as doubles."""
    return features.select(*keys, *[F.col(c).cast("double").alias(c) for c in FEATURES])


def present(features: DataFrame) -> DataFrame:
    """Rounded for output: money and means to 2 digits, ratios to 4, the month as yyyy-MM."""
    digits = {c: 2 for c in (*MONEY, TARGET)} | {c: 4 for c in RATIOS}
    return features.select(
        *[
            F.date_format(c, "yyyy-MM").alias(c)
            if c == MONTH
            else (F.round(c, digits[c]).alias(c) if c in digits else F.col(c))
            for c in features.columns
        ]
    )
