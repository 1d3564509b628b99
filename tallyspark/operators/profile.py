"""Descriptive reports and quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.money import cents, dollars
from ..functions.order import exact_median

#: Values of one bitmap (4 KiB), the most bitmaps a task may hold, and the rows that are worth one.
BITMAP, MOST_BITMAPS, ROWS_PER_BITMAP = 1 << 15, 1 << 12, 1 << 9


def average_monthly(txn: DataFrame, category: str = "major_category", period: str = "period") -> DataFrame:
    """Mean over periods of a category's total spend."""
    totals = txn.groupBy(category, period).agg(F.coalesce(F.sum(cents("amount")), F.lit(0)).alias("_t"))
    return totals.groupBy(category).agg(dollars(F.sum("_t") / F.count("_t")).alias("avg_monthly"))


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def label_coverage(df: DataFrame, column: str = "categories") -> DataFrame:
    """Average and least number of labels, share of rows with two or more."""
    size = F.size(column)
    return df.agg(
        (F.sum(size) / F.count(F.lit(1))).alias("avg_labels"),
        F.min(size).alias("min_labels"),
        (F.count_if(size >= 2) / F.count(F.lit(1))).alias("pct_multilabel"),
    )


def amount_profile(df: DataFrame, column: str = "amount") -> DataFrame:
    """Mean, exact median, sample standard deviation, least and largest value of a money column."""
    whole = df.select(F.col(column).alias("_a"), cents(column).alias("_c"))
    median = exact_median(whole, [], "_c", "m").select(F.col("m") / 100.0).scalar()
    return whole.agg(
        dollars(F.sum("_c") / F.count("_c")).alias("amount_mean"),
        F.stddev_samp("_a").alias("amount_std"),
        F.min("_a").alias("amount_min"),
        F.max("_a").alias("amount_max"),
    ).select("amount_mean", median.alias("amount_median"), "amount_std", "amount_min", "amount_max")


def _whole(df: DataFrame, column: str) -> Column:
    """A whole-number or date column as BIGINT."""
    value = F.col(column)
    return (F.unix_date(value) if isinstance(df.schema[column].dataType, T.DateType) else value).cast("bigint")


def _count_by_bitmap(df: DataFrame, column: str) -> DataFrame:
    value = _whole(df, column)
    bits = df.where(F.col(column).isNotNull()).select(
        F.bitmap_bucket_number(value).alias("_bucket"), F.bitmap_bit_position(value).alias("_bit")
    )
    counted = bits.groupBy("_bucket").agg(F.bitmap_count(F.bitmap_construct_agg("_bit")).alias("_n"))
    return counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: row count and distinct values per column; nulls are no value.

    No row is expanded into one per column: each column is counted in a scan of its own that reads nothing else. Whole numbers
    and dates that lie close together are set in bitmaps, one per 32,768 values, which tasks combine before the shuffle; one
    job for the least and largest value of these columns decides. Other columns are grouped by value.
    """
    whole = [c for c in dict.fromkeys(columns) if isinstance(df.schema[c].dataType, (T.IntegralType, T.DateType))]
    spans = [f(_whole(df, c)).alias(f"{tag}_{c}") for c in whole for f, tag in ((F.min, "lo"), (F.max, "hi"))]
    found = df.agg(F.count(F.lit(1)).alias("rows"), *spans).first() if whole else None

    def close(column: str) -> bool:
        if column not in whole or found[f"lo_{column}"] is None:
            return False
        bitmaps = (found[f"hi_{column}"] - found[f"lo_{column}"]) // BITMAP + 2
        return bitmaps <= min(MOST_BITMAPS, 2 + found["rows"] // ROWS_PER_BITMAP)

    counts = {
        f"n_{c}": _count_by_bitmap(df, c) if close(c) else df.select(c).distinct().agg(F.count(c).alias("n")) for c in columns
    }
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select("n_rows", *[count.scalar().alias(name) for name, count in counts.items()])


def profile(txn: DataFrame) -> DataFrame:
    """One row of all quality figures of a labelled transaction table."""
    figures = F.struct(*label_coverage(txn).columns)
    amounts = amount_profile(txn)
    labels = label_coverage(txn).select(figures).scalar()
    money = amounts.select(F.struct(*amounts.columns)).scalar()
    counts = distinct_counts(txn, ["persona_id", "major_category", "period"])
    return counts.withColumns({"_l": labels, "_m": money}).select(*counts.columns, "_l.*", "_m.*")


# Rule, profile column, lowest value that passes, whether the bound itself passes.
QUALITY_RULES = (
    ("labels per transaction", "min_labels", 2.0, True),
    ("positive amounts", "amount_min", 0.0, False),
    ("personas", "n_persona_id", 100.0, True),
)
SIZE_RULES = (
    ("trend rows", "trend_rows", 1000.0, True),
    ("text rows", "text_rows", 5000.0, True),
)


def quality_issues(figures: DataFrame, rules: Sequence[tuple] = QUALITY_RULES) -> DataFrame:
    """(rule, value, passed) for a one-row profile."""
    checks = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.col(column).cast("double").alias("value"),
                ((F.col(column) >= bound) if closed else (F.col(column) > bound)).alias("passed"),
            )
            for rule, column, bound, closed in rules
        ]
    )
    return figures.select(F.inline(checks))


def set_sizes(text: DataFrame, trend: DataFrame, target: str = "next_month_spend") -> DataFrame:
    """One row on the two training sets: rows per split, spread of amounts and target."""

    def sizes(name: str):
        return [F.count(F.lit(1)).alias(f"{name}_rows")] + [
            F.count_if(F.col("split") == s).alias(f"{name}_{s}") for s in ("train", "val", "test")
        ]

    money = amount_profile(text)
    left = text.agg(*sizes("text")).withColumn("_m", money.select(F.struct(*money.columns)).scalar())
    right = trend.agg(
        *sizes("trend"),
        (F.sum(cents(target)) / F.count(target) / 100.0).alias("target_mean"),
        F.stddev_samp(target).alias("target_std"),
    )
    other = right.select(F.struct(*right.columns)).scalar()
    return left.withColumn("_t", other).select(
        "text_rows", "text_train", "text_val", "text_test", "_m.amount_mean", "_m.amount_median", "_t.*"
    )
