"""The application's tables: ledger, budgets, feedback. Inputs may be JDBC or parquet tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F


def ledger(
    transactions: DataFrame,
    journals: DataFrame,
    categories: DataFrame,
    asof: dt.date | dt.datetime,
    months: int = 7,
    user: str | None = None,
) -> DataFrame:
    """Positive transactions of the last ``months`` with journal and category attached.

    ``user`` is compared as a literal value, so it cannot change the query. The rows are not
    sorted: order is a matter of the sink.
    """
    since = F.add_months(F.lit(asof).cast("date"), -months)
    moment = F.lit(asof).cast("timestamp_ntz")
    # Whole months back from the moment itself, time of day included.
    floor = since.cast("timestamp_ntz") + (moment - moment.cast("date").cast("timestamp_ntz"))
    recent = transactions.where((F.col("amount") > 0) & (F.col("date") >= floor))
    owned = journals if user is None else journals.where(F.col("user_id") == F.lit(user))
    named = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return (
        recent.withColumnRenamed("id", "transaction_id")
        .withColumnRenamed("date", "transaction_date")
        .join(owned.withColumnRenamed("id", "transaction_journal_id"), "transaction_journal_id")
        .join(named, "category_id", "left")
        .select(
            "transaction_id", "user_id", "description", "amount", "transaction_date",
            "category_name", "category_id", "budget_id",
        )
    )


def active_budgets(
    limits: DataFrame, budgets: DataFrame, asof: dt.date, user: str | None = None
) -> DataFrame:
    """Budget in force at ``asof`` per (user_id, category); the category is the budget's name.

    Of several limits in force for one key the one that started last wins, then the larger id.
    """
    day = F.lit(asof).cast("date")
    valid = limits.where((F.col("start_date") <= day) & (F.col("end_date") >= day))
    owned = budgets if user is None else budgets.where(F.col("user_id") == F.lit(user))
    return (
        valid.join(owned.withColumnRenamed("id", "budget_id"), "budget_id")
        .groupBy(F.col("user_id").cast("string").alias("user_id"), F.col("name").alias("category"))
        .agg(
            F.max_by(F.col("amount").cast("double"), F.struct("start_date", "budget_id")).alias("budget")
        )
    )


def _since(feedback: DataFrame, since: dt.datetime | None) -> DataFrame:
    return feedback if since is None else feedback.where(F.col("created_at") >= F.lit(since))


def text_feedback(
    feedback: DataFrame, transactions: DataFrame, since: dt.datetime | None = None
) -> DataFrame:
    """Category feedback since the cutoff, with the transaction's description and amount."""
    chosen = _since(feedback.where(F.col("model_type") == "categorization"), since).select(
        "feedback_id", "user_id", "transaction_id", "predicted_category", "actual_category",
        "feedback_type", "created_at",
    )
    return chosen.join(transactions.select("transaction_id", "description", "amount"), "transaction_id")


def trend_feedback(feedback: DataFrame, since: dt.datetime | None = None) -> DataFrame:
    """Trend feedback since the cutoff."""
    return _since(feedback.where(F.col("model_type") == "trend"), since).select(
        "feedback_id", "user_id", "category_name", "anomaly_score", "predicted_spend",
        "actual_spend", "feedback_type", "created_at",
    )
