"""User feedback: training rows, target adjustment, retraining triggers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.order import first_k
from ..sources.tables import staged
from .splits import split_shuffled

# Sample weights by origin of the label.
OVERRIDE_WEIGHT, ACCEPTED_WEIGHT, EXTERNAL_WEIGHT = 1.0, 0.3, 0.5
KEEP, MOVE = 0.7, 0.3


def feedback_rows(feedback: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Feedback as labelled rows: an override is a strong label, anything else a weak one.

    ``keep`` names further columns to carry along, such as a row key for later splits.
    """
    override = F.col("feedback_type") == "override"
    accepted = "predicted_category" if "predicted_category" in feedback.columns else "actual_category"
    return feedback.select(
        *keep,
        F.coalesce("description", F.lit("")).alias("description") if "description" in feedback.columns
        else F.lit("").alias("description"),
        F.array(F.when(override, F.col("actual_category")).otherwise(F.col(accepted))).alias("categories"),
        F.coalesce("amount", F.lit(0.0)).alias("amount") if "amount" in feedback.columns
        else F.lit(0.0).alias("amount"),
        F.lit("USD").alias("currency"),
        F.lit("US").alias("country"),
        F.when(override, F.lit(OVERRIDE_WEIGHT)).otherwise(F.lit(ACCEPTED_WEIGHT)).alias("sample_weight"),
        F.lit("production").alias("data_source"),
    )


def external_rows(external: DataFrame) -> DataFrame:
    """External rows with their weight and source."""
    return external.withColumns(
        {"sample_weight": F.lit(EXTERNAL_WEIGHT), "data_source": F.lit("external")}
    )


def mix(
    production: DataFrame, external: DataFrame, ratio: float = 0.5, key: Sequence[str] = (), seed: int = 42
) -> DataFrame:
    """All production rows and a sample of external ones so that production is ``ratio`` of all.

    Missing columns are null. The new split is a random one over the mixed rows. Without production
    rows the external ones come back whole, with the split they had.
    """
    outside = external_rows(external)
    n_production = production.count()
    if n_production == 0:
        return outside
    wanted = int(n_production * (1 - ratio) / ratio)
    sampled = first_k(outside.drop("split"), lambda n: F.least(F.lit(wanted), n), key=key, seed=seed)
    # Written once, as the split reads its input three times.
    rows = staged(production.unionByName(sampled, allowMissingColumns=True), "mixed")
    return split_shuffled(rows, key=key, seed=seed)


def expected_signals(feedback: DataFrame) -> DataFrame:
    """(user_id, category, n, shift): all "expected" signals of a pair as one change of the target.

    Each signal turns a target t into ``0.7 t + 0.3 actual``, in order of arrival. After n signals
    that is ``0.7**n t + shift``. Signals are folded per hour first and the hours then chained, so
    a pair with very many signals is spread over its hours.
    """
    # The prediction stands in only where the table has no actual spend at all; a null one is no signal.
    amount = F.col("actual_spend" if "actual_spend" in feedback.columns else "predicted_spend")
    signals = feedback.where(F.col("feedback_type") == "expected").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("category_name").alias("category"),
        "created_at", "feedback_id",
        F.date_trunc("HOUR", "created_at").alias("_hour"),
        amount.cast("double").alias("_a"),
    ).where(F.col("_a").isNotNull() & (F.col("_a") != 0))
    later = Window.partitionBy("user_id", "category", "_hour").orderBy(F.desc("created_at"), F.desc("feedback_id"))
    hours = (
        signals.withColumn("_after", F.row_number().over(later) - 1)
        .groupBy("user_id", "category", "_hour")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(F.lit(MOVE) * F.pow(F.lit(KEEP), F.col("_after")) * F.col("_a")).alias("_shift"),
        )
    )
    later_hours = (
        Window.partitionBy("user_id", "category").orderBy(F.desc("_hour")).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        hours.withColumn("_after", F.coalesce(F.sum("_n").over(later_hours), F.lit(0)))
        .groupBy("user_id", "category")
        .agg(
            F.sum("_n").alias("n"),
            F.sum(F.col("_shift") * F.pow(F.lit(KEEP), F.col("_after"))).alias("shift"),
        )
    )


def blend_expected(train: DataFrame, feedback: DataFrame, target: str = "next_month_spend") -> DataFrame:
    """Move the target of pairs whose spending users called expected. Rows without a user column
    stay as they are."""
    if "user_id" not in train.columns:
        return train
    signals = expected_signals(feedback)
    moved = F.pow(F.lit(KEEP), F.col("n")) * F.col(target) + F.col("shift")
    return (
        train.join(signals, ["user_id", "category"], "left")
        .withColumn(target, F.when(F.col("n").isNotNull(), moved).otherwise(F.col(target)))
        .select(*train.columns)
    )


def _reasons(*conditions: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, text) for c, text in conditions]))


def _schedule(last: dt.datetime | Column | None, asof: dt.datetime, days: int) -> list[tuple[Column, Column]]:
    last = last if isinstance(last, Column) else F.lit(last).cast("timestamp_ntz")
    gap = F.extract(F.lit("DAY"), F.lit(asof).cast("timestamp_ntz") - last)
    return [
        (gap >= days, F.format_string("Scheduled: %d days since last retrain", gap)),
        (last.isNull(), F.lit("No previous retraining recorded")),
    ]


def override_rate(feedback: DataFrame) -> DataFrame:
    """One row: overrides, signals and their rate."""
    n = F.count(F.lit(1))
    overrides = F.count_if(F.col("feedback_type") == "override")
    return feedback.agg(
        overrides.alias("n_override"), n.alias("n"), (overrides / F.greatest(n, F.lit(1))).alias("override_rate")
    )


def text_trigger(
    feedback: DataFrame, asof: dt.datetime, last: dt.datetime | Column | None = None,
    schedule: str = "weekly", threshold: float = 0.15,
) -> DataFrame:
    """One row (should_retrain, reasons): a week passed, or users override too often."""
    due = _schedule(last, asof, 7) if schedule == "weekly" else []
    rate = F.col("override_rate")
    often = (
        rate > threshold,
        F.format_string(f"Override rate %.1f%% > threshold {threshold * 100:.1f}%%", rate * 100),
    )
    return override_rate(feedback).select(_reasons(*due, often).alias("reasons")).select(
        (F.size("reasons") > 0).alias("should_retrain"), "reasons"
    )


def trend_trigger(
    feedback: DataFrame, asof: dt.datetime, last: dt.datetime | Column | None = None,
    schedule: str = "monthly", min_signals: int = 10,
) -> DataFrame:
    """One row (should_retrain, reasons): four weeks passed, or enough signals came in."""
    due = _schedule(last, asof, 28) if schedule == "monthly" else []
    many = (
        F.col("n") >= min_signals,
        F.format_string(f"%d feedback signals >= threshold {min_signals}", F.col("n")),
    )
    return feedback.agg(F.count(F.lit(1)).alias("n")).select(_reasons(*due, many).alias("reasons")).select(
        (F.size("reasons") > 0).alias("should_retrain"), "reasons"
    )


def decide(trigger: DataFrame, drift: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Trigger or drift or force. ``drift`` is the one-row ``drift_summary``."""
    drifted = F.lit(False) if drift is None else F.coalesce(drift.select("drift_detected").scalar(), F.lit(False))
    return trigger.withColumn("_d", drifted).select(
        (F.col("should_retrain") | F.col("_d") | F.lit(force)).alias("retrain"),
        F.concat("reasons", F.when(F.col("_d"), F.array(F.lit("Data drift detected (PSI > 0.25)")))
                 .otherwise(F.array().cast("array<string>"))).alias("reasons"),
    )
