"""Evaluation of prediction tables.

Multi-label predictions are long: one row per (row_id, label) with ``actual`` 0/1 and ``prob``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .splits import sample_rows

THRESHOLD, ABSTAIN = 0.5, 0.7


def _hit(threshold: float) -> Column:
    return F.col("prob") > threshold


def predicted_labels(predictions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, label) of every label above the threshold."""
    return predictions.where(_hit(threshold)).select("row_id", "label")


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    denominator = 2 * tp + fp + fn
    return F.when(denominator > 0, 2 * tp / denominator).otherwise(F.lit(0.0))


def _scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support from tp, fp, fn per label; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "label", "tp", "fp", "fn",
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0)).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
        (tp + fn).alias("support"),
    )


def per_label(predictions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Classification report of a multi-label prediction."""
    hit, actual = _hit(threshold), F.col("actual") == 1
    return _scores(
        predictions.groupBy("label").agg(
            F.count_if(hit & actual).alias("tp"),
            F.count_if(hit & ~actual).alias("fp"),
            F.count_if(~hit & actual).alias("fn"),
        )
    )


def per_row(predictions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: exact match, any correct label, largest probability."""
    hit, actual = _hit(threshold), F.col("actual") == 1
    return predictions.groupBy("row_id").agg(
        F.bool_and(hit == actual).alias("exact"),
        F.bool_or(hit & actual).alias("any_correct"),
        F.max("prob").alias("max_prob"),
    )


def _label_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.avg("f1").alias("macro_f1"),
        _f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"),
        F.coalesce(F.min(F.when(F.col("support") > 0, F.col("recall"))), F.lit(0.0)).alias("min_class_recall"),
    )


def multilabel_metrics(
    predictions: DataFrame, threshold: float = THRESHOLD, abstain: float = ABSTAIN
) -> DataFrame:
    """One row: exact-match and subset accuracy, F1s, least recall, abstention, confidence."""
    labels = _label_summary(per_label(predictions, threshold))
    n = F.count(F.lit(1))
    return (
        per_row(predictions, threshold)
        .agg(
            (F.count_if("exact") / n).alias("exact_match_accuracy"),
            (F.count_if("any_correct") / n).alias("subset_accuracy"),
            (F.count_if(F.col("max_prob") < abstain) / n).alias("abstention_rate"),
            F.avg("max_prob").alias("mean_max_confidence"),
        )
        .withColumn("_l", labels.select(F.struct(*labels.columns)).scalar())
        .select(
            "exact_match_accuracy", "subset_accuracy", "_l.macro_f1", "_l.micro_f1",
            "_l.min_class_recall", "abstention_rate", "mean_max_confidence",
        )
    )


def primary_labels(predictions: DataFrame) -> DataFrame:
    """(row_id, truth, guess): first true label by name; most probable label, ties by name."""
    return predictions.groupBy("row_id").agg(
        F.min(F.when(F.col("actual") == 1, F.col("label"))).alias("truth"),
        F.min_by("label", F.struct((-F.col("prob")).alias("p"), "label")).alias("guess"),
    ).where(F.col("truth").isNotNull())


def confusion(pairs: DataFrame) -> DataFrame:
    """(truth, guess, n) of all classes."""
    return pairs.groupBy("truth", "guess").agg(F.count(F.lit(1)).alias("n"))


def single_label_report(pairs: DataFrame) -> DataFrame:
    """Classification report of (truth, guess) pairs, from the confusion counts."""
    same = F.col("truth") == F.col("guess")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.when(same, F.col("n")).otherwise(F.lit(0)).alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"), F.when(same, F.lit(0)).otherwise(F.col("n")).alias("fn")),
        F.struct(F.col("guess").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(same, F.lit(0)).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("bigint").alias("fn")),
    )
    counts = confusion(pairs).select(F.inline(sides))
    return _scores(counts.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def single_label_metrics(pairs: DataFrame) -> DataFrame:
    """One row: accuracy and macro-F1."""
    macro = single_label_report(pairs).agg(F.avg("f1")).scalar()
    return pairs.agg(
        (F.count_if(F.col("truth") == F.col("guess")) / F.count(F.lit(1))).alias("accuracy")
    ).select("accuracy", macro.alias("macro_f1"))


def with_residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Add ``residual`` and ``abs_residual``."""
    return df.withColumn("residual", F.col(actual) - F.col(predicted)).withColumn(
        "abs_residual", F.abs("residual")
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: str = "split") -> DataFrame:
    """RMSE, MAE and R² per split."""
    r = with_residuals(df, actual, predicted)
    figures = r.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("residual") * F.col("residual")).alias("_mse"),
        F.avg("abs_residual").alias("mae"),
        F.var_pop(actual).alias("_var"),
    )
    return figures.select(
        by, "n", F.sqrt("_mse").alias("rmse"), "mae",
        F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var"))
        .when(F.col("_mse") == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
        .alias("r2"),
    )


def largest_residuals(df: DataFrame, actual: str, predicted: str, keys: list[str], k: int = 5) -> DataFrame:
    """The k rows with the largest absolute residual; ties by key."""
    r = with_residuals(df, actual, predicted)
    return r.orderBy(F.desc("abs_residual"), *keys).limit(k).select(*keys, actual, predicted, "abs_residual")


def precision_at_k(df: DataFrame, actual: str, predicted: str, keys: list[str], k: int = 5) -> DataFrame:
    """Share of the k largest residuals above twice the standard deviation of the actuals."""
    bar = df.agg(F.stddev_pop(actual) * 2).scalar()
    return (
        largest_residuals(df, actual, predicted, keys, k)
        .withColumn("_bar", bar)
        .agg((F.count_if(F.col("abs_residual") > F.col("_bar")) / F.count(F.lit(1))).alias(f"precision_at_{k}"))
    )


def residual_summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Means and population standard deviations of actuals, predictions and residuals."""
    r = with_residuals(df, actual, predicted)
    figures = []
    for name, column in (("actual", actual), ("pred", predicted), ("residual", "residual")):
        figures += [F.avg(column).alias(f"{name}_mean"), F.stddev_pop(column).alias(f"{name}_std")]
    return r.agg(F.count(F.lit(1)).alias("n"), *figures)


def prediction_sample(df: DataFrame, actual: str, predicted: str, keys: list[str], n: int = 50) -> DataFrame:
    """Seeded sample with residual and absolute error in percent of the actual."""
    rows = df.select(*keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
    sampled = with_residuals(sample_rows(rows, n, key=keys), "actual", "predicted")
    return sampled.withColumn(
        "abs_error_pct", F.col("abs_residual") / (F.abs("actual") + F.lit(1e-8)) * 100
    ).drop("abs_residual")
