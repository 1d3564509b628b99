"""Anomaly scores and their explanation in words."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.fixed import literal_map
from .features import FEATURES

SMOOTH = 1e-8


def normalise(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Scale columns to [0, 1] over the whole table: ``{column: new name}``.

    One aggregate of one row gives the bounds of all of them.
    """
    bounds = df.agg(
        *[f(c).alias(f"{tag}_{c}") for c in columns for f, tag in ((F.min, "lo"), (F.max, "hi"))]
    )
    b = F.col("_bounds")
    return (
        df.withColumn("_bounds", bounds.select(F.struct(*bounds.columns)).scalar())
        .withColumns(
            {
                out: (F.col(c) - b[f"lo_{c}"]) / (b[f"hi_{c}"] - b[f"lo_{c}"] + F.lit(SMOOTH))
                for c, out in columns.items()
            }
        )
        .drop("_bounds")
    )


def anomaly_scores(df: DataFrame, predicted: str = "predicted", actual: str = "current_spend") -> DataFrame:
    """Add ``anomaly_score``: absolute difference of actual and predicted, scaled over the batch."""
    away = df.withColumn("_away", F.abs(F.col(actual) - F.col(predicted)))
    return normalise(away, {"_away": "anomaly_score"}).drop("_away")


def keep_anomalies(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    return df.where(F.col("anomaly_score") > threshold)


def attribute(
    df: DataFrame, coefficients: Mapping[str, float], features: Sequence[str] = FEATURES, background: DataFrame | None = None
) -> DataFrame:
    """Add ``attributions``: array of (feature, value, attribution) of a linear model.

    ``coefficient × (value − mean)``; the means are those of ``background``, the table itself if
    none is given. Exact for a linear model.
    """
    means = (background or df).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features])
    parts = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f).cast("double").alias("value"),
                (F.lit(float(coefficients.get(f, 0.0))) * (F.col(f).cast("double") - F.col("_means")[f])).alias(
                    "attribution"
                ),
            )
            for f in features
        ]
    )
    return (
        df.withColumn("_means", means.select(F.struct(*means.columns)).scalar())
        .withColumn("attributions", parts)
        .drop("_means")
    )


def top_factors(attributions: str | Column = "attributions", k: int = 3) -> Column:
    """The k largest by absolute attribution, ties to the later feature, with direction and words."""
    words = literal_map(fixed.FEATURE_WORDS)
    keyed = F.transform(
        attributions,
        lambda a, i: F.struct(
            F.abs(a["attribution"]).alias("size"), i.alias("i"), a["feature"].alias("feature"),
            a["value"].alias("value"), a["attribution"].alias("attribution"),
        ),
    )
    return F.transform(
        F.slice(F.reverse(F.array_sort(keyed)), 1, k),
        lambda a: F.struct(
            a["feature"].alias("feature"),
            a["value"].alias("feature_value"),
            a["attribution"].alias("attribution"),
            F.when(a["attribution"] > 0, F.lit("increased")).otherwise(F.lit("decreased")).alias("direction"),
            F.coalesce(words[a["feature"]], a["feature"]).alias("description"),
        ),
    )


def severity(score: str | Column = "anomaly_score") -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score >= 0.85, F.lit("high")).when(score >= 0.7, F.lit("medium")).otherwise(F.lit("low"))


def alert_text(category: Column, actual: Column, predicted: Column, percent: Column, factors: Column) -> Column:
    """The alert sentence, with up to three driving factors."""
    word = F.when(actual > predicted, F.lit("higher")).otherwise(F.lit("lower"))
    main = F.concat(
        F.lit("Your "), category, F.lit(" spending this month ($"), F.format_number(actual, 2), F.lit(") is "),
        F.format_string("%.0f", F.rint(percent)), F.lit("% "), word, F.lit(" than expected ($"),
        F.format_number(predicted, 2), F.lit(")."),
    )
    said = F.transform(
        F.slice(factors, 1, 3),
        lambda f: F.concat(
            F.when(f["direction"] == "increased", F.lit("higher ")).otherwise(F.lit("lower ")), f["description"]
        ),
    )
    listed = (
        F.when(F.size(said) == 1, F.get(said, F.lit(0)))
        .when(F.size(said) == 2, F.array_join(said, " and "))
        .otherwise(F.concat(F.array_join(F.slice(said, 1, 2), ", "), F.lit(", and "), F.get(said, F.lit(2))))
    )
    return F.when(F.size(said) == 0, main).otherwise(
        F.concat(main, F.lit(" This appears driven by: "), listed, F.lit("."))
    )


def explain(df: DataFrame, predicted: str = "predicted", actual: str = "current_spend") -> DataFrame:
    """One explanation per row of a table with ``attributions`` and ``anomaly_score``.

    Figures are unrounded; ``present_explanations`` rounds them.
    """
    a, p = F.col(actual), F.col(predicted)
    percent = F.abs(a - p) / F.greatest(p, F.lit(SMOOTH)) * 100
    return (
        df.withColumn("top_factors", top_factors())
        .select(
            "user_id", "category", "period", "anomaly_score",
            p.alias("predicted_spend"), a.alias("actual_spend"),
            F.when(a > p, F.lit(1)).otherwise(F.lit(-1)).alias("direction"),
            percent.alias("magnitude_pct"), "top_factors",
        )
        .withColumn(
            "natural_language",
            alert_text(
                F.col("category"), F.col("actual_spend"), F.col("predicted_spend"), F.col("magnitude_pct"),
                F.col("top_factors"),
            ),
        )
        .withColumn("severity", severity())
    )


def present_explanations(explained: DataFrame) -> DataFrame:
    """Rounded for output; the month as yyyy-MM."""
    return explained.withColumns(
        {
            "period": F.date_format("period", "yyyy-MM"),
            "anomaly_score": F.round("anomaly_score", 4),
            "predicted_spend": F.round("predicted_spend", 2),
            "actual_spend": F.round("actual_spend", 2),
            "magnitude_pct": F.round("magnitude_pct", 1),
            "top_factors": F.transform(
                "top_factors",
                lambda f: f.withField("feature_value", F.round(f["feature_value"], 2)).withField(
                    "attribution", F.round(f["attribution"], 4)
                ),
            ),
        }
    )


def explain_row(df: DataFrame, base_value: float | Column) -> DataFrame:
    """Full explanation of the given rows: base value, prediction, every attribution, $ impact.

    The prediction is the base value plus all attributions, as for any linear model.
    """
    base = base_value if isinstance(base_value, Column) else F.lit(float(base_value))
    total = functools.reduce(lambda x, y: x + y, [F.col("attributions")[i]["attribution"] for i in range(len(FEATURES))])
    impact = F.transform(
        top_factors(),
        lambda f: f.withField(
            "impact",
            F.concat(
                f["description"], F.lit(" "), f["direction"], F.lit(" the predicted amount by $"),
                F.format_string("%.2f", F.abs(f["attribution"])),
            ),
        ),
    )
    return df.withColumn("base_value", base).select(
        "user_id", "category", "period",
        (F.col("base_value") + total).alias("predicted_spend"),
        "base_value",
        F.map_from_entries(F.transform("attributions", lambda a: F.struct(a["feature"], a["attribution"]))).alias(
            "attributions"
        ),
        impact.alias("top_factors"),
    )


def global_importance(attributed: DataFrame) -> DataFrame:
    """(feature, importance): mean absolute attribution."""
    return (
        attributed.select(F.inline("attributions"))
        .groupBy("feature")
        .agg(F.avg(F.abs("attribution")).alias("importance"))
    )


def by_importance(importance: DataFrame, k: int | None = None) -> DataFrame:
    """Most important first; the top k if given."""
    ordered = importance.orderBy(F.desc("importance"), "feature")
    return ordered if k is None else ordered.limit(k)
