"""Jobs. Each composes operators and writes tables; a table used more than once is written first.

Intermediate tables go to a new path in the shared folder of ``spark.checkpoint.dir``, so a lost
executor costs one stage and not the lineage behind it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import drift as D, explain as X, feedback as FB, labels as L, models as M, profile as P
from ..operators import promote as G, survey as S
from ..operators.features import FEATURES, LEDGER, SURVEY, TARGET, Variant, flag_outliers, present, trend_features
from ..operators.isolation import fit_forest as fit_isolation, isolation_score
from ..operators.merchants import assign_merchants
from ..operators.splits import ensure_split, part, split_by_hash, split_by_time
from ..sources.state import load_state, save_state
from ..sources.tables import staged, write_table


def feature_table(
    transactions: DataFrame,
    budgets: DataFrame | None = None,
    variant: Variant = LEDGER,
    training: bool = True,
    user: str | None = None,
    outlier_factor: float = 10,
    out: str | None = None,
    rounded: bool = True,
) -> DataFrame:
    """The feature job: features, then the outlier flag from the written features.

    ``rounded`` is the form for output (``present``); without it the features keep all digits and the month its date.
    """
    if user is not None:
        transactions = transactions.where(F.col("user_id") == F.lit(user))
    rows = staged(trend_features(transactions, budgets, variant, training), "features")
    flagged = flag_outliers(rows, outlier_factor)
    if rounded:
        flagged = present(flagged)
    if out is not None:
        write_table(flagged, out)
    return flagged


def survey_ledger(txn: DataFrame) -> DataFrame:
    """Survey transactions under the ledger's column names; a row is dated to its month."""
    return txn.select(
        F.col("persona_id").alias("user_id"),
        F.col("major_category").alias("category_name"),
        F.col("period").cast("timestamp_ntz").alias("transaction_date"),
        "amount",
    )


def survey_transactions(
    units: DataFrame, items: DataFrame, hierarchy: DataFrame, n: int | None = None, seed: int = 42, order: Sequence[str] = ("quarter",)
) -> DataFrame:
    """Survey tables to labelled, described transactions of all units, or of a weighted sample of ``n``.

    A unit counts once, by its latest record.
    """
    latest = S.latest_units(units, [c for c in order if c in units.columns])
    sampled = S.named_units(latest) if n is None else S.sample_units(latest, n, seed=seed)
    totals = S.period_totals(items, sampled, hierarchy)
    txn = S.disaggregate(totals, seed=seed)
    described = assign_merchants(txn, sampled, seed=seed)
    return L.assign_labels(described, F.transform("items", lambda i: i["item_name"]))


def survey_sets(
    spark: SparkSession, units: DataFrame, items: DataFrame, hierarchy: DataFrame, out: str, n: int | None = None, seed: int = 42
) -> dict[str, DataFrame]:
    """The survey job: text set, trend set, report and issues, written below ``out``."""
    txn = staged(survey_transactions(units, items, hierarchy, n, seed), "txn", f"{out}/txn.parquet")
    key = ["persona_id", "major_category", "period", "part"]
    text = L.text_set(split_by_hash(txn, key, seed=seed))
    trend = staged(trend_features(survey_ledger(txn), variant=SURVEY), "trend")
    tables = {
        "text": text,
        "trend": split_by_time(trend, seed=seed).withColumnRenamed("user_id", "persona_id"),
        "report": P.profile(txn),
        "monthly": P.average_monthly(txn),
        "counts": P.count_by(txn, "major_category"),
    }
    tables["issues"] = P.quality_issues(tables["report"])
    for name, table in tables.items():
        fmt = "parquet" if name in ("text", "trend") else "json"
        write_table(table, f"{out}/{name}.{fmt}", fmt)
    return {
        name: spark.read.format("parquet" if name in ("text", "trend") else "json").schema(table.schema).load(
            f"{out}/{name}.{'parquet' if name in ('text', 'trend') else 'json'}"
        )
        for name, table in tables.items()
    }


def trained_scores(
    trend: DataFrame, params: M.Boosting = M.FIRST_FIT, trees: int = 100, seed: int = 42
) -> tuple[M.Regressor, DataFrame]:
    """The training job: boosted trees and isolation forest on train; ensemble scores on test."""
    if "split" not in trend.columns:
        trend = staged(trend, "trend")
    split = staged(ensure_split(trend, "period", ["user_id", "category"], seed), "split")
    train, test = part(split, "train"), part(split, "test")
    model = M.fit_boosted(train, params, seed=seed)
    forest = fit_isolation(train, FEATURES, trees=trees, seed=seed, key=["user_id", "category", "period"])
    scored = model.predict(test).withColumn("abs_residual", F.abs(F.col(TARGET) - F.col("predicted")))
    both = staged(isolation_score(scored, forest, FEATURES), "scores")
    return model, M.ensemble(both)


def explanations(
    features: DataFrame, model: M.Regressor, attribution: dict[str, float], threshold: float = 0.6,
    user: str | None = None, out: str | None = None,
) -> DataFrame:
    """The explain job: score the batch, explain what is above the threshold."""
    batch = features if user is None else features.where(F.col("user_id") == F.lit(user))
    scored = staged(X.anomaly_scores(model.predict(batch)), "anomalies")
    explained = X.explain(X.attribute(X.keep_anomalies(scored, threshold), attribution, background=batch))
    rounded = X.present_explanations(explained)
    if out is not None:
        write_table(rounded, out, "json")
    return rounded


def retrain_trend(
    spark: SparkSession,
    feedback: DataFrame,
    external: DataFrame,
    state_path: str,
    asof: dt.datetime,
    run_id: str,
    reference: DataFrame | None = None,
    current: DataFrame | None = None,
    params: M.Boosting = M.REFIT,
    force: bool = False,
) -> tuple[bool, list[str], M.Regressor | None]:
    """The retraining job of the trend model: triggers and drift, target adjustment, fit, state."""
    report = None
    if reference is not None and current is not None:
        report = D.drift_summary(D.drift_report(reference, current, FEATURES))
    last = load_state(spark, state_path, "trend")
    verdict = FB.decide(FB.trend_trigger(feedback, asof, last), report, force).first()
    if not verdict.retrain:
        return False, list(verdict.reasons), None
    adjusted = staged(FB.blend_expected(external, feedback), "retrain")
    rows = part(adjusted, "train") if "split" in adjusted.columns else adjusted
    model = M.fit_boosted(rows, params)
    save_state(spark, state_path, "trend", asof, run_id)
    return True, list(verdict.reasons), model


def retrain_text(
    spark: SparkSession,
    feedback: DataFrame,
    external: DataFrame,
    state_path: str,
    asof: dt.datetime,
    run_id: str,
    report: DataFrame | None = None,
    force: bool = False,
    max_iter: int = 1000,
) -> tuple[bool, list[str], M.TextClassifier | None]:
    """The retraining job of the text model: triggers, mixing, weighted fit on the first label, state."""
    last = load_state(spark, state_path, "text")
    verdict = FB.decide(FB.text_trigger(feedback, asof, last), report, force).first()
    if not verdict.retrain:
        return False, list(verdict.reasons), None
    mixed = staged(FB.mix(FB.feedback_rows(feedback), external), "mixed")
    rows = part(mixed, "train").withColumn("truth", F.get("categories", F.lit(0)))
    model = M.fit_text_classifier(rows, max_iter=max_iter, weight="sample_weight")
    save_state(spark, state_path, "text", asof, run_id)
    return True, list(verdict.reasons), model


def promotion(
    models: DataFrame, metrics: DataFrame, gates: Sequence[G.Gate], production: DataFrame | None = None, dry_run: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """Gate results and, unless it is a dry run, the status events they lead to."""
    results = G.gate_results(metrics, gates, production)
    if dry_run:
        return results, None
    passed = G.verdicts(results).withColumnRenamed("run_id", "model_id")
    return results, G.promote(models, passed)
