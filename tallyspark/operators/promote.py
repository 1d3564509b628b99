"""Promotion gates and model lifecycle.

Metrics are long: (run_id, metric, value). The lifecycle is an append-only table of status events
(model_id, status, ts, seq); a model's status is its last event.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.order import carry_forward, running_position


@dataclasses.dataclass(frozen=True)
class Gate:
    metric: str
    description: str
    low: float | None = None
    high: float | None = None
    relative: float | None = None  # largest allowed multiple of the production model's value


# Gates of the text model.
TEXT_GATES = (
    Gate("test_subset_accuracy", "Accuracy >= 90%", low=0.90),
    Gate("test_macro_f1", "Macro-F1 >= 0.85", low=0.85),
    Gate("test_min_class_recall", "No category recall below 0.70", low=0.70),
    Gate("test_abstention_rate", "Abstention rate between 5% and 20%", low=0.05, high=0.20),
)


def trend_gates(prefix: str = "xgb") -> tuple[Gate, ...]:
    """Gates of the trend model; ``prefix`` is that of the run's metric names."""
    # Gates of the trend model.
    return (
        Gate(f"{prefix}_test_rmse", "RMSE <= production (within 5% tolerance)", relative=1.05),
        Gate(f"{prefix}_test_mae", "MAE does not increase by >10%", relative=1.10),
        Gate(f"{prefix}_precision_at_5", "Precision@5 >= 40%", low=0.40),
    )


def gates_for(model_type: str, prefix: str = "xgb") -> tuple[Gate, ...]:
    if model_type == "DISTILBERT_CATEGORIZATION":
        return TEXT_GATES
    if model_type in ("XGBOOST_TREND", "ISOLATION_FOREST"):
        return trend_gates(prefix)
    raise ValueError(f"unknown model type: {model_type}")


# Allowed status changes.
TRANSITIONS = {
    "TRAINING": ("SHADOW", "RETIRED"),
    "SHADOW": ("CANARY", "RETIRED"),
    "CANARY": ("PRODUCTION", "RETIRED"),
    "PRODUCTION": ("RETIRED",),
    "RETIRED": (),
}
NEXT_STATUS = {"TRAINING": "SHADOW", "SHADOW": "CANARY", "CANARY": "PRODUCTION"}


def _wide(metrics: DataFrame, keys: Sequence[str], gates: Sequence[Gate], tag: str) -> DataFrame:
    """One row per key, one column per gate metric: conditional aggregates instead of joins."""
    return metrics.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == g.metric, F.col("value"))).alias(f"{tag}{i}") for i, g in enumerate(gates)]
    )


def gate_results(
    metrics: DataFrame,
    gates: Sequence[Gate],
    production: DataFrame | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """(scope…, run_id, gate, passed, value, description, reason) for every run and gate.

    A missing metric fails. ``production`` is long like ``metrics``, with the values of the model
    in production, one per ``scope`` (a model type and user, say); without it relative gates pass.
    """
    runs = _wide(metrics, [*scope, "run_id"], gates, "v")
    if production is None:
        known = runs.select("*", *[F.lit(None).cast("double").alias(f"p{i}") for i in range(len(gates))])
    else:
        current = _wide(production, list(scope), gates, "p")
        if scope:
            keyed = current.withColumnsRenamed({c: f"_s_{c}" for c in scope})
            same = [runs[c].eqNullSafe(keyed[f"_s_{c}"]) for c in scope]
            known = runs.join(keyed, same, "left")
        else:
            known = runs.withColumn("_p", current.select(F.struct(*current.columns)).scalar()).select("*", "_p.*")

    def number(value: float | None) -> Column:
        return F.lit(None if value is None else float(value)).cast("double")

    rows = F.array(
        *[
            F.struct(
                F.lit(g.metric).alias("gate"), F.col(f"v{i}").alias("value"), F.col(f"p{i}").alias("prod"),
                number(g.low).alias("low"), number(g.high).alias("high"), number(g.relative).alias("rel"),
                F.lit(g.description).alias("description"),
            )
            for i, g in enumerate(gates)
        ]
    )
    value, low, high, rel, prod = (F.col(c) for c in ("value", "low", "high", "rel", "prod"))
    shown = F.format_string("%.4f", value)
    failures = F.array_compact(
        F.array(
            F.when(value < low, F.concat(shown, F.lit(" < min("), low.cast("string"), F.lit(")"))),
            F.when(value > high, F.concat(shown, F.lit(" > max("), high.cast("string"), F.lit(")"))),
            F.when(
                value > prod * rel,
                F.concat(shown, F.lit(" > "), rel.cast("string"), F.lit("x production("),
                         F.format_string("%.4f", prod), F.lit(")")),
            ),
        )
    )
    return (
        known.select(*scope, "run_id", F.inline(rows))
        .withColumn("_f", failures)
        .select(
            *scope, "run_id", "gate",
            (value.isNotNull() & (F.size("_f") == 0)).alias("passed"),
            "value", "description",
            F.when(value.isNull(), F.concat(F.lit("Metric '"), F.col("gate"), F.lit("' not found in run metrics")))
            .when(F.size("_f") == 0, F.lit("PASS"))
            .otherwise(F.array_join("_f", "; "))
            .alias("reason"),
        )
    )


def verdicts(results: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope…, run_id, passed): all gates pass. Evaluating changes no status."""
    return results.groupBy(*scope, "run_id").agg(F.bool_and("passed").alias("passed"))


def _month(ts: str) -> Column:
    return F.trunc(F.col(ts).cast("date"), "MM")


def check_transitions(events: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Events with the model's previous status and whether the change is allowed.

    A first event must be TRAINING.
    """
    seen = carry_forward(events, keys, _month("ts"), ["ts", "seq"], F.col("status"), "previous")
    legal = F.lit(False)
    for before, after in TRANSITIONS.items():
        if after:
            legal = legal | ((F.col("previous") == before) & F.col("status").isin(*after))
    return seen.withColumn(
        "allowed", F.when(F.col("previous").isNull(), F.col("status") == "TRAINING").otherwise(legal)
    )


def current_status(events: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Last status per model."""
    return events.groupBy(*keys).agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))


def predecessors(models: DataFrame) -> DataFrame:
    """Add ``predecessor_id``: the production model of the same type and user registered before."""
    in_production = F.when(F.col("status") == "PRODUCTION", F.col("model_id"))
    return carry_forward(
        models, ["model_type", "user_id"], _month("ts"), ["ts", "seq"], in_production, "predecessor_id"
    )


def versions(models: DataFrame) -> DataFrame:
    """Add ``version``: 1.0.0 for the first model of a type and user, then 1.1.0, 1.2.0, …"""
    numbered = running_position(models, ["model_type", "user_id"], _month("ts"), ["ts", "seq"], "_v")
    return numbered.withColumn(
        "version", F.concat(F.lit("1."), F.col("_v").cast("string"), F.lit(".0"))
    ).drop("_v")


def latest(models: DataFrame) -> DataFrame:
    """Most recently registered model per type and user."""
    others = [c for c in models.columns if c not in ("model_type", "user_id")]
    return (
        models.groupBy("model_type", "user_id")
        .agg(F.max_by(F.struct(*others), F.struct("ts", "seq")).alias("_m"))
        .select("model_type", "user_id", *[F.col("_m")[c].alias(c) for c in others])
    )


def production(models: DataFrame) -> DataFrame:
    """Most recently registered production model per type and user."""
    return latest(models.where(F.col("status") == "PRODUCTION"))


def next_version(models: DataFrame) -> DataFrame:
    """(model_type, user_id, next_version): the latest ``a.b.c`` becomes ``a.(b+1).0``."""
    parts = F.split("version", r"\.")
    return latest(models).select(
        "model_type", "user_id",
        F.concat_ws(".", parts[0], (parts[1].cast("int") + 1).cast("string"), F.lit("0")).alias("next_version"),
    )


def register(models: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows for new models (model_id, model_type, user_id, ts, seq, …): version, predecessor, TRAINING.

    At most one new model per type and user and call.
    """
    known = next_version(models).withColumnsRenamed({"model_type": "_t", "user_id": "_u"})
    serving = production(models).select(
        F.col("model_type").alias("_pt"), F.col("user_id").alias("_pu"), F.col("model_id").alias("predecessor_id")
    )
    return (
        fresh.join(known, fresh["model_type"].eqNullSafe(known["_t"]) & fresh["user_id"].eqNullSafe(known["_u"]), "left")
        .join(serving, fresh["model_type"].eqNullSafe(serving["_pt"]) & fresh["user_id"].eqNullSafe(serving["_pu"]), "left")
        .select(
            *[fresh[c] for c in fresh.columns],
            F.coalesce("next_version", F.lit("1.0.0")).alias("version"),
            F.lit("TRAINING").alias("status"),
            "predecessor_id",
        )
    )


def list_models(models: DataFrame, model_type: str | None = None, status: str | None = None) -> DataFrame:
    if model_type is not None:
        models = models.where(F.col("model_type") == model_type)
    return models if status is None else models.where(F.col("status") == status)


def promote(models: DataFrame, passed: DataFrame) -> DataFrame:
    """New events (model_id, status, reason) for models whose gates pass.

    ``models`` has model_id, status and predecessor_id; ``passed`` has model_id and passed. A model
    moves one step; reaching PRODUCTION retires its predecessor if that is in production.
    """
    step = F.lit(None).cast("string")
    for status, following in NEXT_STATUS.items():
        step = F.when(F.col("status") == status, F.lit(following)).otherwise(step)
    moved = (
        models.join(passed.where("passed").select("model_id"), "model_id", "left_semi")
        .withColumn("next", step)
        .where(F.col("next").isNotNull())
    )
    retired = (
        moved.where((F.col("next") == "PRODUCTION") & F.col("predecessor_id").isNotNull())
        .select(F.col("predecessor_id").alias("model_id"))
        .distinct()
        .join(models.where(F.col("status") == "PRODUCTION").select("model_id"), "model_id", "left_semi")
    )
    return moved.select("model_id", F.col("next").alias("status"), F.lit("gates passed").alias("reason")).unionByName(
        retired.select("model_id", F.lit("RETIRED").alias("status"), F.lit("replaced").alias("reason"))
    )


def rollback(models: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """New events that retire the targets and put their predecessors back into production.

    ``targets`` has a model_id column; without it every current production model is a target.
    A restored predecessor skips the transition rules.
    """
    ids = production(models).select("model_id") if targets is None else targets.select("model_id").distinct()
    chosen = models.join(ids, "model_id", "left_semi")
    retired = chosen.where(F.col("status") != "RETIRED").select("model_id", F.lit("RETIRED").alias("status"),
                                                                F.lit("rolled back").alias("reason"))
    restored = (
        chosen.where(F.col("predecessor_id").isNotNull())
        .select(F.col("predecessor_id").alias("model_id"))
        .distinct()
        .join(models.select("model_id"), "model_id", "left_semi")
        .select("model_id", F.lit("PRODUCTION").alias("status"), F.lit("restored").alias("reason"))
    )
    return retired.unionByName(restored)
