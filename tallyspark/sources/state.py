"""Append-only record of retraining runs."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from .schemas import RETRAIN_STATE
from .tables import path_exists


def append_once(rows: DataFrame, path: str, commit: str) -> bool:
    """Append rows under a commit name, at most once. False, and nothing written, where that commit is there already.

    Each commit has its own folder, named by a hash of the commit, which counts when Spark has marked it complete. A retried
    job finds its own commit; one that was lost half-way is written again in its place.
    """
    folder = f"{path.rstrip('/')}/commit-{hashlib.sha256(commit.encode()).hexdigest()[:32]}"
    if path_exists(rows.sparkSession, f"{folder}/_SUCCESS"):
        return False
    rows.write.mode("overwrite").parquet(folder)
    return True


def save_state(spark: SparkSession, path: str, model_type: str, when: dt.datetime, run_id: str) -> bool:
    """Append a run; a run id is recorded once per model type, however often its job is tried."""
    return append_once(spark.createDataFrame([(model_type, when, run_id)], RETRAIN_STATE), path, f"{model_type}|{run_id}")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """All recorded runs; none where nothing has been written."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], RETRAIN_STATE)
    return spark.read.schema(RETRAIN_STATE).option("recursiveFileLookup", True).parquet(path)


def latest_state(states: DataFrame) -> DataFrame:
    """Latest run per model type."""
    return states.groupBy("model_type").agg(
        F.max("last_retrain_date").alias("last_retrain_date"),
        F.max_by("run_id", F.struct("last_retrain_date", "run_id")).alias("run_id"),
    )


def load_state(spark: SparkSession, path: str, model_type: str) -> dt.datetime | None:
    """Date of the last retraining of a model type, or None. Reads one row."""
    row = latest_state(read_state(spark, path)).where(F.col("model_type") == model_type).first()
    return row.last_retrain_date if row else None
