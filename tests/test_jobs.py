"""The jobs that no registered query runs from end to end."""

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import labels as L, models as M
from tallyspark.operators.features import FEATURES, TARGET
from tallyspark.plans import jobs as J
from tallyspark.sources import schemas, state as ST

NOW = dt.datetime(2024, 3, 1)


def test_text_model_is_retrained_once_per_trigger(spark, tmp_path):
    words = {"Food": "bread milk", "Travel": "flight hotel"}
    signals = [
        (i, "u", i, words[c], i + 0.5, c if i else "Food", c, "accepted" if i else "override", NOW)
        for i, c in enumerate(["Travel", "Food"] * 5)
    ]
    feedback = spark.createDataFrame(signals, schemas.TEXT_FEEDBACK)
    # Amounts tell the rows apart: identical rows would be drawn together.
    external = spark.range(60).select(
        F.when(F.col("id") % 2 == 0, "bread milk eggs").otherwise("flight hotel train").alias("description"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("Food"))).otherwise(F.array(F.lit("Travel"))).alias("categories"),
        F.col("id").cast("double").alias("amount"), F.lit("USD").alias("currency"), F.lit("US").alias("country"), F.lit("train").alias("split"),
    )
    state = str(tmp_path / "state")
    done, reasons, model = J.retrain_text(spark, feedback, external, state, NOW, "one", max_iter=20)
    assert done and reasons == ["No previous retraining recorded"]
    asked = spark.createDataFrame([("milk and eggs",), ("hotel flight",)], "description string")
    assert [r.guess for r in model.transform(asked).collect()] == ["Food", "Travel"]
    # A day later one override in ten is no reason; an order is. A run counts once, however often it is tried.
    again = J.retrain_text(spark, feedback, external, state, NOW + dt.timedelta(days=1), "two", max_iter=1)
    assert again == (False, [], None) and ST.load_state(spark, state, "text") == NOW
    for _ in range(2):
        assert J.retrain_text(spark, feedback, external, state, NOW + dt.timedelta(days=2), "three", max_iter=1, force=True)[0]
    assert ST.read_state(spark, state).count() == 2
    assert ST.load_state(spark, state, "text") == NOW + dt.timedelta(days=2)


def trend_rows(spark, n=400, shift=0.0):
    features = [(F.col("id") % 23 * (i + 1) + shift).alias(f) for i, f in enumerate(FEATURES)]
    return spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("user_id"), F.lit("Food").alias("category"), *features,
        F.lit(100.0).alias(TARGET), F.when(F.col("id") % 4 == 3, "test").otherwise("train").alias("split"),
    )


def test_trend_model_is_retrained_on_moved_targets(spark, tmp_path):
    signals = spark.createDataFrame([(1, "u", "Food", 0.9, 100.0, 200.0, "expected", NOW)], schemas.TREND_FEEDBACK)
    state, quick = str(tmp_path / "state"), dataclasses.replace(M.REFIT, trees=2)
    rows = trend_rows(spark)
    done, _, model = J.retrain_trend(spark, signals, rows, state, NOW, "one", params=quick)
    # Targets of u move from 100 to 130; of v's rows half are for training, of u's all.
    moved = rows.where("split = 'train'").agg(F.avg(F.when(F.col("user_id") == "u", 130.0).otherwise(100.0))).first()[0]
    predicted = model.predict(rows).agg(F.avg("predicted")).first()[0]
    assert done and predicted == pytest.approx(moved, abs=1.0)
    later = NOW + dt.timedelta(days=1)
    assert not J.retrain_trend(spark, signals, rows, state, later, "two", params=quick)[0]
    drifted = J.retrain_trend(
        spark, signals, rows, state, later, "two", reference=rows, current=trend_rows(spark, shift=500.0), params=quick
    )
    assert drifted[0] and drifted[1] and ST.load_state(spark, state, "trend") == later


def test_survey_job_writes_its_sets(spark, tmp_path):
    units = spark.range(60).select(
        F.col("id").cast("string").alias("NEWID"), F.lit(1.5).alias("FINLWT21"), (F.col("id") % 5).cast("int").alias("REGION"),
        F.lit(1).alias("quarter"),
    )
    items = spark.range(60 * 8 * 2).select(
        (F.col("id") % 60).cast("string").alias("NEWID"),
        F.when(F.floor(F.col("id") / 480) % 2 == 0, "10110").otherwise("260110").alias("UCC"),
        (F.col("id") % 90 + 10).cast("string").alias("COST"), F.lit(2023).alias("REFYR"),
        (F.floor(F.col("id") / 60) % 8 + 1).cast("int").alias("REFMO"),
    )
    codes = spark.createDataFrame([("1", "Flour", "010110"), ("1", "Electricity", "260110")], schemas.HIERARCHY)
    tables = J.survey_sets(spark, units, items, codes, str(tmp_path / "out"))
    n = tables["text"].count()
    report = tables["report"].first()
    assert report.n_rows == n == tables["counts"].agg(F.sum("n")).first()[0] and report.n_persona_id == 60
    splits = {r.split: r.n for r in tables["text"].groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert splits == {"train": int(n * 0.8), "val": int(n * 0.9) - int(n * 0.8), "test": n - int(n * 0.9)}
    assert L.parse_labels(tables["text"]).where(F.size("categories") < 2).isEmpty()
    trend = tables["trend"]
    assert {"persona_id", "split", TARGET, *FEATURES} <= set(trend.columns)
    last, first = (trend.where(F.col("split") == s).agg(f("period")).first()[0] for s, f in (("train", F.max), ("test", F.min)))
    assert last <= first
    assert {r.rule: r.passed for r in tables["issues"].collect()} == {
        "labels per transaction": True, "positive amounts": True, "personas": False,
    }
    assert J.survey_sets(spark, units, items, codes, str(tmp_path / "few"), n=20)["report"].first().n_persona_id == 20
