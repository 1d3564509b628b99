import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window, functions as F, types as T

from tallyspark.functions.draws import row_hash
from tallyspark.operators import (
    drift as D, evaluate as E, explain as X, feedback as FB, isolation as I, labels as L, promote as G, survey as S,
)
from tallyspark.sources import ledger_store as LS, schemas, state as ST, survey_files as SV, tables as TB

NOW = dt.datetime(2024, 3, 1)


def test_first_matching_item_rule_wins(spark):
    rows = spark.createDataFrame(
        [("Transportation", ["Gasoline"]), ("Education", ["Meat and gas"]), ("Education", ["Health INSURANCE drug"]), ("Zoo", [])],
        "major_category string, item_names array<string>",
    )
    got = [r.categories for r in L.assign_labels(rows).collect()]
    assert got[0] == ["Auto", "Bills", "Gas", "Transportation", "Utilities"]
    assert got[1] == ["Books", "Education", "Food", "Groceries", "Tuition"]
    assert got[2] == ["Books", "Education", "Insurance", "Tuition"]
    assert got[3] == ["Miscellaneous", "Zoo"]


def units(spark, weights):
    return spark.createDataFrame([(str(i), w, 9) for i, w in enumerate(weights)], "NEWID string, FINLWT21 double, REGION int")


def test_weighted_sample(spark):
    sampled = S.sample_units(units(spark, [1.0, 2.0, 3.0, 0.0, 5.0, 1.0]), 3)
    assert sampled.count() == 3 and "region" in sampled.columns
    assert "3" not in {r.NEWID for r in sampled.collect()}


@pytest.mark.parametrize("weights", [[0.0, 0.0], [1.0, -2.0, None]])
def test_too_few_positive_weights_is_an_error(spark, weights):
    with pytest.raises(Exception, match="positive weight"):
        S.sample_units(units(spark, weights), 3).collect()


def test_totals_drop_non_positive_and_unparsable(spark):
    items = spark.createDataFrame(
        [("1", "10110", "5.00", 2024, 1), ("1", "10110", "n/a", 2024, 1), ("1", "990000", "-3", 2024, 1), ("2", "10110", "9", 2024, 1)],
        schemas.ITEMS,
    )
    codes = spark.createDataFrame([("1", "Eggs", "010110")], "level string, title string, ucc string")
    got = S.item_lists(S.period_totals(items, units(spark, [1.0, 1.0]).where("NEWID = '1'"), codes)).collect()
    assert [(r.major_category, r.total_cents, r.item_count, r.item_names) for r in got] == [("Food", 500, 2, ["Eggs", "Eggs"])]


def test_psi_edges(spark):
    flat = spark.createDataFrame([(1.0,)] * 20, "x double")
    assert D.psi(flat, flat, ["x"]).first().psi == 0.0
    rows = spark.range(100).select((F.col("id") * 1.0).alias("x"), F.lit(1.0).alias("y"))
    assert D.psi(rows, rows, ["x"]).first().psi == 0.0
    few = D.drift_report(rows.limit(9), rows, ["x"]).first()  # kept, without a PSI and without flags
    assert (few.feature, few.n_ref, few.psi, few.enough_values, few.alert, few.retrain) == ("x", 9, None, False, False, False)
    assert [r.feature for r in D.drift_report(rows, rows.drop("y"), ["x", "y", "z"]).collect()] == ["x"]


def test_psi_equals_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=300), rng.normal(0.5, size=200)
    edges = np.linspace(min(a.min(), b.min()), max(a.max(), b.max()), 11)
    pa = (np.histogram(a, edges)[0] + 1e-8) / (300 + 1e-7)
    pb = (np.histogram(b, edges)[0] + 1e-8) / (200 + 1e-7)
    frames = [spark.createDataFrame([(float(v),) for v in x], "x double") for x in (a, b)]
    assert D.psi(*frames, ["x"]).first().psi == pytest.approx(float(np.sum((pb - pa) * np.log(pb / pa))), rel=1e-9)


def feedback(spark, rows):
    return spark.createDataFrame(
        [(i, u, c, None, None, a, t, NOW + dt.timedelta(hours=h)) for i, (u, c, a, t, h) in enumerate(rows)], schemas.TREND_FEEDBACK
    )


def test_blend_is_sequential(spark):
    signals = feedback(spark, [("u", "A", 10.0, "expected", 5), ("u", "A", 50.0, "expected", 1), ("u", "A", 0.0, "expected", 2),
                               ("u", "A", 99.0, "helpful", 3), ("u", "A", 7.0, "expected", 5)])
    train = spark.createDataFrame([("u", "A", 100.0), ("v", "A", 1.0)], "user_id string, category string, next_month_spend double")
    got = {r.user_id: r.next_month_spend for r in FB.blend_expected(train, signals).collect()}
    t = 100.0
    for a in (50.0, 10.0, 7.0):
        t = 0.7 * t + 0.3 * a
    assert got["u"] == pytest.approx(t) and got["v"] == 1.0
    assert FB.blend_expected(train.drop("user_id"), signals).columns == ["category", "next_month_spend"]


def text_signals(spark, n, overrides):
    return spark.range(n).select(F.when(F.col("id") < overrides, "override").otherwise("accepted").alias("feedback_type"))


def test_triggers(spark):
    week = NOW - dt.timedelta(days=6)
    assert not FB.text_trigger(text_signals(spark, 20, 3), NOW, week).first().should_retrain  # exactly 15 %
    assert FB.text_trigger(text_signals(spark, 20, 4), NOW, week).first().reasons == ["Override rate 20.0% > threshold 15.0%"]
    assert FB.text_trigger(text_signals(spark, 0, 0), NOW).first().reasons == ["No previous retraining recorded"]
    assert FB.trend_trigger(spark.range(9), NOW, NOW - dt.timedelta(days=28)).first().reasons == ["Scheduled: 28 days since last retrain"]
    quiet = FB.trend_trigger(spark.range(9), NOW, week)
    assert not FB.decide(quiet).first().retrain and FB.decide(quiet, force=True).first().retrain


def test_gates(spark):
    metrics = spark.createDataFrame(
        [(1, "xgb_test_rmse", 105.0), (1, "xgb_test_mae", 10.0), (1, "xgb_precision_at_5", 0.2), (2, "xgb_test_rmse", 106.0)],
        "run_id int, metric string, value double",
    )
    serving = spark.createDataFrame([("xgb_test_rmse", 100.0)], "metric string, value double")
    got = {(r.run_id, r.gate): (r.passed, r.reason) for r in G.gate_results(metrics, G.trend_gates(), serving).collect()}
    assert got[1, "xgb_test_rmse"] == (True, "PASS") and got[1, "xgb_test_mae"] == (True, "PASS")
    assert got[1, "xgb_precision_at_5"] == (False, "0.2000 < min(0.4)")
    assert got[2, "xgb_test_rmse"] == (False, "106.0000 > 1.05x production(100.0000)")
    assert got[2, "xgb_test_mae"][0] is False
    with pytest.raises(ValueError):
        G.gates_for("other")


def test_ties_go_to_the_later_factor(spark):
    rows = spark.createDataFrame([([("a", 1.0, 2.0), ("b", 1.0, -2.0), ("c", 1.0, 1.0), ("d", 1.0, 0.5)],)],
                                 "attributions array<struct<feature:string,value:double,attribution:double>>")
    got = rows.select(X.top_factors().alias("f")).first().f
    assert [(f.feature, f.direction) for f in got] == [("b", "decreased"), ("a", "increased"), ("c", "increased")]


@pytest.mark.parametrize("n, tail", [(0, "($1,234.50)."), (1, "driven by: higher a."), (2, "driven by: higher a and lower b.")])
def test_alert_text(spark, n, tail):
    factors = [("increased", "a"), ("decreased", "b")][:n]
    rows = spark.createDataFrame([(factors,)], "f array<struct<direction:string,description:string>>")
    text = rows.select(X.alert_text(F.lit("Food"), F.lit(2469.0), F.lit(1234.5), F.lit(100.0), F.col("f")).alias("t")).first().t
    assert text.startswith("Your Food spending this month ($2,469.00) is 100% higher than expected") and text.endswith(tail)


def test_metrics_of_a_constant_target(spark):
    rows = spark.createDataFrame([("s", 1.0, 1.0), ("t", 1.0, 2.0), ("t", 1.0, 0.0)], "split string, y double, p double")
    assert {r.split: r.r2 for r in E.regression_metrics(rows, "y", "p").collect()} == {"s": 1.0, "t": 0.0}


def test_isolation_finds_the_odd_row(spark):
    rows = spark.range(400).select("id", F.sin("id").alias("a"), F.cos(F.col("id") * 2).alias("b")).unionByName(
        spark.createDataFrame([(999, 50.0, -50.0)], "id bigint, a double, b double")
    )
    forest = I.fit_forest(rows, ["a", "b"], trees=20, rows_per_tree=64)
    assert forest.count() <= 20 * 127
    scored = I.isolation_score(rows, forest, ["a", "b"])
    best = scored.orderBy(F.desc("isolation")).first()
    assert best.id == 999 and 0 < best.isolation < 1


def test_sources(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        TB.read_table(spark, "x.txt")
    with pytest.raises(ValueError, match="missing columns"):
        TB.require_columns(spark.range(1), ["id", "nope"])
    assert TB.read_feedback(spark, None, schemas.TEXT_FEEDBACK).count() == 0
    rows = spark.range(50).select("id", F.lit("x").alias("t"))
    one, other = (TB.fingerprint(r).first() for r in (rows, rows.repartition(7).orderBy(F.desc("id"))))
    assert one == other and one != TB.fingerprint(rows.limit(49)).first()
    path = str(tmp_path / "state")
    assert ST.load_state(spark, path, "trend") is None
    ST.save_state(spark, path, "trend", NOW, "a")
    ST.save_state(spark, path, "trend", NOW - dt.timedelta(days=3), "b")
    assert ST.load_state(spark, path, "trend") == NOW


def test_user_filter_is_a_literal(spark):
    tx = spark.createDataFrame([(1, 1, "d", 5.0, NOW)], "id int, transaction_journal_id int, description string, amount double, date timestamp_ntz")
    journals = spark.createDataFrame([(1, "u", 1, 1)], "id int, user_id string, category_id int, budget_id int")
    categories = spark.createDataFrame([(1, "Food")], "id int, name string")
    assert LS.ledger(tx, journals, categories, NOW, user="u").count() == 1
    assert LS.ledger(tx, journals, categories, NOW, user="x' or '1'='1").count() == 0


def test_multilabel_metrics(spark):
    rows = spark.createDataFrame(
        [(1, "a", 1, 0.9), (1, "b", 0, 0.1), (2, "a", 1, 0.6), (2, "b", 0, 0.6), (3, "a", 0, 0.2), (3, "b", 1, 0.3)],
        "row_id int, label string, actual int, prob double",
    )
    m = E.multilabel_metrics(rows).first()
    assert m.exact_match_accuracy == pytest.approx(1 / 3) and m.subset_accuracy == pytest.approx(2 / 3)
    assert m.micro_f1 == pytest.approx(4 / 6) and m.min_class_recall == 0.0
    assert m.abstention_rate == pytest.approx(2 / 3) and math.isclose(m.macro_f1, 0.5)


def test_distinct_values_by_bitmap_and_by_group(spark):
    from tallyspark.operators import profile as P

    rows = [(i % 7 - 3, i * 10**15 % 13 - 6 * 10**15 * (i % 3), i % 90_000 - 45_000, None if i % 5 else dt.date(1960, 1, 1) + dt.timedelta(i % 800),
             None, f"s{i % 11}" if i % 4 else None, 0.0 if i % 2 else -0.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "near int, far bigint, wide int, day date, none int, text string, zero double")
    counts = P.distinct_counts(df, df.columns)
    plan = counts._jdf.queryExecution().toString()
    assert "Expand" not in plan and plan.count("bitmap_construct_agg") > 0
    got = counts.first().asDict()
    want = {f"n_{c}": len({r[i] for r in rows} - {None}) for i, c in enumerate(df.columns)}
    assert got == {"n_rows": 3000, **want}
    assert P.distinct_counts(df.limit(0), ["near", "text"]).first() == (0, 0, 0)


def test_set_sizes_and_their_rules(spark):
    from tallyspark.operators import profile as P

    text = spark.range(10).select((F.col("id") * 1.5).alias("amount"), F.lit("train").alias("split"))
    trend = spark.range(1000).select(F.lit(2.0).alias("next_month_spend"), F.lit("val").alias("split"))
    sizes = P.set_sizes(text, trend)
    row = sizes.first()
    assert (row.text_train, row.trend_val, row.amount_median, row.target_std) == (10, 1000, 6.75, 0.0)
    issues = {r.rule: r.passed for r in P.quality_issues(sizes, P.SIZE_RULES).collect()}
    assert issues == {"trend rows": True, "text rows": False}


@pytest.mark.parametrize("rows, per_tree", [(3000, 40), (25, 40), (0, 40)])
def test_each_tree_draws_its_rows_from_the_whole_table(spark, rows, per_tree):
    df = spark.range(rows).select("id", (F.col("id") * 1.5).alias("a"), F.lit(None).cast("double").alias("b"))
    drawn = I.draw_rows(df.repartition(5), ["a", "b"], 12, per_tree, seed=7, key=["id"]).collect()
    place = F.shiftrightunsigned(F.xxhash64(F.lit(7), "tree", row_hash(7, "id")), 12)
    ranked = df.crossJoin(spark.range(12).select(F.col("id").cast("int").alias("tree"))).withColumn(
        "r", F.row_number().over(Window.partitionBy("tree").orderBy(place, "a"))
    )
    want = {(r.tree, r.a) for r in ranked.where(F.col("r") <= per_tree).collect()}
    assert {(r.tree, r.a) for r in drawn} == want and all(r._take == 1 and r.b == 0.0 for r in drawn)
    assert len(drawn) == 12 * min(rows, per_tree)


def test_equal_rows_take_the_room_there_is(spark):
    df = spark.range(100_000).select(F.when(F.col("id") < 1000, F.col("id")).otherwise(-1).cast("double").alias("a"))
    drawn = I.draw_rows(df, ["a"], 30, 64)
    totals = drawn.groupBy("tree").agg(F.sum("_take").alias("n"), F.count("*").alias("rows")).collect()
    assert len(totals) == 30 and all(r.n == 64 and r.rows <= 64 for r in totals)
    assert I.fit_forest(df, ["a"], trees=30, rows_per_tree=64).select("tree").distinct().count() == 30


def test_a_run_is_recorded_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert ST.save_state(spark, path, "trend", NOW, "a") and not ST.save_state(spark, path, "trend", NOW, "a")
    assert ST.save_state(spark, path, "text", NOW, "a") and ST.read_state(spark, path).count() == 2
    # A commit that was lost before Spark marked it complete is written again in its place.
    for mark in (tmp_path / "runs").glob("*/_SUCCESS"):
        mark.unlink()
    assert ST.save_state(spark, path, "trend", NOW, "a") and ST.read_state(spark, path).count() == 2


def test_survey_files_are_read_by_their_headers(spark, tmp_path):
    schema = T.StructType([T.StructField("NEWID", T.LongType()), T.StructField("W", T.DoubleType()), T.StructField("R", T.StringType())])
    (tmp_path / "in trvw+1").mkdir()
    (tmp_path / "in trvw+1" / "fmli231.csv").write_text("NEWID,W,R\n1,2.5,a\n2,.,\"x, y\"\n")
    (tmp_path / "in trvw+1" / "FMLI232X.CSV").write_text("﻿r,EXTRA,newid,EXTRA\nb,9,3,8\n")
    (tmp_path / "in trvw+1" / "fmli233.csv").write_text("")
    (tmp_path / "in trvw+1" / "mtbi231.csv").write_text("NEWID,COST\n1,5\n")
    (tmp_path / "in trvw+1" / "fmli231.txt").write_text("NEWID,W,R\n7,7,7\n")
    spark.range(4, 6).selectExpr("id as NEWID", "'p' as R").write.option("header", True).csv(str(tmp_path / "fmli241.csv"))
    rows = SV.read_survey(spark, str(tmp_path), r"^fmli\d+x?\.csv$", schema)
    assert sorted(rows.collect(), key=lambda r: r.NEWID) == [
        (1, 2.5, "a", "fmli231.csv"), (2, None, "x, y", "fmli231.csv"), (3, None, "b", "FMLI232X.CSV"),
        (4, None, "p", "fmli241.csv"), (5, None, "p", "fmli241.csv"),
    ]
    for pattern in (r"^expd", r"^fmli233"):
        with pytest.raises(ValueError, match="no files"):
            SV.read_survey(spark, str(tmp_path), pattern, schema)
