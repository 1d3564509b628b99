import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import features as FT, monthly as MO

SCHEMA = "user_id string, category_name string, amount double, transaction_date timestamp_ntz"


def day(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def ledger(spark):
    rows = []
    for month, amounts in {1: [10.0, 20.0], 2: [30.0, 30.0], 4: [100.0, 20.0], 5: [5.0, 5.0]}.items():
        rows += [("u", "Food", a, day(f"2024-{month:02d}-{5 + 20 * i:02d}")) for i, a in enumerate(amounts)]
    rows[3] = ("u", "Food", 30.0, day("2024-02-25 10:00:00"))
    rows += [("u", None, 50.0, day("2024-02-03")), ("u", "Once", 7.0, day("2024-02-03"))]
    rows += [("u", "Food", None, day("2024-02-10")), (None, "Food", 9.0, day("2024-02-10"))]
    return spark.createDataFrame(rows, SCHEMA)


def by_month(df):
    return {r.period.month: r for r in df.collect()}


def test_null_category_counts_only_in_the_total(ledger):
    months = MO.monthly(ledger).collect()
    assert {r.category for r in months} == {"Food", "Once"}
    february = [r for r in months if r.category == "Food" and r.period.month == 2][0]
    assert february.total == 6000 + 5000 + 700
    assert february.txn_count == 2  # the null amount is not counted


def test_windows_count_months_present(ledger):
    got = by_month(FT.trend_features(ledger, training=False))
    assert sorted(got) == [2, 4, 5]  # March is absent, January has no history
    assert got[4].rolling_mean_1m == 60.0
    assert got[4].rolling_mean_3m == 45.0
    assert got[4].rolling_std_3m == 15.0
    assert got[2].rolling_std_3m == 0.0
    assert got[4].deviation_ratio == pytest.approx(120 / 45)
    assert got[2].spending_velocity == 1.0


def test_days_since_last_are_whole_days(ledger):
    got = by_month(FT.trend_features(ledger, training=False))
    assert got[4].days_since_last_txn == 35  # 2024-02-25 10:00 to 2024-04-01 is 35 days and 14 hours


def test_target_is_the_next_present_month(ledger):
    got = by_month(FT.trend_features(ledger))
    assert sorted(got) == [2, 4]
    assert got[2].next_month_spend == 120.0 and got[4].next_month_spend == 10.0


def test_elevated_and_budget(spark, ledger):
    budgets = spark.createDataFrame([("u", "Food", 60.0)], "user_id string, category string, budget double")
    got = by_month(FT.trend_features(ledger, budgets, training=False))
    assert got[2].elevated_cat_count == 1 and got[4].elevated_cat_count == 1 and got[5].elevated_cat_count == 0
    assert got[4].budget_utilization == 2.0
    nothing = spark.createDataFrame([("u", "Food", 0.0)], budgets.schema)
    assert by_month(FT.trend_features(ledger, nothing, training=False))[4].budget_utilization == 0.0


def test_single_month_gives_no_row(spark):
    one = spark.createDataFrame([("u", "x", 5.0, day("2024-01-01"))], SCHEMA)
    assert FT.trend_features(one, variant=FT.Variant(eligible=None), training=False).count() == 0


def test_all_null_amounts_sum_to_zero(spark):
    rows = spark.createDataFrame([("u", "x", None, day("2024-01-01")), ("u", "x", None, day("2024-01-06"))], SCHEMA)
    month = MO.monthly(rows).first()
    assert (month.spend, month.txn_count, month.weekend_txns, month.total) == (0, 0, 1, 0)


def test_outliers_use_the_category_median(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 11.0), ("b", 5.0)], "category string, current_spend double")
    flagged = FT.flag_outliers(rows, 10).collect()
    assert sorted((r.category, r.current_spend) for r in flagged if r._is_outlier) == [("a", 11.0)]


def test_presented_rounding(ledger):
    row = FT.present(FT.trend_features(ledger)).where("period = '2024-04'").first()
    assert row.deviation_ratio == 2.6667 and row.current_spend == 120.0


def test_plan_reads_the_ledger_once(spark, tmp_path, ledger):
    ledger.write.parquet(str(tmp_path / "l.parquet"))
    plan = FT.trend_features(spark.read.parquet(str(tmp_path / "l.parquet")))._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("FileScan") == 1
    assert physical.count("Exchange hashpartitioning") == 4
    assert "SinglePartition" not in physical


def test_medians_are_broadcast_so_rows_are_not_dealt_by_category(spark):
    rows = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("A", 30.0)], "category string, current_spend double")
    flagged = FT.flag_outliers(rows, 1)
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(category" not in plan
    assert {r.current_spend for r in flagged.where("_is_outlier").collect()} == {30.0}
