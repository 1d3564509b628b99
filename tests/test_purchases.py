"""Label and report queries read every purchase, not only the totals that purchases are split from."""

import types

import pytest
from pyspark.sql import functions as F

from registered import survey
from tallyspark.operators import labels as L, merchants as M
from tallyspark.sources.tables import TASK_ROWS, tasks_for


@pytest.fixture(scope="module")
def t(spark):
    return types.SimpleNamespace(
        units=spark.createDataFrame([("1", 2.0, 1, 1), ("2", 1.0, 3, 1)], "NEWID string, FINLWT21 double, REGION int, quarter int"),
        items=spark.createDataFrame(
            [(u, code, cost, 2020, m) for u in "12" for code, cost in (("190111", "100.0"), ("270211", "70.5"), ("560110", "33"))
             for m in (1, 2, 3)], "NEWID string, UCC string, COST string, REFYR int, REFMO int"),
        tasks=lambda name: 13,
        hierarchy=spark.createDataFrame([("1", "Eggs", "190111"), ("1", "Electricity", "270211")], "level string, title string, ucc string"),
    )


@pytest.fixture(scope="module")
def purchases(t):
    rows = survey.labelled_transactions(t).collect()
    assert len(rows) > survey.totals(t).count() > 0
    return rows


def test_label_distribution_counts_purchases(t, purchases):
    want = {}
    for row in purchases:
        for label in row.categories.split(","):
            want[label] = want.get(label, 0) + 1
    assert {r.label: r.n for r in survey.label_distribution(t).collect()} == want


def test_binarised_labels_has_a_row_per_purchase(t, purchases):
    classes = survey.label_universe(t).first()[0].split(",")
    want = {tuple(r[:4]): ",".join(str(int(c in r.categories.split(","))) for c in classes) for r in purchases}
    assert {tuple(r[:4]): r.target for r in survey.binarised_labels(t).collect()} == want


def test_labels_through_json_has_a_row_per_purchase(t, purchases):
    want = {tuple(r[:4]): len(r.categories.split(",")) for r in purchases}
    assert {tuple(r[:4]): r.n_labels for r in survey.labels_through_json(t).collect()} == want


def test_average_monthly_spend_adds_up_purchases(t):
    spent = {}
    for r in survey.disaggregated_transactions(t).collect():
        months = spent.setdefault(r.major_category, {})
        months[r.period] = months.get(r.period, 0) + round(r.amount * 100)
    got = {r.major_category: r.avg_monthly for r in survey.average_monthly_spend(t).collect()}
    assert got == {c: sum(m.values()) / len(m) / 100 for c, m in spent.items()}


def test_transactions_per_category_counts_purchases(t, purchases):
    assert sum(r.n for r in survey.transactions_per_category(t).collect()) == len(purchases)


def test_label_coverage_is_of_purchases(t, purchases):
    sizes = [len(r.categories.split(",")) for r in purchases]
    assert tuple(survey.label_coverage(t).first()) == (sum(sizes) / len(sizes), min(sizes), sum(s >= 2 for s in sizes) / len(sizes))


def test_quality_report_looks_at_purchases(t):
    least = survey.disaggregated_transactions(t).agg(F.min("amount")).first()[0]
    assert {r.rule: r.value for r in survey.quality_report(t).collect()}["positive amounts"] == least


def test_tasks_that_group_items_keep_their_size(spark, t):
    assert tasks_for(spark, 1000 * TASK_ROWS + 1) == 1001 and tasks_for(spark, 0) >= 1
    plan = survey.totals(t)._jdf.queryExecution().toString()
    assert "hashpartitioning(NEWID" in plan and ", 13), REPARTITION_BY_NUM" in plan


def test_preferred_merchants_are_ranked_per_unit_not_per_purchase(t, spark):
    rows = survey.txn(t).unionByName(survey.txn(t).withColumn("persona_id", F.lit("9")))  # 9 is no unit
    some, none = survey.everyone(t), survey.everyone(t).limit(0)
    full = M.assign_merchants(rows.unionByName(rows.withColumn("major_category", F.lit("Unheard of"))), some)
    assert "_own" in full._jdf.queryExecution().toString()
    # The ranking per purchase, for personas that are no unit, gives what the ranking per unit gives.
    south = some.withColumn("region", F.lit(None).cast("int"))
    key = [*M.KEY, "description"]
    ranked = {tuple(r) for r in M.assign_merchants(rows, south).select(*key).collect()}
    assert ranked == {tuple(r) for r in M.assign_merchants(rows, none).select(*key).collect()}


def test_period_totals_deals_items_once(spark, t):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables too large to be sent by their size
    try:
        plan = survey.totals(t)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # No shuffle of items by code, and none by group after the units' items have been dealt.
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and ", 13)" in line]
    assert len(dealt) == 2 and plan.count("SortMergeJoin") == 1 and "LeftOuter, BuildRight" in plan


def test_text_set_splits_totals_last(spark, t, monkeypatch):
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(survey, "staged", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables too large to be sent by their size
    try:
        rows = survey.text_training_set(t).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == survey.txn(t).count()
    # Purchases are made behind every join and shuffle, and no list of items is collected.
    above = plans[0][: plans[0].index("Generate explode(sequence")]
    assert "Join" not in above and "Exchange" not in above and "collect_list" not in plans[0]


def test_rules_give_the_labels_of_the_names(spark):
    names = [["Eggs", "Gas and electric"], ["Unknown Item"], ["Health insurance", "Hospital, drugs"], [], ["Water insurance", "Meat"]]
    rows = spark.createDataFrame([(i, "Food", n) for i, n in enumerate(names)], "i int, major_category string, item_names array<string>")
    bits = F.aggregate(F.transform("item_names", L.name_rules), F.lit(0), lambda a, b: a.bitwiseOR(b))
    by_rules = L.assign_labels(rows.withColumn("rules", bits), rules="rules").select("i", "categories").collect()
    assert sorted(by_rules) == sorted(L.assign_labels(rows).select("i", "categories").collect())
