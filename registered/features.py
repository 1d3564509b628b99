"""Ledger rollups and the trend features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyspark.functions.money import dollars
from tallyspark.operators import features as FT, monthly as MO
from tallyspark.plans.jobs import feature_table
from tallyspark.sources.ledger_store import active_budgets

from .registry import query
from .views import ASOF

# Averages of ratios are added up in a different order by the two engines: compared at 9 digits.
AVERAGED = ("hist_share_of_wallet", "hist_avg_txn_size")
_SQL_FEATURES = ", ".join(f"round({c}, 9) as {c}" if c in AVERAGED else c for c in FT.FEATURES)


def comparable(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in AVERAGED if c in df.columns})


@query("month_rollup", "A1 A2 A3 A4", "select * from month_rows", ("month_rows",))
def month_rollup(t):
    return MO.month_totals(t.ledger)


@query("month_rollup_with_user_total", "A5 J3 J4", "select * from months", ("months",))
def month_rollup_with_user_total(t):
    return MO.monthly(t.ledger)


@query("eligible_pairs", "A7", """
select user_id, category, count(*) as n_months, sum(txn_count) / count(*) as avg_txn from months
group by all having count(*) >= 3 and sum(txn_count) / count(*) >= 2""", ("months",))
def eligible_pairs(t):
    return MO.eligible_pairs(MO.monthly(t.ledger))


@query("eligible_months", "J5", """
select user_id, category, period, spend, total from hist""", ("hist",))
def eligible_months(t):
    return MO.keep_eligible(MO.monthly(t.ledger)).select("user_id", "category", "period", "spend", "total")


@query("elevated_categories", "A8 W10 J11", "select * from elevated_n", ("elevated_n",))
def elevated_categories(t):
    return MO.elevated_counts(MO.keep_eligible(MO.monthly(t.ledger)))


@query("rolling_history", "W1 W2 W3 W4 W5 W6 W7", """
select user_id, category, period, i as row_index, prev as prev_spend, mean3, mean6,
  case when i >= 2 then raw_std3 else 0 end as std3, case when i >= 2 then raw_std6 else 0 end as std6,
  round(hist_share, 9) as hist_share, hist_count, round(hist_size, 9) as hist_size, next_spend
from hist_all""", ("hist_all",))
def rolling_history(t):
    h = FT.history(MO.monthly(t.ledger))
    return h.select(
        "user_id", "category", "period", F.col("row").alias("row_index"), F.col("prev1").alias("prev_spend"),
        "mean3", "mean6", "std3", "std6", F.round("hist_share", 9).alias("hist_share"), "hist_count",
        F.round("hist_size", 9).alias("hist_size"), "next_spend",
    )


@query("trend_features_training", "W8 W9 P11 P15", f"""
select user_id, category, period, {_SQL_FEATURES}, next_month_spend from trend""", ("trend",))
def trend_features_training(t):
    return comparable(FT.trend_features(t.ledger))


@query("trend_features_inference", "W8 W9 P15", f"""
select user_id, category, period, {_SQL_FEATURES} from features""", ("features",))
def trend_features_inference(t):
    return comparable(FT.trend_features(t.ledger, training=False))


_BUDGETED = _SQL_FEATURES.replace(
    "budget_utilization", "case when budget > 0 then current_spend / budget else 0 end as budget_utilization")


@query("trend_features_budgeted", "J8 J9 S6", f"""
select user_id, category, period, {_BUDGETED}, next_month_spend
from trend left join active using (user_id, category)""", ("trend", "active"))
def trend_features_budgeted(t):
    budgets = active_budgets(t.budget_limits, t.budgets, ASOF)
    return comparable(FT.trend_features(t.ledger, budgets))


def _variant(floor: str, days: str, velocity: str, weekend: str, elevated: str) -> str:
    """All 20 features of a set whose first row is the fourth month of a pair."""
    return f"""
select user_id, category, period, spend / 100.0::double as current_spend, prev / 100.0::double as rolling_mean_1m,
  mean3 as rolling_mean_3m, mean6 as rolling_mean_6m, raw_std3 as rolling_std_3m, raw_std6 as rolling_std_6m,
  least((spend / 100.0::double) / greatest(mean3, {floor}::double), 10.0::double) as deviation_ratio,
  (spend / 100.0::double) / greatest(total / 100.0::double, {floor}::double) as share_of_wallet,
  round(hist_share, 9) as hist_share_of_wallet, txn_count, hist_count as hist_txn_count_mean,
  (spend / 100.0::double) / greatest(txn_count, 1) as avg_txn_size, round(hist_size, 9) as hist_avg_txn_size,
  {days} as days_since_last_txn, month(period) as month_of_year, {velocity} as spending_velocity,
  {weekend} as weekend_txn_ratio, total / 100.0::double as total_monthly_spend, {elevated} as elevated_cat_count,
  0.0::double as budget_utilization, next_spend / 100.0::double as next_month_spend
from (select *, sum(case when i >= 3 and mean3 > 0 and spend / 100.0::double > mean3 * 1.2::double then 1 else 0 end)
        over (partition by user_id, period)::bigint as e from hist_all)
where i >= 3 and next_spend is not null"""


_OWN_MONTHS = " + ".join(
    f"case when {c} / 100.0::double > mean3 * 1.2::double then 1 else 0 end" for c in ("spend", "prev", "prev2", "prev3"))


@query("trend_features_survey", "W8 W11", _variant(
    "1e-8", "15::bigint", "(spend / 100.0::double) / greatest(mean3, 1e-8::double) * 0.5", "null::double",
    f"({_OWN_MONTHS})::bigint"), ("hist_all",))
def trend_features_survey(t):
    return comparable(FT.trend_features(t.ledger, variant=FT.SURVEY))


@query("trend_features_simulated", "W8 A8", _variant(
    "0.01", "greatest(0, floor((epoch(period::timestamp) - epoch(prev_last)) / 86400))::bigint",
    "(mid_spend / 100.0::double) / greatest(mean3, 0.01::double)", "weekend_txns / greatest(txn_count, 1)", "e"),
       ("hist_all",))
def trend_features_simulated(t):
    return comparable(FT.trend_features(t.ledger, variant=FT.SIMULATED))


@query("category_medians", "A9", """
select category, median((round(current_spend * 100))::bigint) / 100.0::double as median_spend from trend group by all""",
       ("trend",))
def category_medians(t):
    return FT.category_medians(t.trend)


@query("feature_table_with_outliers", "A9 J19 P12 S10", """
select user_id, category, period, current_spend, next_month_spend, current_spend > 10.0::double * m as _is_outlier
from trend join (select category, median((round(current_spend * 100))::bigint) / 100.0::double as m
  from trend group by all) using (category)""", ("trend",))
def feature_table_with_outliers(t):
    return feature_table(t.ledger, rounded=False).select(
        "user_id", "category", "period", "current_spend", "next_month_spend", "_is_outlier"
    )


def _half_up(column: str) -> str:
    """Half up on the decimal text of a double."""
    digits = 4 if column in FT.RATIOS else 2
    return f"round({column}::varchar::decimal(38, 18), {digits})::double as {column}"


_PRESENTED = [c for c in (*FT.FEATURES, FT.TARGET) if c not in AVERAGED]


@query("presented_feature_table", "A9 J19 P12 S10 P15", f"""
select user_id, category, strftime(period, '%Y-%m') as period, {", ".join(
    _half_up(c) if c in (*FT.MONEY, *FT.RATIOS, FT.TARGET) else c for c in _PRESENTED)},
  current_spend > 10.0::double * m as _is_outlier
from trend join (select category, median((round(current_spend * 100))::bigint) / 100.0::double as m
  from trend group by all) using (category)""", ("trend",))
def presented_feature_table(t):
    """The feature job's output. An average of ratios may round to either side of a tie in another engine, so these two
    are left to the unit test of ``present``."""
    return feature_table(t.ledger).drop(*AVERAGED)


@query("outliers_at_twice_the_median", "P12", """
select category, count(*) as n, count(*) filter (where current_spend > 2.0::double * m) as n_outlier
from trend join (select category, median((round(current_spend * 100))::bigint) / 100.0::double as m
  from trend group by all) using (category) group by all""", ("trend",))
def outliers_at_twice_the_median(t):
    return FT.flag_outliers(t.trend, 2).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_is_outlier").alias("n_outlier")
    )


@query("feature_vectors", "P15", f"""
select user_id, category, period, {", ".join(
    f"round({c}, 9)::double as {c}" if c in AVERAGED else f"{c}::double as {c}" for c in FT.FEATURES)} from trend""",
       ("trend",))
def feature_vectors(t):
    return comparable(FT.feature_vector(t.trend))


@query("spend_of_one_user", "P3 T1", """
select category, period, spend / 100.0::double as spend from months where user_id = '7' order by category, period""",
       ("months",))
def spend_of_one_user(t):
    months = MO.monthly(t.ledger.where(F.col("user_id") == F.lit("7")))
    return months.select("category", "period", dollars("spend").alias("spend")).orderBy("category", "period")
