"""Anomaly scores and explanations. The three-month mean stands in for a model's prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import explain as X
from tallyspark.operators.features import FEATURES
from tallyspark.sources.tables import staged

from .features import AVERAGED
from .registry import query
from .views import TWINS

# A given linear model over all 20 features; powers of two, so that its products are exact in any engine.
COEFFICIENTS = {
    "current_spend": 0.25, "rolling_mean_1m": -0.5, "rolling_mean_3m": 0.0625, "rolling_mean_6m": 0.125,
    "rolling_std_3m": -0.25, "rolling_std_6m": 0.03125, "deviation_ratio": 2048.0, "share_of_wallet": -4096.0,
    "hist_share_of_wallet": 8192.0, "txn_count": 64.0, "hist_txn_count_mean": -128.0, "avg_txn_size": 0.125,
    "hist_avg_txn_size": -0.25, "days_since_last_txn": -16.0, "month_of_year": 32.0, "spending_velocity": 1024.0,
    "weekend_txn_ratio": -512.0, "total_monthly_spend": -0.0625, "elevated_cat_count": 256.0, "budget_utilization": 512.0,
}
THRESHOLD = 0.4
# Fixed values, stated apart from the library's.
_WORDS = {
    "current_spend": "current spending", "rolling_mean_1m": "last month''s average", "rolling_mean_3m": "3-month average",
    "rolling_mean_6m": "6-month average", "rolling_std_3m": "3-month spending variability",
    "rolling_std_6m": "6-month spending variability", "deviation_ratio": "deviation from 3-month average",
    "share_of_wallet": "share of total spending", "hist_share_of_wallet": "historical share of spending",
    "txn_count": "number of transactions", "hist_txn_count_mean": "typical transaction count",
    "avg_txn_size": "average transaction size", "hist_avg_txn_size": "typical transaction size",
    "days_since_last_txn": "days since last transaction", "month_of_year": "time of year",
    "spending_velocity": "spending pace this month", "weekend_txn_ratio": "weekend spending pattern",
    "total_monthly_spend": "total monthly spending", "elevated_cat_count": "number of elevated categories",
    "budget_utilization": "budget utilization",
}

TWINS.update(
    {
        "scored": (("trend",), """
select *, (away - min(away) over ()) / (max(away) over () - min(away) over () + 1e-8::double) as anomaly_score
from (select *, abs(current_spend - rolling_mean_3m) as away from trend)"""),
        "attributed": (("trend",), f"""
select user_id, category, period, a.feature, a.idx, a.value, a.attribution, a.words from (
  select user_id, category, period, unnest([{", ".join(
      f"{{'feature': '{f}', 'idx': {i}, 'value': {f'round({f}, 9)' if f in AVERAGED else f}::double, "
      f"'attribution': {COEFFICIENTS[f]}::double * ({f}::double - avg({f}) over ()), 'words': '{_WORDS[f]}'}}"
      for i, f in enumerate(FEATURES)
  )}]) as a from trend)"""),
        "factors": (("attributed",), """
select user_id, category, period, list((feature, attribution > 0, words) order by abs(attribution) desc, idx desc)[1:3] as f
from attributed group by all"""),
        "explained": (("scored", "factors"), f"""
select user_id, category, period, anomaly_score, rolling_mean_3m as predicted_spend, current_spend as actual_spend,
  case when current_spend > rolling_mean_3m then 1 else -1 end as direction,
  abs(current_spend - rolling_mean_3m) / greatest(rolling_mean_3m, 1e-8::double) * 100 as magnitude_pct, f
from scored join factors using (user_id, category, period) where anomaly_score > {THRESHOLD}"""),
    }
)


def scored(t):
    return X.anomaly_scores(staged(t.trend, "trend"), predicted="rolling_mean_3m")


def explained(t):
    features = staged(t.trend, "trend")
    anomalies = X.keep_anomalies(X.anomaly_scores(features, predicted="rolling_mean_3m"), THRESHOLD)
    return X.explain(X.attribute(anomalies, COEFFICIENTS, background=features), predicted="rolling_mean_3m")


@query("normalised_amounts", "W17", """
select transaction_id, amount, (amount - min(amount) over ()) / (max(amount) over () - min(amount) over () + 1e-8::double) as scaled
from ledger""", ("ledger",))
def normalised_amounts(t):
    return X.normalise(t.ledger.select("transaction_id", "amount"), {"amount": "scaled"})


@query("anomaly_scores", "X1 W17", """
select user_id, category, period, anomaly_score from scored""", ("scored",))
def anomaly_scores(t):
    return scored(t).select("user_id", "category", "period", "anomaly_score")


@query("anomalies", "P13 X6", f"""
select user_id, category, period, anomaly_score, case when anomaly_score >= 0.85 then 'high'
  when anomaly_score >= 0.7 then 'medium' else 'low' end as severity from scored where anomaly_score > {THRESHOLD}""",
       ("scored",))
def anomalies(t):
    return X.keep_anomalies(scored(t), THRESHOLD).select(
        "user_id", "category", "period", "anomaly_score", X.severity().alias("severity")
    )


@query("attributions", "X2", """
select user_id, category, period, feature, value, round(attribution, 5) + 0.0::double as attribution
from attributed""", ("attributed",))
def attributions(t):
    rows = X.attribute(staged(t.trend, "trend"), COEFFICIENTS)
    return rows.select("user_id", "category", "period", F.inline("attributions")).withColumns(
        {"value": F.when(F.col("feature").isin(*AVERAGED), F.round("value", 9)).otherwise(F.col("value")), "attribution": F.round("attribution", 5)}
    )


@query("top_factors", "X3 T3", """
select user_id, category, period, array_to_string(list_transform(f, lambda x: x[1] || case when x[2] then '+' else '-' end), ',')
  as factors from explained""".replace("x[1]", "struct_extract_at(x, 1)").replace("x[2]", "struct_extract_at(x, 2)"), ("explained",))
def top_factors(t):
    signed = F.transform(
        "top_factors", lambda f: F.concat(f["feature"], F.when(f["direction"] == "increased", "+").otherwise("-"))
    )
    return explained(t).select("user_id", "category", "period", F.array_join(signed, ",").alias("factors"))


@query("explained_anomalies", "X4 X5 X6", """
select user_id, category, period, anomaly_score, predicted_spend, actual_spend, direction, magnitude_pct,
  case when anomaly_score >= 0.85 then 'high' when anomaly_score >= 0.7 then 'medium' else 'low' end as severity,
  'Your ' || category || ' spending this month ($' || format('{:,.2f}', actual_spend) || ') is ' ||
  format('{:.0f}', magnitude_pct) || '% ' || case when direction = 1 then 'higher' else 'lower' end ||
  ' than expected ($' || format('{:,.2f}', predicted_spend) || '). This appears driven by: ' || w[1] || ', ' || w[2] ||
  ', and ' || w[3] || '.' as natural_language
from (select *, list_transform(f, lambda x: case when struct_extract_at(x, 2) then 'higher ' else 'lower ' end ||
  struct_extract_at(x, 3)) as w from explained)""", ("explained",))
def explained_anomalies(t):
    return explained(t).drop("top_factors")


@query("explanation_of_one_user", "X8 P3", f"""
select user_id, category, period, round(base_value, 5) as base_value, round(base_value + total, 5) as predicted_spend, impacts
from (select user_id, category, period, sum(attribution) as total,
  array_to_string(list(words || case when attribution > 0 then ' increased' else ' decreased' end ||
    ' the predicted amount by $' || format('{{:.2f}}', abs(attribution)) order by abs(attribution) desc, idx desc)[1:3], '; ') as impacts
  from attributed where user_id = '7' group by all), (select avg(next_month_spend) as base_value from trend)""",
       ("attributed", "trend"))
def explanation_of_one_user(t):
    features = staged(t.trend, "trend")
    mine = X.attribute(features.where(F.col("user_id") == F.lit("7")), COEFFICIENTS, background=features)
    rows = X.explain_row(mine, features.agg(F.avg("next_month_spend")).scalar())
    return rows.select(
        "user_id", "category", "period", F.round("base_value", 5).alias("base_value"),
        F.round("predicted_spend", 5).alias("predicted_spend"),
        F.array_join(F.transform("top_factors", lambda f: f["impact"]), "; ").alias("impacts"),
    )


@query("first_explanations", "T9", """
select user_id, category, period, anomaly_score from scored order by anomaly_score desc, user_id, category, period limit 5""",
       ("scored",))
def first_explanations(t):
    keys = ["user_id", "category", "period"]
    return scored(t).orderBy(F.desc("anomaly_score"), *keys).limit(5).select(*keys, "anomaly_score")


@query("global_importance", "X7 T6", """
select feature, round(avg(abs(attribution)), 5) as importance from attributed group by all""", ("attributed",))
def global_importance(t):
    rows = X.attribute(staged(t.trend, "trend"), COEFFICIENTS)
    return X.by_importance(X.global_importance(rows)).withColumn("importance", F.round("importance", 5))
