"""Feedback mixing and retraining triggers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.operators import drift as D, feedback as FB
from tallyspark.operators.features import FEATURES

from .evaluation import drift_sides
from .registry import query
from .views import TWINS

ASOF = dt.datetime(2024, 3, 1)
LAST = dt.datetime(2024, 2, 26)


def _h(column: str) -> str:
    return f"('0x' || substr(md5('42|' || {column}), 1, 13))::bigint"


TWINS.update(
    {
        "production_rows": (("feedback_text",), """
select 'p' || feedback_id as source_id, '' as description,
  case when feedback_type = 'override' then actual_category else predicted_category end as category, amount,
  'USD' as currency, 'US' as country, case when feedback_type = 'override' then 1.0 else 0.3 end::double as sample_weight,
  'production' as data_source from feedback_text"""),
        "external_rows": ((), """
select 'x' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as source_id,
  p_name as description, p_brand as category, l_extendedprice as amount, 'USD' as currency, 'US' as country
from lineitem join part on l_partkey = p_partkey"""),
        "mixed": (("production_rows", "external_rows"), f"""
select source_id, category, amount, sample_weight, data_source from production_rows
union all select source_id, category, amount, 0.5::double, 'external' from (
  select *, row_number() over (order by {_h("source_id")}) as r from external_rows)
where r <= (select floor(count(*)::double * 0.5::double / 0.5::double) from production_rows)"""),
    }
)


def production_feedback(t):
    return t.feedback_text.withColumn("source_id", F.concat(F.lit("p"), "feedback_id"))


def external(t):
    lines, parts = t.table("lineitem"), t.table("part")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "concat('x', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as source_id",
        "p_name as description", "array(p_brand) as categories", "l_extendedprice as amount",
        "'USD' as currency", "'US' as country", "'train' as split",
    )


def flat(df):
    return df.select(
        "source_id", F.element_at("categories", 1).alias("category"), "amount", "sample_weight", "data_source", "split"
    )


@query("feedback_rows", "F1", """
select source_id, description, category, amount, currency, country, sample_weight, data_source from production_rows""",
       ("production_rows",))
def feedback_rows(t):
    rows = FB.feedback_rows(production_feedback(t), keep=["source_id"])
    return rows.withColumn("category", F.element_at("categories", 1)).drop("categories")


@query("mixed_training_rows", "F2 F3 U2 M7", f"""
select source_id, category, amount, sample_weight, data_source,
  case when pos < floor(n * 0.8::double) then 'train' when pos <= floor(n * 0.9::double) then 'val' else 'test' end as split
from (select *, count(*) over () as n, row_number() over (order by {_h("source_id")}) - 1 as pos from mixed)""", ("mixed",))
def mixed_training_rows(t):
    production = FB.feedback_rows(production_feedback(t), keep=["source_id"])
    return flat(FB.mix(production, external(t), key=["source_id"]))


@query("mix_without_feedback", "F5", """
select source_id, category, amount, 0.5::double as sample_weight, 'external' as data_source, 'train' as split
from external_rows""", ("external_rows",))
def mix_without_feedback(t):
    nothing = FB.feedback_rows(production_feedback(t).where("feedback_type = 'none'"), keep=["source_id"])
    return flat(FB.mix(nothing, external(t), key=["source_id"]))


@query("expected_signals", "F4", """
select user_id, category_name as category, len(a) as n, round(list_reduce(list_concat([0.0::double], a),
    lambda t, x: t * 0.7::double + x * 0.3::double), 4) as shift from (
  select user_id, category_name, list(actual_spend order by created_at, feedback_id) as a from feedback_trend
  where feedback_type = 'expected' and actual_spend <> 0 group by all)""", ("feedback_trend",))
def expected_signals(t):
    return FB.expected_signals(t.feedback_trend).withColumn("shift", F.round("shift", 4))


@query("blended_targets", "F4 J15", """
select t.user_id, t.category, t.period, round(ln(case when a is null then next_month_spend else
  list_reduce(list_concat([next_month_spend], a), lambda t, x: t * 0.7::double + x * 0.3::double) end), 9) as log_target
from trend t left join (
  select user_id, category_name as category, list(actual_spend order by created_at, feedback_id) as a from feedback_trend
  where feedback_type = 'expected' and actual_spend <> 0 group by all) f using (user_id, category)""",
       ("trend", "feedback_trend"))
def blended_targets(t):
    moved = FB.blend_expected(t.trend.select("user_id", "category", "period", "next_month_spend"), t.feedback_trend)
    # Logarithms have no finite decimal form, so no value lies on a rounding border.
    return moved.select("user_id", "category", "period", F.round(F.ln("next_month_spend"), 9).alias("log_target"))


@query("override_rate", "A18", """
select count(*) filter (where feedback_type = 'override') as n_override, count(*) as n,
  count(*) filter (where feedback_type = 'override') / greatest(count(*), 1) as override_rate from feedback_text""",
       ("feedback_text",))
def override_rate(t):
    return FB.override_rate(t.feedback_text)


@query("text_retrain_trigger", "F6", """
select rate > 0.15 as should_retrain, case when rate > 0.15
  then format('Override rate {:.1f}% > threshold 15.0%', rate * 100) else '' end as reasons
from (select count(*) filter (where feedback_type = 'override') / greatest(count(*), 1) as rate from feedback_text)""",
       ("feedback_text",))
def text_retrain_trigger(t):
    verdict = FB.text_trigger(t.feedback_text, ASOF, LAST)
    return verdict.withColumn("reasons", F.array_join("reasons", "; "))


@query("trend_retrain_trigger", "F7", """
select true as should_retrain, 'No previous retraining recorded' || case when count(*) >= 10
  then '; ' || count(*) || ' feedback signals >= threshold 10' else '' end as reasons from feedback_trend""",
       ("feedback_trend",))
def trend_retrain_trigger(t):
    verdict = FB.trend_trigger(t.feedback_trend, ASOF)
    return verdict.withColumn("reasons", F.array_join("reasons", "; "))


@query("retrain_decision", "F8", """
select n >= 10 or drifted as retrain, case when n >= 10 then n || ' feedback signals >= threshold 10' else '' end
  || case when n >= 10 and drifted then '; ' else '' end
  || case when drifted then 'Data drift detected (PSI > 0.25)' else '' end as reasons
from (select count(*) as n from feedback_trend), (select coalesce(bool_or(psi > 0.25), false) as drifted from psi)""",
       ("feedback_trend", "psi"))
def retrain_decision(t):
    report = D.drift_summary(D.drift_report(*drift_sides(t), FEATURES))
    verdict = FB.decide(FB.trend_trigger(t.feedback_trend, ASOF, LAST), report)
    return verdict.withColumn("reasons", F.array_join("reasons", "; "))
