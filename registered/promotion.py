"""Promotion gates and model lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import promote as G
from tallyspark.plans.jobs import promotion
from tallyspark.sources.tables import staged

from .registry import query
from .views import TWINS

TWINS.update(
    {
        "text_gates": ((), """
select * from (values ('test_subset_accuracy', 0.9, null, 'Accuracy >= 90%'), ('test_macro_f1', 0.85, null, 'Macro-F1 >= 0.85'),
  ('test_min_class_recall', 0.7, null, 'No category recall below 0.70'),
  ('test_abstention_rate', 0.05, 0.2, 'Abstention rate between 5% and 20%')) t(gate, low, high, description)"""),
        "text_results": (("run_metrics", "text_gates"), """
select r.run_id, g.gate, g.description, m.value,
  coalesce(m.value >= g.low::double and (g.high is null or m.value <= g.high::double), false) as passed,
  case when m.value is null then 'Metric ''' || g.gate || ''' not found in run metrics'
    when m.value < g.low::double then format('{:.4f}', m.value) || ' < min(' || g.low::double || ')'
    when m.value > g.high::double then format('{:.4f}', m.value) || ' > max(' || g.high::double || ')'
    else 'PASS' end as reason
from (select distinct run_id from run_metrics) r cross join text_gates g
left join run_metrics m on m.run_id = r.run_id and m.metric = g.gate"""),
        "trend_results": (("trend_metrics", "production_metrics"), """
select m.model_type, m.run_id, m.metric as gate, m.value,
  case when m.metric = 'xgb_precision_at_5' then m.value >= 0.4::double
    else coalesce(m.value <= p.value * case m.metric when 'xgb_test_rmse' then 1.05::double else 1.10::double end, true) end as passed
from trend_metrics m left join production_metrics p on p.model_type = m.model_type and p.metric = m.metric"""),
        "with_predecessor": (("models",), """
select *, last(case when status = 'PRODUCTION' then model_id end ignore nulls) over (
  partition by model_type, user_id order by ts, seq rows between unbounded preceding and 1 preceding) as predecessor_id
from models"""),
        "latest_models": (("models",), """
select * exclude (r) from (select *, row_number() over (partition by model_type, user_id order by ts desc, seq desc) as r
  from models) where r = 1"""),
        "production_models": (("models",), """
select * exclude (r) from (select *, row_number() over (partition by model_type, user_id order by ts desc, seq desc) as r
  from models where status = 'PRODUCTION') where r = 1"""),
    }
)


def with_predecessor(t):
    return G.predecessors(t.models)


@query("text_gate_results", "G1 J16", "select * from text_results", ("text_results",))
def text_gate_results(t):
    return G.gate_results(t.run_metrics, G.gates_for("DISTILBERT_CATEGORIZATION"))


@query("trend_gate_results", "G2 J16 J17", "select model_type, run_id, gate, value, passed from trend_results", ("trend_results",))
def trend_gate_results(t):
    results = G.gate_results(t.trend_metrics, G.gates_for("XGBOOST_TREND"), t.production_metrics, ["model_type"])
    return results.select("model_type", "run_id", "gate", "value", "passed")


@query("trend_gates_against_one_model", "G2 J17", """
select m.run_id, m.metric as gate, m.value, case m.metric when 'xgb_precision_at_5' then m.value >= 0.4::double
  else m.value <= p.value * case m.metric when 'xgb_test_rmse' then 1.05::double else 1.10::double end end as passed
from trend_metrics m left join (select metric, value from production_metrics where model_type = '3') p
on p.metric = m.metric""", ("trend_metrics", "production_metrics"))
def trend_gates_against_one_model(t):
    serving = t.production_metrics.where("model_type = '3'").drop("model_type")
    results = G.gate_results(t.trend_metrics.drop("model_type"), G.trend_gates(), serving)
    return results.select("run_id", "gate", "value", "passed")


@query("run_verdicts", "G3", "select run_id, bool_and(passed) as passed from text_results group by all", ("text_results",))
def run_verdicts(t):
    results, events = promotion(t.models, t.run_metrics, G.TEXT_GATES, dry_run=True)
    assert events is None
    return G.verdicts(results)


@query("status_transitions", "G4", """
select *, case when previous is null then status = 'TRAINING' else (previous, status) in (('TRAINING', 'SHADOW'),
  ('TRAINING', 'RETIRED'), ('SHADOW', 'CANARY'), ('SHADOW', 'RETIRED'), ('CANARY', 'PRODUCTION'), ('CANARY', 'RETIRED'),
  ('PRODUCTION', 'RETIRED')) end as allowed
from (select *, lag(status) over (partition by model_id order by ts, seq) as previous from status_events)""",
       ("status_events",))
def status_transitions(t):
    return G.check_transitions(t.status_events)


@query("current_status", "G4 W15", """
select model_id, status from (select *, row_number() over (partition by model_id order by ts desc, seq desc) as r
  from status_events) where r = 1""", ("status_events",))
def current_status(t):
    return G.current_status(t.status_events)


@query("model_predecessors", "W14", "select * from with_predecessor", ("with_predecessor",))
def model_predecessors(t):
    return with_predecessor(t)


@query("model_versions", "W16", """
select model_id, '1.' || (row_number() over (partition by model_type, user_id order by ts, seq) - 1) || '.0' as version
from models""", ("models",))
def model_versions(t):
    return G.versions(t.models.drop("version")).select("model_id", "version")


@query("next_versions", "W16", """
select model_type, user_id, split_part(version, '.', 1) || '.' || (split_part(version, '.', 2)::int + 1) || '.0' as next_version
from latest_models""", ("latest_models",))
def next_versions(t):
    return G.next_version(t.models)


@query("latest_models", "W15 G7", "select * from latest_models", ("latest_models",))
def latest_models(t):
    return G.latest(t.models)


@query("production_models", "W15 G7", "select * from production_models", ("production_models",))
def production_models(t):
    return G.production(t.models)


@query("listed_models", "P14 G7", "select * from models where model_type = '1-URGENT' and status = 'CANARY'", ("models",))
def listed_models(t):
    return G.list_models(t.models, "1-URGENT", "CANARY")


@query("registered_models", "G7 W14 W16", """
select c.c_custkey as model_id, 'new' || case when l.model_type is null then '' else '' end as tag, '5-LOW' as model_type,
  c.c_custkey::varchar as user_id, coalesce(split_part(l.version, '.', 1) || '.' || (split_part(l.version, '.', 2)::int + 1) || '.0',
    '1.0.0') as version, 'TRAINING' as status, p.model_id as predecessor_id
from customer c left join latest_models l on l.model_type = '5-LOW' and l.user_id = c.c_custkey::varchar
left join production_models p on p.model_type = '5-LOW' and p.user_id = c.c_custkey::varchar""",
       ("latest_models", "production_models"))
def registered_models(t):
    fresh = t.table("customer").selectExpr(
        "c_custkey as model_id", "'new' as tag", "'5-LOW' as model_type", "cast(c_custkey as string) as user_id"
    )
    return G.register(t.models, fresh)


@query("promoted_models", "G5", """
select * from (
  with m as (select *, model_id % 3 <> 0 as ok, case status when 'TRAINING' then 'SHADOW' when 'SHADOW' then 'CANARY'
      when 'CANARY' then 'PRODUCTION' end as next from with_predecessor)
  select model_id, next as status, 'gates passed' as reason from m where ok and next is not null
  union all select distinct predecessor_id, 'RETIRED', 'replaced' from m
  where ok and next = 'PRODUCTION' and predecessor_id in (select model_id from models where status = 'PRODUCTION'))""",
       ("with_predecessor", "models"))
def promoted_models(t):
    models = staged(with_predecessor(t), "models")
    passed = models.select("model_id", (F.col("model_id") % 3 != 0).alias("passed"))
    return G.promote(models, passed)


@query("rolled_back_models", "G6", """
select * from (
  with c as (select * from with_predecessor where model_id in (select model_id from production_models))
  select model_id, 'RETIRED' as status, 'rolled back' as reason from c
  union all select distinct predecessor_id, 'PRODUCTION', 'restored' from c where predecessor_id is not null)""",
       ("with_predecessor", "production_models"))
def rolled_back_models(t):
    return G.rollback(staged(with_predecessor(t), "models"))


@query("rolled_back_targets", "G6", """
select * from (
  with c as (select * from with_predecessor where model_id % 10 = 1)
  select model_id, 'RETIRED' as status, 'rolled back' as reason from c where status <> 'RETIRED'
  union all select distinct predecessor_id, 'PRODUCTION', 'restored' from c where predecessor_id is not null)""",
       ("with_predecessor",))
def rolled_back_targets(t):
    models = staged(with_predecessor(t), "models")
    return G.rollback(models, models.where("model_id % 10 = 1").select("model_id"))
