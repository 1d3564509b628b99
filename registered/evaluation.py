"""Evaluation of predictions, drift, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import drift as D, evaluate as E
from tallyspark.operators.features import FEATURES
from tallyspark.operators.splits import split_by_time
from tallyspark.sources.tables import staged

from .features import AVERAGED, comparable
from .registry import query
from .splits import trend
from .views import CUT, TWINS

_KEYS = ["user_id", "category", "period"]
# Ratios averaged over a window may differ in the last bit, which would move a value across a bin edge: 9 digits are binned.
_DRIFT = FEATURES

TWINS.update(
    {
        "label_scores": (("predictions",), """
select label, tp, fp, fn, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision,
  case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall,
  case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1, tp + fn as support
from (select label, count(*) filter (where prob > 0.5 and actual = 1) as tp,
  count(*) filter (where prob > 0.5 and actual <> 1) as fp,
  count(*) filter (where not prob > 0.5 and actual = 1) as fn from predictions group by all)"""),
        "row_scores": (("predictions",), """
select row_id, bool_and((prob > 0.5) = (actual = 1)) as exact, bool_or(prob > 0.5 and actual = 1) as any_correct,
  max(prob) as max_prob from predictions group by all"""),
        "pairs": (("predictions",), """
select * from (select row_id, min(label) filter (where actual = 1) as truth, min_by(label, (-prob, label)) as guess
  from predictions group by all) where truth is not null"""),
        "pair_counts": (("pairs",), """
select label, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from (
  select truth as label, (truth = guess)::int as tp, 0 as fp, (truth <> guess)::int as fn from pairs
  union all select guess, 0, (truth <> guess)::int, 0 from pairs) group by all"""),
        "naive": (("trend_split",), """
select *, next_month_spend - rolling_mean_3m as residual, abs(next_month_spend - rolling_mean_3m) as abs_residual
from trend_split"""),
        "long": (("trend",), "unpivot (select period, " + ", ".join(f"round({f}, 9)::double as {f}" if f in AVERAGED else f"{f}::double as {f}" for f in _DRIFT)
                 + " from trend) on " + ", ".join(_DRIFT) + " into name feature value v"),
        "bounds": (("long",), """
select feature, min(v) as lo, max(v) as hi, (max(v) - min(v)) / 10.0::double as step from long group by all"""),
        "binned": (("long", "bounds"), f"""
select feature, period >= date '{CUT}' as cur, """
                   + " + ".join(f"(v >= lo + {k}.0::double * step)::int" for k in range(1, 10))
                   + " as bin, count(*) as n from long join bounds using (feature) group by all"),
        "grid_full": (("binned", "bounds"), """
select g.feature, g.b as bin, coalesce(sum(x.n) filter (where not x.cur), 0)::bigint as r,
  coalesce(sum(x.n) filter (where x.cur), 0)::bigint as c
from (select feature, b from bounds, range(10) t(b)) g left join binned x on x.feature = g.feature and x.bin = g.b
group by all"""),
        "psi": (("grid_full",), """
select feature, sum(r)::bigint as n_ref, sum(c)::bigint as n_cur, round(sum((pc - pr) * ln(pc / pr)), 9) as psi from (
  select *, (r + 1e-8::double) / (sum(r) over (partition by feature) + 1e-7::double) as pr,
    (c + 1e-8::double) / (sum(c) over (partition by feature) + 1e-7::double) as pc from grid_full) group by all"""),
    }
)


def naive(t):
    """The trend set with its split; three-month mean as the prediction of the next month."""
    return split_by_time(trend(t))


def drift_sides(t):
    features = staged(comparable(t.trend).select("period", *_DRIFT), "drift")
    cut = F.lit(CUT)
    return features.where(F.col("period") < cut), features.where(F.col("period") >= cut)


@query("predicted_labels", "V1", "select row_id, label from predictions where prob > 0.5", ("predictions",))
def predicted_labels(t):
    return E.predicted_labels(t.predictions)


@query("row_outcomes", "V2 V3 V7", "select * from row_scores", ("row_scores",))
def row_outcomes(t):
    return E.per_row(t.predictions)


@query("label_report", "V4", "select * from label_scores", ("label_scores",))
def label_report(t):
    return E.per_label(t.predictions)


@query("multilabel_metrics", "V2 V3 V5 V6 V7", """
select count(*) filter (where exact) / count(*) as exact_match_accuracy,
  count(*) filter (where any_correct) / count(*) as subset_accuracy,
  (select round(avg(f1), 9) from label_scores) as macro_f1,
  (select 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) from label_scores) as micro_f1,
  (select min(recall) filter (where support > 0) from label_scores) as min_class_recall,
  count(*) filter (where max_prob < 0.7) / count(*) as abstention_rate,
  round(avg(max_prob), 9) as mean_max_confidence from row_scores""", ("row_scores", "label_scores"))
def multilabel_metrics(t):
    return E.multilabel_metrics(t.predictions).withColumns(
        {c: F.round(c, 9) for c in ("macro_f1", "mean_max_confidence")}
    )


@query("single_label_metrics", "V8", """
select count(*) filter (where truth = guess) / count(*) as accuracy,
  (select round(avg(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end), 9) from pair_counts)
  as macro_f1 from pairs""", ("pairs", "pair_counts"))
def single_label_metrics(t):
    return E.single_label_metrics(E.primary_labels(t.predictions)).withColumn("macro_f1", F.round("macro_f1", 9))


@query("single_label_report", "V4 V8", """
select label, tp, fp, fn, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision,
  case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall,
  case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1, tp + fn as support
from pair_counts""", ("pair_counts",))
def single_label_report(t):
    return E.single_label_report(E.primary_labels(t.predictions))


@query("confusion_matrix", "V9", """
select truth, guess, count(*) as n from pairs group by all""", ("pairs",))
def confusion_matrix(t):
    return E.confusion(E.primary_labels(t.predictions))


@query("regression_metrics", "V10", """
select split, count(*) as n, round(sqrt(avg(residual * residual)), 6) as rmse, round(avg(abs_residual), 6) as mae,
  round(1 - avg(residual * residual) / var_pop(next_month_spend), 9) as r2 from naive group by all""", ("naive",))
def regression_metrics(t):
    metrics = E.regression_metrics(naive(t), "next_month_spend", "rolling_mean_3m")
    return metrics.withColumns({"rmse": F.round("rmse", 6), "mae": F.round("mae", 6), "r2": F.round("r2", 9)})


@query("largest_residuals", "T5", """
select user_id, category, period, next_month_spend, rolling_mean_3m, abs_residual from naive where split = 'test'
order by abs_residual desc, user_id, category, period limit 5""", ("naive",))
def largest_residuals(t):
    test = naive(t).where("split = 'test'")
    return E.largest_residuals(test, "next_month_spend", "rolling_mean_3m", _KEYS)


@query("precision_at_five", "V11 T5", """
select count(*) filter (where abs_residual > bar) / count(*) as precision_at_5 from (
  select abs_residual, 2 * stddev_pop(next_month_spend) over () as bar,
    row_number() over (order by abs_residual desc, user_id, category, period) as r from naive where split = 'test')
where r <= 5""", ("naive",))
def precision_at_five(t):
    return E.precision_at_k(naive(t).where("split = 'test'"), "next_month_spend", "rolling_mean_3m", _KEYS)


@query("residual_summary", "V12", """
select count(*) as n, round(avg(next_month_spend), 4) as actual_mean, round(stddev_pop(next_month_spend), 4) as actual_std,
  round(avg(rolling_mean_3m), 4) as pred_mean, round(stddev_pop(rolling_mean_3m), 4) as pred_std,
  round(avg(residual), 4) as residual_mean, round(stddev_pop(residual), 4) as residual_std
from naive where split = 'test'""", ("naive",))
def residual_summary(t):
    summary = E.residual_summary(naive(t).where("split = 'test'"), "next_month_spend", "rolling_mean_3m")
    return summary.select("n", *[F.round(c, 4).alias(c) for c in summary.columns if c != "n"])


@query("residual_histogram", "V13 A20", """
select b::int as bin, round(lo + b * step, 6) as low, round(case when b = 49 then hi else lo + (b + 1) * step end, 6) as high,
  coalesce(n, 0) as n
from (select min(residual) as lo, max(residual) as hi, (max(residual) - min(residual)) / 50.0::double as step from naive)
cross join range(50) t(b) left join (select bin, count(*) as n from (select """
       + " + ".join(f"(residual >= lo + {k}.0::double * step)::int" for k in range(1, 50)) + """ as bin
  from naive, (select min(residual) as lo, (max(residual) - min(residual)) / 50.0::double as step from naive) s) group by all)
  x on x.bin = b""", ("naive",))
def residual_histogram(t):
    residuals = E.with_residuals(trend(t), "next_month_spend", "rolling_mean_3m")
    return D.histogram(residuals, "residual", 50).withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query("prediction_sample", "V14 M6", """
select user_id, category, period, next_month_spend as actual, rolling_mean_3m as predicted, residual,
  round(abs_residual / (abs(next_month_spend) + 1e-8::double) * 100, 6) as abs_error_pct from naive
order by ('0x' || substr(md5(concat_ws('|', '42', user_id, category, period::varchar)), 1, 13))::bigint limit 50""",
       ("naive",))
def prediction_sample(t):
    sample = E.prediction_sample(trend(t), "next_month_spend", "rolling_mean_3m", _KEYS)
    return sample.withColumn("abs_error_pct", F.round("abs_error_pct", 6))


@query("drift_bins", "A20 U4", """
select feature, string_agg(r, ',' order by bin) as ref_counts, string_agg(c, ',' order by bin) as cur_counts
from grid_full group by all""", ("grid_full",))
def drift_bins(t):
    counts = D.bin_counts(*drift_sides(t), _DRIFT)
    return counts.select("feature", *[F.array_join(c, ",").alias(c) for c in ("ref_counts", "cur_counts")])


@query("drift_report", "D1 D2 T7", """
select feature, n_ref, n_cur, case when ok then psi end as psi, ok as enough_values, ok and psi > 0.2 as alert,
  ok and psi > 0.25 as retrain from (select *, n_ref >= 10 and n_cur >= 10 as ok from psi)""",
       ("psi",))
def drift_report(t):
    return D.by_drift(D.drift_report(*drift_sides(t), FEATURES)).withColumn("psi", F.round("psi", 9))


@query("drift_summary", "D2", """
select coalesce(bool_or(psi > 0.25), false) as drift_detected,
  coalesce(string_agg(feature, ',' order by feature) filter (where psi > 0.2 and psi <= 0.25), '') as alert_features,
  coalesce(string_agg(feature, ',' order by feature) filter (where psi > 0.25), '') as retrain_features from psi""", ("psi",))
def drift_summary(t):
    summary = D.drift_summary(D.drift_report(*drift_sides(t), FEATURES))
    return summary.withColumns({c: F.array_join(c, ",") for c in ("alert_features", "retrain_features")})
