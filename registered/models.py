"""Model jobs. Text weights have a SQL twin; of fitted models only rows and figures are checked here, and boosted trees
and the draws of isolation trees against a plain version in the tests.

All but the boosted models other than the refit have the operators' default sizes; the rows are always those of the whole tables.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from tallyspark.operators import evaluate as E, explain as X, isolation as I, models as M, splits as SP
from tallyspark.operators.features import FEATURES, TARGET
from tallyspark.plans.jobs import explanations, trained_scores
from tallyspark.sources.tables import staged

from .registry import query

PAIR_MONTH = ("user_id", "category", "period")
#: Boosted models, but for the refit, grow a part of their trees, and the search has few candidates: README has the times that
#: whole ones take.
SEARCHED = 4
GROWN, ENSEMBLE = (dataclasses.replace(M.FIRST_FIT, trees=n) for n in (60, 20))


def documents(t):
    """All texts, with a label where there is one, split at random: models learn from labelled ones and score all."""
    rows = t.table("documents").join(t.table("labels"), "doc_id", "left").selectExpr(
        "doc_id", "text as description", "case quality when 1 then 'good' when 0 then 'bad' end as truth"
    )
    return staged(SP.split_by_hash(staged(rows, "texts"), ["doc_id"]), "split")


def trend_split(t):
    return staged(SP.split_by_time(staged(t.trend, "trend")), "split")


def figures(scored, by="split"):
    return E.regression_metrics(scored, TARGET, "predicted", by)


@query("text_features", "ML1")
def text_features(t):
    rows = documents(t)
    fitted = M.fit_text_features(SP.part(rows, "train"))
    return fitted.transform(rows).select("doc_id", "split", F.col("text_features").cast("string").alias("vector"))


@query("text_term_weights", "ML1", """
with words as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') as w from documents where text is not null),
terms as (select doc_id, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as term from words),
counts as (select doc_id, term, count(*) as n from terms group by all),
chosen as (select term, sum(n) as total, count(*) as df from counts group by all order by total desc, term limit 10000),
weighed as (select doc_id, term, (1 + ln(n)) * (ln((1 + (select count(*) from words)) / (1 + df)) + 1) as w
  from counts join chosen using (term))
select doc_id, term, round(1e6 * w / sqrt(sum(w * w) over (partition by doc_id)))::bigint as weight_e6 from weighed""")
def text_term_weights(t):
    """Millionths of each term's weight in every text; terms are learned from all texts."""
    rows = t.table("documents").selectExpr("doc_id", "text as description")
    fitted = M.fit_text_features(rows)
    cells = fitted.weights(rows).select("doc_id", F.inline("weights"))
    return cells.select("doc_id", "term", F.round(F.col("weight") * 1e6).cast("bigint").alias("weight_e6"))


@query("text_classifier", "ML2 V8")
def text_classifier(t):
    rows = documents(t)
    model = M.fit_text_classifier(SP.part(rows, "train"))
    return model.transform(rows).select("doc_id", "split", "truth", "guess", "confidence")


@query("important_terms", "T8")
def important_terms(t):
    rows = documents(t)
    return M.important_terms(M.fit_text_classifier(SP.part(rows, "train")), rows)


@query("random_forest", "ML5 ML10")
def random_forest(t):
    rows = trend_split(t)
    model = M.fit_forest(SP.part(rows, "train"), key=PAIR_MONTH)
    return figures(model.predict(rows))


@query("forest_importances", "ML5 T4")
def forest_importances(t):
    rows = trend_split(t)
    return M.fit_forest(SP.part(rows, "train"), key=PAIR_MONTH).importances(rows)


@query("boosted_trees", "ML6 ML10")
def boosted_trees(t):
    rows = trend_split(t)
    return figures(M.fit_boosted(SP.part(rows, "train"), GROWN).predict(rows))


@query("boosted_refit", "ML11 F4")
def boosted_refit(t):
    from tallyspark.operators.feedback import blend_expected

    rows = staged(blend_expected(trend_split(t), t.feedback_trend), "blended")
    return figures(M.fit_boosted(SP.part(rows, "train"), M.REFIT).predict(rows))


@query("random_search", "ML7")
def random_search(t):
    rows = trend_split(t)
    candidates = [dataclasses.replace(p, trees=p.trees // 50) for p in M.draw_params(SEARCHED)]
    _, _, history = M.random_search(SP.part(rows, "train"), SP.part(rows, "val"), candidates)
    return history


@query("isolation_scores", "ML8")
def isolation_scores(t):
    rows = trend_split(t)
    forest = I.fit_forest(SP.part(rows, "train"), FEATURES, key=["user_id", "category", "period"])
    return I.isolation_score(rows, forest, FEATURES).select("user_id", "category", "period", "split", "isolation")


@query("ensemble_scores", "ML9 W17")
def ensemble_scores(t):
    _, scored = trained_scores(t.trend, ENSEMBLE)
    return scored.select("user_id", "category", "period", "abs_residual", "isolation", "ensemble_score")


@query("model_explanations", "X1 X2 X5 ML10")
def model_explanations(t):
    rows = trend_split(t)
    model = M.fit_linear(SP.part(rows, "train"))
    return explanations(rows, model, M.coefficients(model), threshold=0.3).select(
        "user_id", "category", "period", "anomaly_score", "direction", "natural_language", "severity"
    )
