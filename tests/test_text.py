"""Text features and the weighted text model, compared with plain versions."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import models as M, text as TX

TEXTS = [
    (1, "Coffee shop COFFEE bar"), (2, "shop 12 x_1 shop 12"), (3, ""), (4, None), (5, "a b c"), (6, "Café é naïve café"),
    (7, "Coffee shop COFFEE bar"), (8, "word " * 30_000),
]


def plain_terms(text):
    words = re.findall(r"\w{2,}", (text or "").lower())
    return collections.Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def plain_weights(texts, max_terms):
    counts = {i: plain_terms(t) for i, t in texts}
    total, within = collections.Counter(), collections.Counter()
    for c in counts.values():
        total.update(c)
        within.update(c.keys())
    chosen = sorted(total, key=lambda t: (-total[t], t))[:max_terms]
    n = sum(t is not None for _, t in texts)
    out = {}
    for i, c in counts.items():
        raw = {t: (1 + math.log(c[t])) * (math.log((1 + n) / (1 + within[t])) + 1) for t in chosen if t in c}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out[i] = {t: w / norm for t, w in raw.items()}
    return out


@pytest.mark.parametrize("max_terms", [3, 1000])
def test_weights_equal_a_plain_version(spark, max_terms):
    # The names that the operators use inside are the input's own here.
    df = spark.createDataFrame(TEXTS, "id int, description string").selectExpr("*", "id as _words", "'x' as _terms", "id as term")
    fitted = TX.fit_text_features(df, max_terms=max_terms)
    want = plain_weights(TEXTS, max_terms)
    rows = fitted.weights(df).collect()
    assert {r.id: pytest.approx({w.term: w.weight for w in r.weights}) for r in rows} == want
    assert all(r._words == r.id and r._terms == "x" for r in rows)
    vectors = {r.id: r.text_features for r in fitted.transform(df).collect()}
    for i, row in want.items():
        got = {fitted.vocabulary[j]: w for j, w in zip(vectors[i].indices, vectors[i].values)}
        assert got == pytest.approx(row) and vectors[i].size == len(fitted.vocabulary)


def test_empty_tables_and_unknown_terms(spark):
    none = spark.createDataFrame([], "id int, description string")
    fitted = TX.fit_text_features(none)
    assert fitted.vocabulary == [] and fitted.transform(none).count() == 0
    df = spark.createDataFrame(TEXTS, "id int, description string")
    assert all(not r.weights for r in fitted.weights(df).collect())


def test_one_shuffle_to_count_and_none_to_score(spark):
    df = spark.createDataFrame(TEXTS, "id int, description string")
    fitted = TX.fit_text_features(df)
    assert fitted.transform(df)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    assert TX.term_counts(df, "description")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_row_weights_decide(spark):
    rows = [("same words here", "a", 1.0)] * 6 + [("same words here", "b", 0.1)] * 9 + [("other text", "b", None)] * 3
    df = spark.createDataFrame(rows, "description string, truth string, sample_weight double")
    asked = spark.createDataFrame([("same words here",)], "description string")

    def guess(weight):
        return M.fit_text_classifier(df, max_iter=50, c=100.0, weight=weight).transform(asked).first().guess

    assert guess(None) == "b" and guess("sample_weight") == "a"


def test_penalty_is_that_of_a_summed_loss(spark):
    # Repeating all rows doubles the summed loss, so half of c gives the same model.
    rows = [("red apple", "a"), ("green apple", "a"), ("red car", "b"), ("blue car bus", "b")]
    df = spark.createDataFrame(rows, "description string, truth string")
    one = M.fit_text_classifier(df, c=1.0)
    two = M.fit_text_classifier(df.unionAll(df).unionAll(df).unionAll(df), c=0.25)
    scores = [[r.confidence for r in m.transform(df).orderBy("description").collect()] for m in (one, two)]
    # The document frequencies are smoothed, so they differ a little.
    assert scores[0] == pytest.approx(scores[1], abs=0.02)
