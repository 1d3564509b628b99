"""Boosted trees against a plain version that sums rows node by node, without Spark or histograms."""

import dataclasses
import random
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from registered import models
from tallyspark.operators import boosting, feedback, models as M, splits as SP
from tallyspark.operators.boosting import BINS, Boosting, BoostedTrees, drawn, fit_boosted, prepare, quantile_cuts
from tallyspark.operators.features import TARGET
from tallyspark.operators.models import draw_params, random_search

NAMES = ("a", "b", "c")


def table(n, seed):
    random.seed(seed)
    rows = []
    for i in range(n):
        a, b = random.randint(0, 30), random.random() * 10
        c = None if random.random() < 0.2 else float(random.randint(0, 5))
        rows.append((i, float(a), b, c, 3.0 * (a > 12) - 2.0 * (b < 4) * (a > 5) + (1.5 if c is None else 0.3 * c) + random.random()))
    return rows


def plain(x, y, draws, cuts, params, seed):
    """Predictions of all rows: every split by sums over its rows, cut by cut."""
    choice, base = random.Random(seed), y.mean()
    margin = np.full(len(y), base)

    def soft(g):
        return np.sign(g) * max(abs(g) - params.l1, 0)

    def score(g, h):
        return soft(g) ** 2 / (h + params.l2)

    def grow(rows, part, depth, g, chosen):
        """(gain, predictions of rows, is a leaf)"""
        own = rows & part
        total, weight = g[own].sum(), own.sum()
        leaf = -params.rate * soft(total) / (weight + params.l2)
        best = None
        if depth < params.depth:
            for missing_left in (False, True):
                for f in chosen:
                    for cut in list(cuts[f]) + [np.inf]:
                        left = np.where(np.isnan(x[f]), missing_left, x[f] <= cut)
                        a, b = own & left, own & ~left
                        if min(a.sum(), b.sum()) < max(params.leaf, 1e-6):
                            continue
                        gain = score(g[a].sum(), a.sum()) + score(g[b].sum(), b.sum()) - score(total, weight)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, left)
        if best is None:
            return np.where(rows, leaf, 0), True
        (one, flat), (two, level) = (grow(rows & s, part, depth + 1, g, chosen) for s in (best[1], ~best[1]))
        if flat and level and best[0] < params.gain:
            return np.where(rows, leaf, 0), True
        return one + two, False

    for number in range(params.trees):
        chosen = sorted(choice.sample(range(len(x)), max(1, int(params.columns * len(x)))))
        part = drawn(draws, number, params.rows)
        margin = margin + grow(np.ones(len(y), bool), part, 0, margin - y, chosen)[0]
    return margin


@pytest.mark.parametrize("params", [
    Boosting(trees=6, depth=3, rate=0.3, rows=0.8, columns=0.7, leaf=5, l1=0.1, l2=1.0, gain=0.1),
    Boosting(trees=30, depth=2, rate=0.2, rows=1.0, columns=1.0, leaf=1, l1=2.0, l2=5.0, gain=3.0),
    Boosting(trees=2, depth=6, rate=1.0, rows=1.0, columns=1.0, leaf=1, l1=0.0, l2=0.0, gain=0.0),
])
def test_trees_equal_plain_version(spark, params):
    rows = table(300, 5)
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(5)
    ids = np.array([r[0] for r in df.selectExpr("id").orderBy("id").collect()])
    draws = np.array([r.d for r in df.selectExpr("id", "xxhash64(7, id) as d").orderBy("id").collect()], np.int64).view(np.uint64)
    x = np.array([[np.nan if r[k] is None else r[k] for r in rows] for k in (1, 2, 3)])
    cuts = [np.unique(x[0]), np.linspace(0.5, 9.5, 12), np.arange(6.0)]
    model = fit_boosted(df, params, NAMES, "y", ["id"], 7, cuts)
    got = np.array([r.predicted for r in model.predict(df).orderBy("id").collect()])
    assert len(ids) == 300 and len(model.trees) == params.trees
    np.testing.assert_allclose(got, plain(x, np.array([r[4] for r in rows]), draws, cuts, params, 7), atol=1e-6)


def test_same_trees_however_rows_are_partitioned(spark):
    df = spark.createDataFrame(table(400, 9), "id long, a double, b double, c double, y double")
    params = Boosting(trees=4, depth=4, rate=0.3)
    cuts = [np.arange(30.0), np.arange(0.0, 10, 0.1), np.arange(6.0)]
    one, many = (fit_boosted(df.repartition(n), params, NAMES, "y", ["id"], 1, cuts) for n in (1, 7))
    for a, b in zip(one.trees, many.trees):
        assert a.feature.tolist() == b.feature.tolist() and a.bin.tolist() == b.bin.tolist() and a.value.tolist() == b.value.tolist()


def test_penalties_shrink_and_stop(spark):
    df = spark.createDataFrame(table(200, 3), "id long, a double, b double, c double, y double")
    none = fit_boosted(df, Boosting(trees=2, depth=3, gain=1e9), NAMES, "y", ["id"])
    assert all(t.feature[0] < 0 for t in none.trees)  # every split undone
    flat = fit_boosted(df, Boosting(trees=2, depth=3, l1=1e9), NAMES, "y", ["id"])
    assert {r.predicted for r in flat.predict(df).collect()} == {flat.base}
    top = fit_boosted(df, Boosting(trees=8, depth=3, rate=0.3), NAMES, "y", ["id"]).importances(df, 2).collect()
    assert top[0].feature == "a" and len(top) == 2


def test_constant_null_and_empty(spark):
    schema = "a double, b double, c double, y double"
    df = spark.createDataFrame([(1.0, None, float("nan"), 2.0)] * 9 + [(1.0, None, 3.0, None)], schema)
    model = fit_boosted(df, Boosting(trees=2, depth=2), NAMES, "y")
    assert {r.predicted for r in model.predict(df).collect()} == {2.0}
    assert [len(c) for c in quantile_cuts(df, NAMES)] == [1, 0, 1] and BINS == 256
    with pytest.raises(ValueError):
        fit_boosted(df.limit(0), Boosting(trees=1), NAMES, "y")
    assert BoostedTrees(1.0, [], NAMES).predict(df.limit(0)).collect() == []


def test_growing_on_equals_growing_at_once(spark):
    df = spark.createDataFrame(table(300, 4), "id long, a double, b double, c double, y double")
    params = Boosting(trees=7, depth=3, rate=0.3)
    ready = prepare(df, NAMES, "y", ["id"])
    whole = fit_boosted(ready, params)
    first = fit_boosted(ready, dataclasses.replace(params, trees=3))
    grown = fit_boosted(ready, params, start=first)
    assert [t.value.tolist() for t in grown.trees] == [t.value.tolist() for t in whole.trees]


def test_search_halves_and_keeps_the_best(spark):
    df = spark.createDataFrame(table(400, 8), "id long, a double, b double, c double, y double").cache()
    train, val = df.where("id < 300"), df.where("id >= 300")
    candidates = [Boosting(trees=8, depth=3, rate=r) for r in (0.001, 0.3, 0.002, 0.02)]
    model, best, history = random_search(train, val, candidates, NAMES, "y", halvings=2, workers=3)
    rows = {r.trial: (r.trees, r.rmse) for r in history.collect()}
    assert best == candidates[1] and len(model.trees) == 8
    assert sorted(t for t, _ in rows.values()) == [2, 2, 4, 8] and rows[1][1] == min(s for _, s in rows.values())
    assert len({dataclasses.astuple(p) for p in draw_params(50)}) == 50


def test_margins_are_written_often_in_two_folders_and_trees_stay_the_same(spark, monkeypatch):
    df = spark.createDataFrame(table(200, 3), "id long, a double, b double, c double, y double")
    params, paths = Boosting(trees=8, depth=2, rate=0.3), []
    write = boosting.staged

    def counted(rows, name, path=None):
        if name == "boost-margins":
            paths.append(path)
        return write(rows, name, path)

    monkeypatch.setattr(boosting, "staged", counted)
    often = fit_boosted(df, params, NAMES, "y", ["id"], 7)
    assert len(paths) >= params.trees // 2 and len(set(paths)) == 2
    monkeypatch.setattr(boosting, "APPLIED", 25)
    seldom = fit_boosted(df, params, NAMES, "y", ["id"], 7)
    for one, two in zip(often.trees, seldom.trees, strict=True):
        assert (one.feature == two.feature).all() and (one.bin == two.bin).all() and (one.value == two.value).all()


def test_the_refit_grows_all_its_trees(spark, monkeypatch):
    grown = []

    class Fitted:
        def predict(self, df):
            return df.withColumn("predicted", F.lit(0.0))

    def fit(train, params):
        grown.append(params)
        return Fitted()

    rows = spark.createDataFrame([(s, 1.0) for s in SP.SPLITS], f"split string, {TARGET} double")
    monkeypatch.setattr(models, "trend_split", lambda t: rows)
    monkeypatch.setattr(feedback, "blend_expected", lambda df, signals: df)
    monkeypatch.setattr(M, "fit_boosted", fit)
    models.boosted_refit(types.SimpleNamespace(feedback_trend=None)).collect()
    assert grown == [M.REFIT] and M.REFIT.trees == 100
