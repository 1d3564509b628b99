"""The forest of large tables against a plain version that sums rows node by node, without Spark or histograms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import forest, models as M

NAMES = ("a", "b", "c", "d")


def table(n):
    random.seed(3)
    rows = []
    for i in range(n):
        a, b, c = random.randint(0, 12), random.randint(0, 9), random.randint(0, 5)
        rows.append((i, float(a), float(b), None if c == 5 else float(c), 1.0, 3.0 * (a > 6) - 2.0 * (b < 4) * (a > 3) + 0.3 * c + random.random()))
    return rows


def plain(x, y, draws, trees, depth, leaf, seed):
    choice, out = random.Random(seed), np.zeros(len(y))
    times = [forest.copies(draws, t).astype(float) for t in range(trees)]
    n_drawn = -(-len(x) // 3)
    nodes = [(t, np.full(len(y), True)) for t in range(trees)]
    for level in range(depth + 1):
        after = []
        chosen = [choice.sample(range(len(x)), n_drawn) for _ in nodes] if level < depth else [()] * len(nodes)
        for (t, rows), some in zip(nodes, chosen):
            w = times[t] * rows
            mean, best = (w * y).sum() / w.sum(), None
            spread = (w * (y - mean) ** 2).sum()
            for f in some:
                for cut in sorted(set(x[f]))[:-1]:
                    sides = [w * s for s in (x[f] <= cut, x[f] > cut)]
                    if min(s.sum() for s in sides) < leaf:
                        continue
                    gain = spread - sum((s * (y - (s * y).sum() / s.sum()) ** 2).sum() for s in sides)
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, x[f] <= cut)
            if best is None:
                out[rows] += mean
            else:
                after += [(t, rows & best[1]), (t, rows & ~best[1])]
        nodes = after
    return out / trees


@pytest.mark.parametrize("depth", [1, 4])
def test_forest_of_many_rows_is_the_plain_one(spark, monkeypatch, depth):
    monkeypatch.setattr(forest, "JOB_NODES", 10)  # several jobs a level
    rows = table(400)
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, y double").repartition(5)
    model = M.fit_forest(df, trees=6, depth=depth, leaf=2, features=NAMES, target="y", key=["id"], few=399)
    assert isinstance(model, forest.Forest)
    found = {r.id: r for r in model.predict(df.withColumn("draw", F.xxhash64(F.lit(42), "id"))).collect()}
    x = np.array([[0.0 if v is None else v for v in r[1:5]] for r in rows]).T
    draws = np.array([found[r[0]].draw for r in rows], np.int64).view(np.uint64)
    want = plain(x, np.array([r[5] for r in rows]), draws, 6, depth, 2, 42)
    assert [found[r[0]].predicted for r in rows] == pytest.approx(want, abs=1e-6)
    top = model.importances(df).collect()
    assert len(top) == 4 and sum(r.importance for r in top) == pytest.approx(1) and top[-1].feature == "d"


def test_copies_are_poisson_draws():
    times = forest.copies(np.random.default_rng(1).integers(0, 2**63, 200_000).astype(np.uint64), 7)
    assert times.mean() == pytest.approx(1, abs=0.01) and times.var() == pytest.approx(1, abs=0.02)


def test_few_rows_go_to_spark_ml(spark):
    df = spark.createDataFrame(table(60), "id int, a double, b double, c double, d double, y double")
    assert isinstance(M.fit_forest(df, trees=2, depth=2, features=NAMES, target="y"), M.Regressor)
