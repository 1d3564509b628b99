"""Model jobs on Spark ML. Fitting runs Spark jobs; everything else is lazy."""

from __future__ import annotations

import concurrent.futures
import dataclasses
import math
import random
from collections.abc import Sequence

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..sources.tables import staged
from .boosting import BoostedTrees, Boosting, fit_boosted, prepare
from .explain import normalise
from .features import FEATURES, TARGET
from .forest import Forest, grow
from .text import TextFeatures, fit_text_features


# ---------------------------------------------------------------- text


@dataclasses.dataclass
class TextClassifier:
    features: TextFeatures
    labels: list[str]
    model: object

    def transform(self, df: DataFrame, text: str = "description") -> DataFrame:
        """Add ``guess`` and ``confidence``."""
        scored = self.model.transform(self.features.transform(df, text))
        named = IndexToString(inputCol="prediction", outputCol="guess", labels=self.labels).transform(scored)
        return named.withColumn("confidence", F.array_max(vector_to_array("probability"))).drop(
            "text_features", "rawPrediction", "probability", "prediction"
        )


def fit_text_classifier(
    train: DataFrame, text: str = "description", label: str = "truth", max_terms: int = 10_000,
    max_iter: int = 1000, c: float = 1.0, weight: str | None = None,
) -> TextClassifier:
    """Multinomial logistic regression on text features; ``weight`` names a column of row weights (null: 1).

    ``c`` weighs the summed loss against half the squared coefficients, which are not standardised: the larger it is, the
    weaker the penalty.
    """
    rows = train.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    # The vectors are written once: every iteration reads them.
    kept = [F.col(label).alias("label"), F.col(text).alias("text")]
    kept.append((F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)).alias("weight"))
    features = fit_text_features(rows, text, max_terms)
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows.select(*kept))
    vectors = index.transform(features.transform(rows.select(*kept), "text")).select("y", "weight", "text_features")
    ready = staged(vectors, "vectors")
    # The estimator averages the loss over the weights.
    total = ready.agg(F.sum("weight")).first()[0] or 1.0
    model = LogisticRegression(
        featuresCol="text_features", labelCol="y", weightCol="weight", family="multinomial", maxIter=max_iter,
        regParam=1.0 / (c * total), standardization=False,
    ).fit(ready)
    return TextClassifier(features, list(index.labels), model)


def important_terms(classifier: TextClassifier, df: DataFrame, k: int = 30) -> DataFrame:
    """(term, importance): the k terms with the largest mean absolute coefficient over classes.

    The coefficients are the model's, so their number is bounded by vocabulary times classes.
    """
    weights = np.abs(classifier.model.coefficientMatrix.toArray()).mean(axis=0)
    table = df.sparkSession.createDataFrame(
        [([str(t) for t in classifier.features.vocabulary], [float(w) for w in weights])],
        "terms array<string>, weights array<double>",
    )
    return (
        table.select(F.posexplode("terms").alias("i", "term"), "weights")
        .select("term", F.get("weights", F.col("i")).alias("importance"))
        .orderBy(F.desc("importance"), "term")
        .limit(k)
    )


# ---------------------------------------------------------------- regression


def _assembled(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def _numeric(df: DataFrame, features: Sequence[str]) -> DataFrame:
    # Nulls (a weekend share of undated rows) become 0, as trees and linear models need a number.
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})


@dataclasses.dataclass
class Regressor:
    model: PipelineModel
    features: tuple[str, ...]

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """Add the prediction to a feature table; batch, in parallel."""
        raw = df.withColumn("_row", F.struct(*df.columns))
        scored = self.model.transform(_numeric(raw, self.features))
        return scored.select("_row.*", F.col("prediction").alias(out))

    @property
    def stage(self):
        return self.model.stages[-1]

    def importances(self, df: DataFrame, k: int = 5) -> DataFrame:
        """(feature, importance): the k most important features of a tree model."""
        pairs = [(f, float(w)) for f, w in zip(self.features, self.stage.featureImportances.toArray())]
        table = df.sparkSession.createDataFrame(pairs, "feature string, importance double")
        return table.orderBy(F.desc("importance"), "feature").limit(k)


def _fit(estimator, train: DataFrame, features: Sequence[str], target: str) -> Regressor:
    rows = _numeric(train.where(F.col(target).isNotNull()), features)
    return Regressor(Pipeline(stages=[_assembled(features), estimator]).fit(rows), tuple(features))


#: Rows from which on a forest is grown on packed rows.
FEW_ROWS = 1 << 18


def fit_forest(
    train: DataFrame, trees: int = 100, depth: int = 10, leaf: int = 2,
    features: Sequence[str] = FEATURES, target: str = TARGET, seed: int = 42, key: Sequence[str] = (), few: int = FEW_ROWS,
) -> Regressor | Forest:
    """Random forest, by Spark ML up to ``few`` rows.

    Spark ML holds every row with a count per tree, about 600 bytes, and takes about a microsecond for each row, tree and level,
    so more rows go to ``forest.grow``: as many trees of the same depth and least leaf on all rows, with other random draws.
    ``key`` tells rows apart for these.
    """
    if train.where(F.col(target).isNotNull()).count() > few:
        return grow(train, trees, depth, leaf, features, target, seed, key)
    return _fit(
        RandomForestRegressor(
            labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed
        ),
        train, features, target,
    )


FIRST_FIT = Boosting()
REFIT = Boosting(trees=100, rate=0.01)


def fit_linear(
    train: DataFrame, features: Sequence[str] = FEATURES, target: str = TARGET, reg: float = 0.0
) -> Regressor:
    """Linear model, whose attributions are exact."""
    return _fit(LinearRegression(labelCol=target, regParam=reg), train, features, target)


def coefficients(linear: Regressor) -> dict[str, float]:
    return dict(zip(linear.features, map(float, linear.stage.coefficients)))


def draw_params(trials: int, seed: int = 42) -> list[Boosting]:
    """Random parameter sets; the learning rate is uniform in its logarithm."""
    rng = random.Random(seed)
    # Ranges of the search.
    return [
        Boosting(
            trees=rng.randint(50, 500),
            depth=rng.randint(3, 10),
            rate=math.exp(rng.uniform(math.log(0.005), math.log(0.3))),
            leaf=rng.randint(1, 20),
            rows=rng.uniform(0.5, 1.0),
            columns=rng.uniform(0.5, 1.0),
            l1=rng.uniform(0.0, 2.0),
            l2=rng.uniform(0.0, 5.0),
            gain=rng.uniform(0.0, 1.0),
        )
        for _ in range(trials)
    ]


def rmse(scored: DataFrame, target: str = TARGET, predicted: str = "predicted") -> float:
    return RegressionEvaluator(labelCol=target, predictionCol=predicted, metricName="rmse").evaluate(scored)


def random_search(
    train: DataFrame, val: DataFrame, candidates: Sequence[Boosting], features: Sequence[str] = FEATURES,
    target: str = TARGET, seed: int = 42, halvings: int = 3, workers: int = 4,
) -> tuple[BoostedTrees, Boosting, DataFrame]:
    """The candidate with the least RMSE on ``val``, the chronological validation part, by successive halving.

    All candidates first grow a part of their trees, 1 in ``2 ** halvings``; the better half grows on from there to twice
    as many, until the last ones have all. ``workers`` candidates are fitted at a time, each from a thread of the driver
    and in a scheduler pool of its own (fair where ``spark.scheduler.mode`` is FAIR); they share the binned rows. Returns
    the best model as fitted, its parameters, and (trial, trees, rmse) of each candidate's last fit.
    """
    spark = train.sparkSession
    ready = prepare(train, features, target, seed=seed)
    fitted: dict[int, BoostedTrees] = {}
    scores: dict[int, float] = {}

    def grow(trial: int, part: int) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{trial}")
        params = candidates[trial]
        some = dataclasses.replace(params, trees=max(1, -(-params.trees // part)))
        fitted[trial] = fit_boosted(ready, some, seed=seed, start=fitted.get(trial))
        scores[trial] = float(rmse(fitted[trial].predict(val), target))

    alive = list(range(len(candidates)))
    for rung in range(halvings, -1, -1):
        with concurrent.futures.ThreadPoolExecutor(workers) as pool:
            work = inheritable_thread_target(spark)(grow)
            for done in [pool.submit(work, trial, 1 << rung) for trial in alive]:
                done.result()
        best = sorted(alive, key=lambda t: (scores[t], t))
        alive = best[: -(-len(best) // 2)] if rung else best
    history = spark.createDataFrame(
        [(t, len(fitted[t].trees), scores[t]) for t in sorted(scores)], "trial int, trees int, rmse double"
    )
    return fitted[alive[0]], candidates[alive[0]], history


def ensemble(df: DataFrame, residual: str = "abs_residual", isolation: str = "isolation", weight: float = 0.6) -> DataFrame:
    """Add ``ensemble_score``: both scores scaled to [0, 1] over the table and weighted."""
    scaled = normalise(df, {residual: "_r", isolation: "_i"})
    return scaled.withColumn(
        "ensemble_score", F.lit(weight) * F.col("_r") + F.lit(1 - weight) * F.col("_i")
    ).drop("_r", "_i")
