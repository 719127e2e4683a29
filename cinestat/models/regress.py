"""Regressors on feature tables: factories, grouped cross-validation, ensembles, stacking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window, functions as F

Factory = Callable[[], Estimator]


def boosted_trees(depth: int = 5, trees: int = 1000, rate: float = 0.1, loss: str = "squared", seed: int = 0) -> Factory:
    """Gradient boosting; MLlib offers squared and absolute loss."""
    return lambda: GBTRegressor(
        maxDepth=depth, maxIter=trees, stepSize=rate, lossType=loss, seed=seed, featuresCol="features", labelCol="label"
    )


def ridge(alpha: float = 0.001) -> Factory:
    """Linear model with an L2 penalty on standardised features."""
    return lambda: LinearRegression(elasticNetParam=0.0, regParam=alpha, standardization=True, solver="normal")


def linear() -> Factory:
    return lambda: LinearRegression(regParam=0.0, solver="normal")


def fit(train: DataFrame, features: list[str], factory: Factory, normalize: bool = False) -> PipelineModel:
    """Assemble, optionally standardise (on the training rows only) and fit."""
    raw = "raw" if normalize else "features"
    stages: list = [VectorAssembler(inputCols=features, outputCol=raw)]
    if normalize:
        stages.append(StandardScaler(inputCol=raw, outputCol="features", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, factory()]).fit(train)


def out_of_fold(
    df: DataFrame, features: list[str], factory: Factory, *, fold: str = "fold", k: int = 10, normalize: bool = False
) -> tuple[DataFrame, list[PipelineModel]]:
    """Predictions of every row by the model that did not see its fold, and the k models.

    The folds are trained one after the other: each fit already uses the cluster.
    """
    models = [fit(df.where(F.col(fold) != i), features, factory, normalize) for i in range(k)]
    drop = ["features", *(["raw"] if normalize else [])]
    parts = [m.transform(df.where(F.col(fold) == i)).drop(*drop) for i, m in enumerate(models)]
    return reduce(DataFrame.unionByName, parts), models


def linear_out_of_fold(
    df: DataFrame, features: list[str], *, label: str = "label", fold: str = "fold", alpha: float = 0.0
) -> DataFrame:
    """Out-of-fold predictions of a linear or ridge model from one aggregation.

    A fold's training moments are the whole table's minus its own, so one row of moments per
    fold is all that is gathered, and the rows are read once more to be scored.  ``alpha``
    penalises coefficients of features standardised on the training rows.
    """
    p = len(features)
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(label).cast("double")]
    pairs = [(i, j) for i in range(p + 2) for j in range(i, p + 2)]
    got = df.groupBy(fold).agg(*[F.sum(cols[i] * cols[j]).alias(f"m{i}_{j}") for i, j in pairs]).collect()
    moments = {}
    for r in got:
        m = np.zeros((p + 2, p + 2))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        moments[r[fold]] = m
    total = sum(moments.values())
    out = F.lit(None).cast("double")
    for k, own in moments.items():
        m = total - own
        mean = m[0] / m[0, 0]
        cov = m / m[0, 0] - np.outer(mean, mean)
        std = np.sqrt(np.diag(cov))[1 : p + 1]
        std[std == 0] = 1.0
        left = cov[1 : p + 1, 1 : p + 1] / np.outer(std, std) + alpha * np.eye(p)
        b = np.linalg.lstsq(left, cov[1 : p + 1, p + 1] / std, rcond=None)[0] / std
        value = F.lit(float(mean[p + 1]))
        for c, w, centre in zip(cols[1:-1], b, mean[1:]):
            value = value + F.lit(float(w)) * (c - F.lit(float(centre)))
        out = F.when(F.col(fold) == k, value).otherwise(out)
    return df.withColumn("prediction", out)


def ensemble_mean(models: list[PipelineModel], df: DataFrame, key: list[str]) -> DataFrame:
    """Mean prediction of several models; the rows are scored side by side, not joined."""
    scored = df
    for i, m in enumerate(models):
        scored = m.transform(scored).withColumnRenamed("prediction", f"p{i}").drop("features", "raw")
    total = reduce(lambda a, b: a + b, [F.col(f"p{i}") for i in range(len(models))])
    return scored.select(*key, (total / len(models)).alias("prediction"))


def relative_importance(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """Importance scaled to 100 at the strongest feature, strongest first."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(features, values)), "feature string, importance double")
    top = F.max("importance").over(Window.partitionBy())  # one row per feature
    return rows.select("feature", (100 * F.try_divide(F.col("importance"), top)).alias("relative")).orderBy(
        F.desc("relative"), "feature"
    )


def train_detector(samples: DataFrame, descriptor: str, label: str, penalties: list[float], folds: int = 10, seed: int = 0):
    """Linear detector on descriptors: regression onto -1/+1, penalty chosen by cross-validation.

    Each fit is one pass over the data (normal equations).  Returns weights and bias.
    """
    target = F.when(F.col(label) > 0, 1.0).otherwise(-1.0)
    data = samples.select(array_to_vector(F.col(descriptor)).alias("features"), target.alias("label"))
    reg = LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False)
    grid = ParamGridBuilder().addGrid(reg.regParam, penalties).build()
    cv = CrossValidator(
        estimator=reg, estimatorParamMaps=grid, evaluator=RegressionEvaluator(), numFolds=folds, seed=seed
    )
    best = cv.fit(data).bestModel
    return best.coefficients.toArray(), best.intercept
