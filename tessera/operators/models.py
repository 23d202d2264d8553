"""Model registry (M1-M8, M15): name -> Spark ML estimator with the
reference's settings. A seed is always set (trap T-16: without one PySpark
derives it from the class name's hash, which changes between processes).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.ml.classification import (
    FMClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame

from tessera.functions.columns import md5_bucket

DEFAULT_SEED = 42

# The reference's model settings.
CLASSIFIERS: dict[str, tuple[type, dict[str, Any]]] = {
    "logistic_regression": (LogisticRegression, {"maxIter": 10}),
    "random_forest": (RandomForestClassifier, {"numTrees": 100, "maxDepth": 12, "maxBins": 100}),
    "gbt": (GBTClassifier, {"maxIter": 20, "maxDepth": 5}),
    "linear_svc": (LinearSVC, {"maxIter": 10}),
    "factorization_machine": (FMClassifier, {"stepSize": 0.001}),
}
REGRESSORS: dict[str, tuple[type, dict[str, Any]]] = {
    "linear": (LinearRegression, {}),
    "random_forest": (RandomForestRegressor, {"numTrees": 15, "maxDepth": 20}),
    "gbt": (GBTRegressor, {"maxIter": 100, "maxDepth": 8}),
}
TRACKED_RF = {"maxDepth": 10, "numTrees": 10, "maxBins": 42}

# Further settings of the tree ensembles: how many nodes are split per pass over the
# data, and whether node ids are cached between passes. Fewer passes for deep trees;
# node-id caches are checkpointed every ``checkpointInterval`` iterations into the
# shared folder. They belong to the model's settings: the order in which nodes are
# split decides which random feature subsets they get, so another ``maxMemoryInMB`` can
# give another forest from the same rows.
TREE_EXECUTION = {"maxMemoryInMB": 1024, "cacheNodeIds": True}
_TREES = (RandomForestClassifier, GBTClassifier, RandomForestRegressor, GBTRegressor)
# A boosted model grows one small tree at a time: sending it along costs less than a cached, broadcast and
# released table of node ids at every level of every tree. The splits are the same either way.
BOOSTED_EXECUTION = {"cacheNodeIds": False}
_BOOSTED = (GBTClassifier, GBTRegressor)


def _build(cls: type, params: dict[str, Any], features: str, label: str, seed: int):
    execution = {**(TREE_EXECUTION if issubclass(cls, _TREES) else {}),
                 **(BOOSTED_EXECUTION if issubclass(cls, _BOOSTED) else {})}
    kwargs = {**execution, **params}
    kwargs.update(featuresCol=features, labelCol=label)
    est = cls(**kwargs)
    if est.hasParam("seed"):
        est = est.setSeed(seed)
    return est


def classifier(name: str, features: str = "features", label: str = "label", seed: int = DEFAULT_SEED, **overrides):
    cls, params = CLASSIFIERS[name]
    return _build(cls, {**params, **overrides}, features, label, seed)


def regressor(name: str, features: str = "features", label: str = "price", seed: int = DEFAULT_SEED, **overrides):
    cls, params = REGRESSORS[name]
    return _build(cls, {**params, **overrides}, features, label, seed)


def with_min_bins(est, min_bins: int):
    """Raise ``maxBins`` of a tree model to at least ``min_bins`` (trap T-21)."""
    if est.hasParam("maxBins") and est.getOrDefault("maxBins") < min_bins:
        est = est.setMaxBins(int(min_bins))
    return est


FOLD = "fold"


def with_folds(df: DataFrame, key: str, folds: int = 3, salt: str = "fold") -> DataFrame:
    """``df`` with the fold of every row from md5 of its key: the same on any partitioning (T-17)."""
    return df.withColumn(FOLD, md5_bucket(key, folds, salt))


def cross_validator(pipeline, grid: dict[Any, Sequence[Any]], evaluator=None, folds: int = 3,
                    parallelism: int = 2, seed: int = DEFAULT_SEED, task: str = "classification") -> CrossValidator:
    """Grid search with k-fold cross-validation (folds fit in parallel) over rows from ``with_folds``."""
    builder = ParamGridBuilder()
    for p, values in grid.items():
        builder = builder.addGrid(p, list(values))
    if evaluator is None:
        evaluator = BinaryClassificationEvaluator() if task == "classification" else RegressionEvaluator()
    return CrossValidator(estimator=pipeline, estimatorParamMaps=builder.build(), evaluator=evaluator,
                          numFolds=folds, parallelism=parallelism, seed=seed, foldCol=FOLD)
