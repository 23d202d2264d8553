"""One-pass metrics agree with the Spark ML evaluators."""

import math

from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.sql import functions as F

from tessera.operators import evaluate


def test_multiclass_metrics_match_evaluator(spark):
    rows = [(float(i % 3), float((i * 5 + i // 4) % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    r = evaluate.classification_report(df, score=None).first()
    ev = MulticlassClassificationEvaluator()
    for ours, metric in [("accuracy", "accuracy"), ("weighted_precision", "weightedPrecision"),
                         ("weighted_recall", "weightedRecall"), ("f1", "f1")]:
        assert math.isclose(r[ours], ev.setMetricName(metric).evaluate(df), abs_tol=1e-10), ours


def test_never_predicted_class_counts_as_precision_zero(spark):
    rows = [(0.0, 0.0)] * 5 + [(1.0, 0.0)] * 3 + [(2.0, 2.0)] * 2
    df = spark.createDataFrame(rows, "label double, prediction double")
    r = evaluate.classification_report(df, score=None).first()
    ev = MulticlassClassificationEvaluator(metricName="weightedPrecision")
    assert math.isclose(r.weighted_precision, ev.evaluate(df), abs_tol=1e-10)


def test_auc_matches_evaluator_on_ties(spark):
    rows = [(float(i % 2), float((i * 7) % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "label double, score double")
    ours = evaluate.auc_roc(df, "label", "score").first().auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    assert math.isclose(ours, ev.evaluate(df), abs_tol=1e-10)


def test_regression_report_matches_evaluator(spark):
    df = spark.range(500).select(F.col("id").cast("double").alias("price"),
                                 (F.col("id") * 1.1 + F.sin("id") * 20).alias("prediction"))
    r = evaluate.regression_report(df, "price", "prediction").first()
    for metric in ("r2", "rmse", "mae"):
        ev = RegressionEvaluator(labelCol="price", predictionCol="prediction", metricName=metric)
        assert math.isclose(r[metric], ev.evaluate(df), rel_tol=1e-10), metric
    assert r.n_in == r.n_scored == 500


def test_confusion_matrix_uses_given_columns(spark):
    """Trap T-12: the reference hard-coded label/prediction."""
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], "truth double, guess double")
    rows = evaluate.confusion_matrix(df, "truth", "guess").collect()
    assert [(r.label, r.prediction, r.n) for r in rows] == [(0.0, 0.0, 1), (1.0, 0.0, 1), (1.0, 1.0, 1)]
