"""Evaluation (V1-V6) as aggregations over the predictions.

* Classification: one aggregate builds the confusion table (classes^2 rows); the
  accuracy / weighted precision / weighted recall / F1 formulas run on that
  tiny table. Same definitions as ``MulticlassClassificationEvaluator``
  (a class that is never predicted has precision 0). Only AUC needs the scores'
  order; rows without a score (NULL or NaN) are left out of it and counted.
* AUC: positives and negatives are counted per distinct score, negatives are
  summed cumulatively with ``prefix_sums`` (no single-partition window) and
  ``AUC = sum(pos * (neg_below + neg_tied / 2)) / (P * N)`` - the exact ROC
  area with ties counted half, i.e. ``BinaryClassificationEvaluator`` with
  every threshold.
* Regression: one aggregate gives R^2, RMSE and MAE.
Every report also says how many rows came in and how many were scored (T-3).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.prefix import prefix_sums
from tessera.session import scratch_path


def score_expr(df: DataFrame, score: str) -> Column:
    """Positive-class score: element 1 of a raw/probability vector, or the column itself.
    A vector of another size than 2 is not a two-class score: an error."""
    if isinstance(df.schema[score].dataType, VectorUDT):
        v = vector_to_array(F.col(score))
        bad = F.raise_error(F.concat(F.lit("a two-class score has 2 elements, not "), F.size(v).cast("string")))
        return F.when(v.isNull(), F.lit(None).cast("double")).when(F.size(v) == 2, v[1]).otherwise(bad.cast("double"))
    return F.col(score).cast("double")


# V3 ---------------------------------------------------------------------------
def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, n)`` ordered by label, prediction (uses the given columns, T-12)."""
    return (
        pred.groupBy(F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("prediction"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("label", "prediction")
    )


def _metrics_from_counts(cm: DataFrame) -> DataFrame:
    """One row (accuracy, weighted_precision, weighted_recall, f1, n_scored)
    from a confusion table ``(y, p, n)`` - classes^2 rows."""
    # Per class: true positives, rows with that label, rows with that prediction.
    # One union + one aggregate (no join between the two views of the table).
    zero = F.lit(0).cast("bigint")
    as_label = cm.select(F.col("y").alias("c"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero)
                         .alias("tp"), F.col("n").alias("n_label"), zero.alias("n_pred"))
    as_pred = cm.select(F.col("p").alias("c"), zero.alias("tp"), zero.alias("n_label"), F.col("n").alias("n_pred"))
    per = as_label.unionByName(as_pred).groupBy("c").agg(
        F.sum("tp").alias("tp"), F.sum("n_label").alias("n_label"), F.sum("n_pred").alias("n_pred")
    ).filter(F.col("n_label") > 0)
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    rec = F.col("tp") / F.col("n_label")
    per = per.select("tp", "n_label", prec.alias("prec"), rec.alias("rec"))
    f1c = F.when(F.col("prec") + F.col("rec") > 0, 2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec")))
    per = per.withColumn("f1c", F.coalesce(f1c, F.lit(0.0)))
    total = F.sum("n_label")
    return per.agg(
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(F.col("prec") * F.col("n_label")) / total).alias("weighted_precision"),
        (F.sum(F.col("rec") * F.col("n_label")) / total).alias("weighted_recall"),
        (F.sum(F.col("f1c") * F.col("n_label")) / total).alias("f1"),
        total.cast("bigint").alias("n_scored"),
    )


def _auc(df: DataFrame) -> DataFrame:
    """One row ``auc, n_auc`` from rows with ``y`` and ``s``."""
    ok = F.col("y").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s")
    positive = (F.col("y") > 0.5).cast("bigint")
    by_score = df.filter(ok).groupBy("s").agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    ranked = prefix_sums(by_score, "s", ["neg"])
    credit = F.col("pos").cast("double") * (F.col("neg_before").cast("double") + F.col("neg").cast("double") / 2)
    pn = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg((F.sum(credit) / F.nullif(pn, F.lit(0.0))).alias("auc"),
                      F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0)).cast("bigint").alias("n_auc"))


# V2 ---------------------------------------------------------------------------
def auc_roc(pred: DataFrame, label: str = "label", score: str = "rawPrediction") -> DataFrame:
    """One row ``auc``: exact area under the ROC curve, ties counted half."""
    s = pred.select(F.col(label).cast("double").alias("y"), score_expr(pred, score).alias("s"))
    return _auc(s).select("auc")


# V1 ---------------------------------------------------------------------------
def classification_report(
    pred: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    score: str | None = "rawPrediction",
) -> DataFrame:
    """One row: ``accuracy, weighted_precision, weighted_recall, f1, auc, n_in, n_scored, n_auc``.

    The label, prediction and score of every row are written once to the shared folder
    (so the model is applied once); the confusion table is a direct aggregate of that,
    only AUC groups by score. Weighted recall equals accuracy by definition (T-14);
    both are returned (T-13). ``n_auc`` rows have a label and a score.
    """
    spark = pred.sparkSession
    has_score = score is not None and score in pred.columns
    s = score_expr(pred, score) if has_score else F.lit(None).cast("double")
    z = pred.select(F.col(label).cast("double").alias("y"), F.col(prediction).cast("double").alias("p"), s.alias("s"))
    path = scratch_path(spark, "scored")
    z.write.parquet(path)
    z = spark.read.schema(z.schema).parquet(path)
    every = z.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))
    cm = every.filter(F.col("y").isNotNull() & F.col("p").isNotNull())
    m = _metrics_from_counts(cm)
    dbl, counts = ["accuracy", "weighted_precision", "weighted_recall", "f1", "auc"], ["n_in", "n_scored", "n_auc"]
    parts = [m, every.agg(F.sum("n").cast("bigint").alias("n_in"))]
    if has_score:
        parts.append(_auc(z))
    # Each part is one row with some of the columns.
    u = None
    for part in parts:
        row = part.select(*[F.col(c) if c in part.columns else F.lit(None).cast(t).alias(c)
                            for t, names in (("double", dbl), ("bigint", counts)) for c in names])
        u = row if u is None else u.unionByName(row)
    return u.agg(*[F.max(c).alias(c) for c in dbl], *[F.coalesce(F.max(c), F.lit(0).cast("bigint")).alias(c)
                                                      for c in counts])


# V4 ---------------------------------------------------------------------------
def regression_report(pred: DataFrame, label: str = "price", prediction: str = "prediction") -> DataFrame:
    """One row: ``r2, rmse, mae, n_in, n_scored`` in a single aggregate."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    ok = y.isNotNull() & p.isNotNull() & ~F.isnan(y) & ~F.isnan(p)
    e = F.when(ok, y - p)
    yv = F.when(ok, y)
    agg = pred.agg(
        F.sum(e * e).alias("sse"),
        (F.var_pop(yv) * F.count(yv)).alias("sst"),
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.count(F.lit(1)).alias("n_in"),
        F.count_if(ok).cast("bigint").alias("n_scored"),
    )
    return agg.select(
        (F.lit(1.0) - F.col("sse") / F.nullif(F.col("sst"), F.lit(0.0))).alias("r2"),
        F.sqrt("mse").alias("rmse"),
        "mae",
        "n_in",
        "n_scored",
    )


# V5 ---------------------------------------------------------------------------
def residuals(pred: DataFrame, label: str = "price", prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label), F.col(prediction)
    return pred.withColumns({"error": y - p, "abs_error": F.abs(y - p)})


def worst_residuals(pred: DataFrame, label: str = "price", prediction: str = "prediction", key: str = "id",
                    n: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Every row's error, the largest first (ties by key); with ``n`` only the first n of them."""
    r = residuals(pred, label, prediction)
    cols = [key, *keep, label, prediction, "error", "abs_error"]
    out = r.select(*cols).orderBy(F.desc("abs_error"), F.asc(key))
    return out if n is None else out.limit(int(n))


# V6 ---------------------------------------------------------------------------
def tree_bound(pred: DataFrame, train: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """``(max_prediction, max_train_label, bounded)``: a forest's prediction is
    an average of training labels, so it never exceeds the training maximum."""
    u = pred.select(F.col(prediction).cast("double").alias("p"), F.lit(None).cast("double").alias("y")).unionByName(
        train.select(F.lit(None).cast("double").alias("p"), F.col(label).cast("double").alias("y"))
    )
    m = u.agg(F.max("p").alias("max_prediction"), F.max("y").alias("max_train_label"))
    return m.withColumn("bounded", F.col("max_prediction") <= F.col("max_train_label") + F.lit(1e-9))
