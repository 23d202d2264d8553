"""Experiments: model comparison (M11), imputation-strategy comparison (C12),
tracked training runs (M14) and the run log (K1-K5).

The run log replaces the tracking server: an append-only Parquet table
``(run_id, ts, kind, key, value)`` partitioned by ``run_id`` in a folder that the
caller names, with the saved models beside it, so runs of other sessions are there to
compare; ``compare_runs`` pivots it into one row per run.
Training inputs are persisted (MEMORY_AND_DISK) around the model loop and
released in ``finally``; if an executor is lost, the cached blocks are
recomputed from the lineage.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import Any

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluate, features, interpret
from tessera.session import checkpoint_dir
from tessera.sources.files import literal_rows
from tessera.sources.models import save_model

RUNS_SCHEMA = "run_id string, ts timestamp, kind string, key string, value string"


def _report(pred: DataFrame, task: str, label: str) -> DataFrame:
    if task == "classification":
        score = "rawPrediction" if "rawPrediction" in pred.columns else None
        return evaluate.classification_report(pred, label, "prediction", score)
    return evaluate.regression_report(pred, label, "prediction")


def _report_table(spark: SparkSession, key: str, rows: list[dict]) -> DataFrame:
    """One row per compared item: ``key`` string, then the report's columns."""
    cols = [c for c in rows[0] if c != key]
    ddl = ", ".join([f"{key} string"] + [f"{c} {'bigint' if c.startswith('n_') else 'double'}" for c in cols])
    return literal_rows(spark, [[r[key], *[r[c] for c in cols]] for r in rows], ddl)


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """``df`` dealt over so many partitions, or as it is: a table that is read from few splits but
    passed over many times is worth one shuffle."""
    return df if partitions is None else df.repartition(int(partitions))


def ordered(df: DataFrame, partitions: int | None, columns: Sequence[str] | None) -> DataFrame:
    """These columns of ``df``, ``spread``, and sorted by them inside each partition (all columns and as they
    come with ``None``). Rows that are alike go through the same nodes of a tree: one after another they find
    the statistics of these nodes in the processor's caches, while rows as they come fetch them from memory for
    every tree. Equal rows are interchangeable, so a partition's order depends on its rows only."""
    if columns is None:
        return spread(df, partitions)
    return spread(df.select(*columns), partitions).sortWithinPartitions(*columns)


def fit(pipeline: Pipeline, train: DataFrame, partitions: int | None = None):
    """Fit with the training input (``spread`` over ``partitions``) persisted
    (MEMORY_AND_DISK) for the duration of the fit: indexers, scalers and the model's own passes read the cached
    rows instead of recomputing the upstream plan. Released in ``finally``.
    The shared checkpoint folder is registered first, so iterative models
    (``checkpointInterval``) can cut their lineage."""
    checkpoint_dir(train.sparkSession)
    cached = spread(train, partitions).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return pipeline.fit(cached)
    finally:
        cached.unpersist()


def fit_and_report(pipeline: Pipeline, train: DataFrame, test: DataFrame, task: str, label: str,
                   n_in: int | None = None, partitions: int | None = None):
    """(fitted model, one-row report of the model on ``test``).

    ``n_in`` of the report is the number of rows before any was dropped: the caller's
    count, or else those of ``test`` (a stage that skips rows then shows in ``n_scored``).
    ``test`` is ``spread`` like the training input: a large model scores a small file in many tasks."""
    model = fit(pipeline, train, partitions)
    n_in = test.count() if n_in is None else n_in
    return model, _report(model.transform(spread(test, partitions)), task, label).withColumn("n_in", F.lit(int(n_in)).cast("bigint"))


def compare_models(
    spark: SparkSession,
    train: DataFrame,
    val: DataFrame,
    prep: Pipeline,
    estimators: Mapping[str, Any],
    task: str = "classification",
    label: str = "label",
    sort_by: str | None = None,
    n_in: int | None = None,
    partitions: int | None = None,
    parallelism: int = 1,
    reads: Sequence[str] | None = None,
) -> DataFrame:
    """Fit the preprocessing once on ``train``, fit every estimator on the
    prepared train set, score ``val``; one report row per model, best first.
    Up to ``parallelism`` estimators are fitted and scored at once, in their order: their many short
    jobs fill the cores that one of them leaves idle, so the longest ones go first.
    ``reads``: the prepared columns that the estimators and the report read; only these are kept, ``ordered``.
    Only the report rows (one per model) reach the driver."""
    checkpoint_dir(spark)
    n_val = val.count() if n_in is None else n_in
    prep_model = fit(prep, train)
    features.check_levels(prep_model)
    tr, va = (ordered(prep_model.transform(df), partitions, reads).persist(StorageLevel.MEMORY_AND_DISK)
              for df in (train, val))

    def scored(name: str, est) -> dict[str, Any]:
        rep = _report(est.fit(tr).transform(va), task, label).first().asDict()
        return {"model": name, **rep, "n_in": n_val}

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            # Each thread has job properties of its own.
            runs = [inheritable_thread_target(spark)(partial(scored, *item)) for item in estimators.items()]
            rows = list(pool.map(lambda run: run(), runs))
    finally:
        tr.unpersist()
        va.unpersist()
    sort_by = sort_by or ("auc" if task == "classification" else "r2")
    return _report_table(spark, "model", rows).orderBy(F.desc_nulls_last(sort_by), F.asc("model"))


def compare_imputers(
    spark: SparkSession,
    train: DataFrame,
    val: DataFrame,
    strategies: Mapping[str, Pipeline],
    prep: Pipeline,
    estimator,
    label: str = "label",
    partitions: int | None = None,
) -> DataFrame:
    """Each imputation strategy is fitted on ``train`` only and applied to
    both parts (no statistics from ``val``, trap T-4); same features and model.
    ``n_in`` is the rows of ``val`` before the strategy, ``n_scored`` those it left: a
    strategy that drops rows is scored on fewer."""
    rows, n_val = [], val.count()
    for name, strategy in strategies.items():
        imp = fit(strategy, train, partitions)
        tr, va = imp.transform(train), imp.transform(val)
        pipe = Pipeline(stages=[*prep.getStages(), estimator])
        _, rep = fit_and_report(pipe, tr, va, "classification", label, n_val, partitions)
        rows.append({"strategy": name, **rep.first().asDict()})
    return _report_table(spark, "strategy", rows).orderBy(F.desc_nulls_last("auc"), F.asc("strategy"))


# Run log ------------------------------------------------------------------------
def log_run(spark: SparkSession, path: str, run_id: str, params: Mapping[str, Any], metrics: Mapping[str, Any],
            artifacts: Mapping[str, str]) -> None:
    """K1-K3: append one run's params, metrics and artifact locations to the log at ``path``."""
    rows = [(run_id, "param", k, str(v)) for k, v in params.items()]
    rows += [(run_id, "metric", k, repr(float(v)) if v is not None else None) for k, v in metrics.items()]
    rows += [(run_id, "artifact", k, v) for k, v in artifacts.items()]
    df = literal_rows(spark, rows, "run_id string, kind string, key string, value string")
    df = df.select("run_id", F.current_timestamp().alias("ts"), "kind", "key", "value")
    df.write.mode("append").partitionBy("run_id").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS_SCHEMA).parquet(path)


def compare_runs(runs: DataFrame, params: Sequence[str] = (), metrics: Sequence[str] = (),
                 artifacts: Sequence[str] = (), order_metric: str | None = None) -> DataFrame:
    """K4: one row per run; columns ``<kind>_<key>`` for the named keys (NULL where a run lacks one)."""
    keys = [("param", k) for k in params] + [("metric", k) for k in metrics] + [("artifact", k) for k in artifacts]
    names = [f"{kind}_{k}" for kind, k in keys]
    wide = runs.withColumn("name", F.concat_ws("_", "kind", "key")).groupBy("run_id").pivot("name", names).agg(
        F.max("value"))
    if order_metric:
        wide = wide.orderBy(F.col(f"metric_{order_metric}").cast("double").desc_nulls_last(), "run_id")
    return wide


def estimator_params(est, names: Sequence[str]) -> dict[str, Any]:
    """The settings of an estimator as it will be fitted."""
    return {n: est.getOrDefault(n) for n in names}


def tracked_run(
    spark: SparkSession,
    pipeline: Pipeline,
    train: DataFrame,
    test: DataFrame,
    params: Mapping[str, Any],
    path: str,
    task: str = "classification",
    label: str = "label",
    importance_names: Sequence[str] | None = None,
    on_error: str = "raise",
    n_in: int | None = None,
    partitions: int | None = None,
) -> str:
    """Fit, save the model, score, log params/metrics/artifacts; returns the run id.

    The log is the folder ``path/log``, models and importance tables lie in
    ``path/artifacts``: a durable folder of the caller's. ``on_error="warn"`` records a
    failed save of either as an artifact ``<name>_error`` with the whole message
    instead of raising (K5)."""
    run_id = uuid.uuid4().hex
    base = f"{path.rstrip('/')}/artifacts/{run_id}"
    model = fit(pipeline, train, partitions)
    artifacts: dict[str, str] = {}

    def attempt(name: str, save) -> None:
        uri = f"{base}/{name}"
        try:
            save(uri)
            artifacts[name] = uri
        except Exception as exc:  # noqa: BLE001 - K5: policy decides
            if on_error == "raise":
                raise
            warnings.warn(f"{name} save failed: {exc}")
            artifacts[f"{name}_error"] = str(exc)

    attempt("model", lambda uri: save_model(model, uri))
    n_in = test.count() if n_in is None else n_in
    rep = _report(model.transform(test), task, label).first().asDict() | {"n_in": n_in}
    metrics = {k: v for k, v in rep.items() if not k.startswith("n_")}
    metrics.update({k: v for k, v in rep.items() if k.startswith("n_")})
    if importance_names is not None:
        attempt("importance", lambda uri: interpret.importance(
            spark, model.stages[-1], importance_names).write.mode("overwrite").parquet(uri))
    log_run(spark, log_path(path), run_id, params, metrics, artifacts)
    return run_id


def log_path(path: str) -> str:
    return f"{path.rstrip('/')}/log"
