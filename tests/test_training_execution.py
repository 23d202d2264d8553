"""How training runs: partitions, node ids, models side by side. Each keeps the model it fits."""

import threading

import pytest
from pyspark.ml import Estimator, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tessera.operators import models
from tessera.plans import experiments, training


def rows(spark, n=400):
    df = spark.range(n).select((F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    return df.withColumn("price", F.col("a") * 3 + F.col("b") * F.col("b")).withColumn("label", (F.col("a") > 18).cast("int"))


class Seen(Transformer):
    """Predicts 0 and notes how many partitions it was given."""

    parts = None

    def _transform(self, df):
        Seen.parts = df.rdd.getNumPartitions()
        return df.withColumn("prediction", F.lit(0.0))


class Waits(Estimator):
    """Fits only while another one is being fitted."""

    def __init__(self, barrier):
        super().__init__()
        self.barrier = barrier

    def _fit(self, df):
        self.barrier.wait()
        return Seen()


def test_training_partitions_stay_with_the_cores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    most = max(spark.sparkContext.defaultParallelism, training.LEAST_PARTITIONS)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "600")
        assert training.training_partitions(spark) == most
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        assert training.training_partitions(spark) == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_test_rows_are_scored_over_partitions(spark):
    df = rows(spark).coalesce(1)
    experiments.fit_and_report(Pipeline(stages=[Seen()]), df, df, "regression", "price", partitions=6)
    assert Seen.parts == 6


def test_compared_models_are_fitted_side_by_side(spark):
    barrier = threading.Barrier(2, timeout=60)
    ests = {"one": Waits(barrier), "two": Waits(barrier)}
    out = experiments.compare_models(spark, rows(spark), rows(spark), Pipeline(stages=[]), ests, "regression", "price",
                                     n_in=500, parallelism=2).collect()
    assert [(r.model, r.n_in, r.n_scored) for r in out] == [("one", 500, 400), ("two", 500, 400)]


def test_a_failing_model_is_not_hidden_by_the_others(spark):
    class Fails(Estimator):
        def _fit(self, df):
            raise ValueError("no fit")

    with pytest.raises(ValueError, match="no fit"):
        experiments.compare_models(spark, rows(spark), rows(spark), Pipeline(stages=[]),
                                   {"seen": Pipeline(stages=[Seen()]), "fails": Fails()}, "regression", "price",
                                   parallelism=2)


@pytest.mark.parametrize("make,label", [(models.regressor, "price"), (models.classifier, "label")])
def test_boosted_trees_without_cached_node_ids_are_the_same(spark, make, label):
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows(spark)).coalesce(1).persist()
    est = make("gbt", maxIter=3, label=label)
    assert not est.getCacheNodeIds()
    plain, cached = est.fit(df), est.copy().setCacheNodeIds(True).fit(df)
    assert plain.totalNumNodes == cached.totalNumNodes > 3
    a, b = ([r.prediction for r in m.transform(df).select("prediction").collect()] for m in (plain, cached))
    assert a == pytest.approx(b, rel=1e-9)
    df.unpersist()


def test_even_partitions_are_whole_rounds_of_the_cores(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda _: cores))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "600")
        for cores, wanted in ((1, 8), (2, 8), (3, 9), (4, 8), (5, 10), (6, 6), (8, 8), (48, 48)):
            assert training.even_partitions(spark) == wanted
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        assert training.even_partitions(spark) == 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


class Layout(Estimator):
    """Notes the columns and the rows of each partition that it is given."""

    columns, parts = None, None

    def _fit(self, df):
        Layout.columns = df.columns
        Layout.parts = [list(map(tuple, p)) for p in df.rdd.glom().collect()]
        return Seen()


def compared(spark, df, est, **more):
    prep = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features")])
    return experiments.compare_models(spark, df, df, prep, {"m": est}, "regression", "price", **more).first()


def test_compared_models_get_the_columns_they_read_in_order(spark):
    r = compared(spark, rows(spark), Layout(), partitions=3, reads=["b", "price"])
    assert Layout.columns == ["b", "price"] and r.n_scored == 400
    assert len(Layout.parts) == 3 and all(p == sorted(p) and len(p) > 100 for p in Layout.parts)
    assert sorted(x for p in Layout.parts for x in p) == sorted(map(tuple, rows(spark).select("b", "price").collect()))
    compared(spark, rows(spark), Layout(), partitions=3)
    assert Layout.columns == ["a", "b", "price", "label", "features"]


def test_a_forest_does_not_depend_on_how_rows_come_to_a_partition(spark):
    def scored(*order):
        df = rows(spark).coalesce(1).sortWithinPartitions(*order)
        est = models.regressor("random_forest", numTrees=3, maxDepth=4)
        return compared(spark, df, est, partitions=1, reads=["features", "price"]).r2

    assert scored("a") == scored("b") == scored(F.desc("price")) > 0.5


def test_leaderboard_fits_the_longest_models_first(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(training, "census_parts", lambda *_: {"train": rows(spark), "val": rows(spark)})
    monkeypatch.setattr(training, "census_rows", lambda *_: 400)
    monkeypatch.setattr(experiments, "compare_models", lambda *a, **more: seen.update(more, names=list(a[4])))
    training.q_leaderboard(spark, "nowhere")
    assert set(seen["names"]) == set(models.CLASSIFIERS) and set(seen["names"][:3]) == set(training.LONGEST)
    assert seen["reads"] == ["features", "label"] and seen["partitions"] == training.even_partitions(spark)
