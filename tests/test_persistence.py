"""Pipelines with the library's own stages save and load."""

from pyspark.ml import Pipeline, PipelineModel

from tessera.operators import clean, features, impute
from tessera.session import scratch_path


def test_custom_stages_round_trip(spark):
    df = spark.createDataFrame(
        [(1, " a", " x", 2.0), (2, " ?", " x", None), (3, " b", "", 5.0), (4, " b", " y", 1.0), (5, "", " y", 3.0)],
        "id int, g string, t string, v double")
    pipe = Pipeline(stages=[
        clean.SentinelToNull(),
        clean.TrimStrings(),
        impute.GroupedModeImputer(targetCols=["t"], groupCols=["g"]),
        impute.ModeImputer(inputCols=["g"]),
        clean.FillConstant(inputCols=["t"], value="Unknown"),
        clean.TopKCategoryMask(inputCol="t", k=1),
        impute.CastColumns(inputCols=["id"]),
    ])
    model = pipe.fit(df)
    path = scratch_path(spark, "pipeline-test")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    a = sorted(map(tuple, model.transform(df).collect()), key=str)
    b = sorted(map(tuple, loaded.transform(df).collect()), key=str)
    assert a == b


def test_group_modes_travel_with_the_saved_model(spark, tmp_path):
    """Only the model's own folder is needed to load it, whatever the size of its table."""
    import shutil

    rows = [(i, "x" if i % 3 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "g int, t string")
    model = impute.GroupedModeImputer(targetCols=["t"], groupCols=["g"]).fit(df)
    want = sorted(map(tuple, model.transform(df).collect()))
    model.write().overwrite().save(str(tmp_path / "model"))
    shutil.copytree(tmp_path / "model", tmp_path / "copy")
    shutil.rmtree(tmp_path / "model")
    shutil.rmtree(model.table_path.removeprefix("file:"))
    loaded = impute.GroupedModeImputerModel.load(str(tmp_path / "copy"))
    assert sorted(map(tuple, loaded.transform(df).collect())) == want
    assert loaded.transform(df).filter("t IS NULL").count() == 0


def test_lookup_join_keeps_rows_without_a_match(spark):
    from tessera.operators.joins import lookup_join

    big = spark.createDataFrame([(i % 3 if i % 5 else None, i) for i in range(300)], "k int, v int")
    lk = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k int, name string")
    got = lookup_join(big, lk, ["k"]).collect()
    assert len(got) == 300 and all((r.name is None) == (r.k is None) for r in got)


def test_log_target_model_scores_rows_without_a_label(spark, tmp_path):
    from tessera.operators import models

    df = spark.createDataFrame([(float(i), float(2 ** i) if i else 0.0) for i in range(12)], "x double, price double")
    model = features.log_target([features.assembler(["x"])], models.regressor("linear"), "price").fit(df)
    assert model.n_left_out == 1  # the price of 0
    model.write().overwrite().save(str(tmp_path / "log"))
    loaded = features.LogTargetModel.load(str(tmp_path / "log"))
    assert loaded.n_left_out == 1
    row = loaded.transform(df.drop("price").filter("x = 5")).first()
    assert abs(row.prediction - 32.0) < 1e-3 and abs(row.log_prediction - 3.4657) < 1e-3
