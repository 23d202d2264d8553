"""One test per semantic trap that the library fixes."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import safe_corr
from tessera.operators import clean, features, impute, models, profile
from tessera.plans import fixtures


def test_t1_leading_space_is_removed_at_the_source(spark, tmp_path):
    path = str(tmp_path / "adult.csv")
    with open(path, "w") as fh:
        fh.write("39, State-gov, 77516, >50K\n50, ?, 83311, <=50K\n")
    from tessera.sources import read_csv

    df = read_csv(spark, path, schema="_c0 int, _c1 string, _c2 double, _c3 string",
                  names=["age", "workclass", "fnlwgt", "income"])
    rows = df.collect()
    assert rows[0].income == ">50K" and rows[0].fnlwgt == 77516.0 and rows[1].workclass == "?"


def test_t3_unseen_category_keeps_the_row(spark):
    train = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    test = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    model = features.string_indexer(["c"]).fit(train)
    assert model.transform(test).count() == 3


def test_t5_null_and_negative_rows_go_to_bad(spark):
    df = spark.createDataFrame([(1.0,), (None,), (-1.0,), (0.0,)], "x double")
    good, bad = clean.split_valid(df, clean.valid_rule(["x"]))
    assert good.count() == 1 and bad.count() == 3


def test_t6_t7_mode_ties_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,), (None,)], "c string")
    m = profile.modes(df, ["c"]).first()
    assert (m.value, m.n) == ("a", 1)


def test_t9_all_null_column_is_a_clear_error(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    with pytest.raises(Exception):
        impute.mean_mode_imputer(["a", "b"], []).fit(df)


def test_t10_int_column_mean_is_not_truncated(spark):
    df = spark.createDataFrame([(1,), (2,), (8,), (None,)], "a int")
    out = impute.mean_mode_imputer(["a"], []).fit(df).transform(df)
    vals = sorted(r.a for r in out.collect())
    assert vals == [1.0, 2.0, 11 / 3, 8.0]


def test_t11_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    p = profile.missing_profile(df).first()
    assert p.n_missing == 2
    assert clean.drop_missing(df).count() == 1


def test_t16_seed_is_always_set():
    for name in models.CLASSIFIERS:
        est = models.classifier(name)
        if est.hasParam("seed"):
            assert est.getOrDefault("seed") == models.DEFAULT_SEED
    for name in models.REGRESSORS:
        est = models.regressor(name)
        if est.hasParam("seed"):
            assert est.getOrDefault("seed") == models.DEFAULT_SEED


def test_t21_max_bins_follow_category_count(spark):
    from pyspark.ml import Pipeline

    n = 5000
    df = spark.range(n).select(F.col("id").cast("string").alias("c"), (F.col("id") % 2).cast("double").alias("label"))
    prep = features.indexed(["c"], [], handle_invalid="error").fit(df)
    assert features.category_counts(prep) == {"c": n}
    est = models.with_min_bins(models.classifier("random_forest", maxBins=32, numTrees=1, maxDepth=2),
                               max(features.category_counts(prep).values()))
    assert est.getOrDefault("maxBins") == n
    Pipeline(stages=[est]).fit(prep.transform(df))  # with one bin less the tree refuses


def test_one_category_column_is_named(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x")], "c string, d string")
    prep = features.string_indexer(["c", "d"], handle_invalid="error")
    from pyspark.ml import Pipeline

    with pytest.raises(ValueError, match="'d'"):
        features.check_levels(Pipeline(stages=[prep]).fit(df))


def test_t23_constant_column_correlation_is_null(spark):
    df = spark.range(10).select(F.lit(1.0).alias("a"), F.col("id").cast("double").alias("b"))
    assert df.agg(safe_corr("a", "b").alias("c")).first().c is None
    rows = profile.correlations(df, "b", ["a"]).collect()
    assert rows[0].corr is None


def test_correlation_uses_complete_pairs_only(spark):
    rows = [(1.0, 1.0), (2.0, 2.0), (9.0, 9.0)] + [(5.0, None)] * 4 + [(float("nan"), 3.0)]
    df = spark.createDataFrame(rows, "a double, `b.c` double")
    assert abs(profile.correlations(df, "a", ["b.c"]).first()["corr"] - 1.0) < 1e-12
    assert {r["column"]: r.n_missing for r in profile.missing_profile(df).collect()} == {"a": 1, "b.c": 4}


def test_summary_keeps_small_values_and_empty_columns(spark):
    df = spark.createDataFrame([(1e-7, None), (2e-7, None), (float("nan"), None)], "v double, e double")
    rows = {r["column"]: r for r in profile.summary_exact(df).collect()}
    assert abs(rows["v"]["mean"] - 1.5e-7) < 1e-20 and rows["v"].n == 2 and rows["v"]["max"] == 2e-7
    assert rows["e"].n == 0 and rows["e"]["mean"] is None and rows["e"].p50 is None
    assert {r["column"]: r.n for r in profile.modes(df.select("e"), ["e"]).collect()} == {"e": 0}


def test_split_covers_null_keys_and_refuses_parts_too_small(spark):
    from tessera.operators import split

    df = spark.createDataFrame([(None,), (1,), (None,), (2,)], "k int")
    parts = split.hash_split(df, "k", {"a": 0.5, "b": 0.5})
    assert sum(p.count() for p in parts.values()) == 4
    with pytest.raises(ValueError):
        split.cuts({"a": 1.0, "b": 1e-12, "c": 1.0})


def test_literal_rows_refuse_values_of_another_type(spark):
    from tessera.sources.files import literal_rows

    with pytest.raises(Exception):
        literal_rows(spark, [(3.7,)], "a int")


def test_all_null_string_column_is_an_error(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    with pytest.raises(impute.NoModeError):
        impute.ModeImputer(inputCols=["x", "y"]).fit(df)


def test_verified_steps_raise_when_cells_stay_missing(spark):
    df = spark.createDataFrame([("a", None), ("b", "y")], "x string, y string")
    model = impute.ModeImputer(inputCols=["x"]).fit(df)
    assert impute.fill_verified(model, df, ["x"]).count() == 2
    with pytest.raises(profile.MissingCellsError):
        impute.fill_verified(model, df, ["x", "y"])
    kept, counts = clean.drop_missing_verified(df)
    assert kept.count() == 1 and counts == {"n_in": 2, "n_out": 1, "n_dropped": 1}
    good, bad, n = clean.split_valid_checked(df, F.col("y").isNotNull())
    assert (good.count(), bad.count(), n["n_rows"]) == (1, 1, 2)


def test_auc_refuses_scores_of_more_than_two_classes(spark):
    from pyspark.ml.linalg import Vectors

    from tessera.operators import evaluate

    df = spark.createDataFrame([(1.0, Vectors.dense([0.1, 0.2, 0.7])), (0.0, Vectors.dense([0.5, 0.2, 0.3]))],
                               ["label", "rawPrediction"])
    with pytest.raises(Exception, match="2 elements"):
        evaluate.auc_roc(df).collect()


def test_rows_without_a_score_are_counted(spark):
    from tessera.operators import evaluate

    df = spark.createDataFrame([(1.0, 1.0, 0.9), (0.0, 0.0, 0.1), (1.0, 1.0, float("nan"))],
                               "label double, prediction double, rawPrediction double")
    r = evaluate.classification_report(df).first()
    assert (r.n_in, r.n_scored, r.n_auc, r.auc) == (3, 3, 2, 1.0)


def test_grouped_mode_null_group_falls_back_to_global(spark):
    """T-8: NULL group keys never match; the global mode fills them."""
    df = spark.createDataFrame(
        [("g1", "x"), ("g1", "x"), ("g1", None), (None, None), ("g2", "y"), ("g2", "y"), ("g2", "y")],
        "g string, t string")
    model = impute.GroupedModeImputer(targetCols=["t"], groupCols=["g"]).fit(df)
    out = sorted((r.g or "", r.t) for r in model.transform(df).collect())
    assert out == [("", "y"), ("g1", "x"), ("g1", "x"), ("g1", "x"), ("g2", "y"), ("g2", "y"), ("g2", "y")]


def test_label_null_stays_null(spark):
    df = spark.createDataFrame([(">50K",), ("<=50K",), (None,)], "income string")
    labels = [r.label for r in clean.binary_label(df, "income", ">50K").collect()]
    assert labels == [1, 0, None]


def test_functional_dependency_detects_both_directions(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1), ("c", 2)], "x string, y int")
    r = profile.functional_dependency(df, "x", "y").first()
    assert r.a_determines_b and not r.b_determines_a and r.n_pairs == 3


def test_fixture_levels_cover_data(spark):
    from conftest import SF_SMALL

    g = fixtures.gems(spark, SF_SMALL)
    for c, levels in fixtures.GEMS_ORDINAL_LEVELS.items():
        assert {r[0] for r in g.select(c).distinct().collect()} <= set(levels)
