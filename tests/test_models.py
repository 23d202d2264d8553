"""Model queries run end to end; quality gates on the derived fixtures."""

import pytest

import __spark_entry__ as E
from conftest import SF_MID, SF_SMALL


def q(name):
    return E.queries()[name]


def test_linear_regression_quality(spark):
    r = q("train_linear_regressor")(spark, SF_MID).first()
    assert r.r2 > 0.8 and r.n_scored == r.n_in


def test_log_target_forest_quality(spark):
    r = q("train_log_target_regressor")(spark, SF_SMALL).first()
    assert r.r2 > 0.8


@pytest.mark.parametrize("name", ["logistic_regression", "linear_svc", "gbt"])
def test_classifier_quality(spark, name):
    r = q(f"train_{name}_classifier")(spark, SF_SMALL).first()
    assert r.auc > 0.85 and r.accuracy > 0.8
    assert abs(r.weighted_recall - r.accuracy) < 1e-12


def test_tree_bound_and_what_if(spark):
    assert q("tree_bound")(spark, SF_SMALL).first().bounded
    w = q("what_if")(spark, SF_SMALL).first()
    assert w.prediction > 0


def test_importance_is_folded_and_normalised(spark):
    rows = q("importance_folded")(spark, SF_SMALL).collect()
    names = {r.feature for r in rows}
    assert names <= {"workclass", "occupation", "sex", "age", "education_num", "hours_per_week"}
    assert abs(sum(r.importance for r in rows) - 1.0) < 1e-6


def test_run_log_round_trip(spark):
    r = q("run_log")(spark, SF_SMALL).first().asDict()
    assert r["param_model"] == "RandomForestClassifier" and r["param_numTrees"] == "10"
    assert float(r["metric_n_in"]) > float(r["metric_n_scored"]) > 0
    assert float(r["metric_auc"]) > 0.8
    assert r["artifact_model"] and r["artifact_importance"]


def test_failed_model_save_is_recorded_with_warn_policy(spark, monkeypatch):
    """K5: on_error='warn' records the failure in the run log instead of raising."""
    from pyspark.ml import Pipeline

    from tessera.operators import models
    from tessera.plans import experiments
    from tessera.plans.training import gems_parts, gems_stages
    from tessera.session import scratch_path

    def boom(model, uri):
        raise OSError("disk full")

    monkeypatch.setattr(experiments, "save_model", boom)
    p = gems_parts(spark, SF_SMALL)
    pipe = Pipeline(stages=[*gems_stages(), models.regressor("linear")])
    path = scratch_path(spark, "runs-k5")
    with pytest.raises(OSError):
        experiments.tracked_run(spark, pipe, p["train"], p["test"], {"m": "lr"}, path, "regression", "price")
    # Both the model and the importance table fail: the run goes on and says so.
    run = experiments.tracked_run(spark, pipe, p["train"], p["test"], {"m": "lr"}, path, "regression", "price",
                                  importance_names=["too", "few"], on_error="warn")
    runs = experiments.read_runs(spark, experiments.log_path(path))
    row = experiments.compare_runs(runs, ["m"], ["r2"], ["model_error", "importance_error"]).filter(
        f"run_id = '{run}'").first()
    assert "disk full" in row["artifact_model_error"] and "importances" in row["artifact_importance_error"]
    assert float(row["metric_r2"]) > 0.5


def test_run_log_collects_runs_of_several_sessions(spark, tmp_path):
    from tessera.plans import experiments

    path = str(tmp_path / "runs")
    experiments.log_run(spark, path, "a", {"d": 1}, {"auc": 0.5}, {})
    other = spark.newSession()
    experiments.log_run(other, path, "b", {"d": 2}, {"auc": 0.75}, {})
    rows = experiments.compare_runs(experiments.read_runs(other, path), ["d"], ["auc"], order_metric="auc").collect()
    assert [(r.run_id, r.param_d) for r in rows] == [("b", "2"), ("a", "1")]


def test_cross_validation_does_not_depend_on_partitioning(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator

    from tessera.operators import models
    from tessera.plans.training import gems_parts, gems_stages

    train = gems_parts(spark, SF_SMALL)["train"]
    lr = models.regressor("linear")
    cv = models.cross_validator(Pipeline(stages=[*gems_stages(), lr]), {lr.regParam: [0.0, 0.1]},
                                RegressionEvaluator(labelCol="price", metricName="rmse"), task="regression")
    scores = [cv.fit(models.with_folds(train.repartition(n), "id")).avgMetrics for n in (3, 7)]
    assert scores[0] == pytest.approx(scores[1], rel=1e-9)


@pytest.mark.parametrize("name,least", [("random_forest", 0.85), ("factorization_machine", 0.6)])
def test_heavy_classifier_quality(spark, name, least):
    r = q(f"train_{name}_classifier")(spark, SF_SMALL).first()
    assert r.auc > least and r.n_in > r.n_scored > 0


@pytest.mark.parametrize("name", ["random_forest", "gbt"])
def test_tree_regressor_quality(spark, name):
    r = q(f"train_{name}_regressor")(spark, SF_SMALL).first()
    assert r.r2 > 0.85


def test_cross_validation_and_final_test(spark):
    rows = q("cross_validation")(spark, SF_SMALL).collect()
    assert len(rows) == 3 and rows[0].avg_rmse <= rows[-1].avg_rmse
    assert q("final_test")(spark, SF_SMALL).first().auc > 0.85


def test_leaderboard_ranks_all_models_by_auc(spark):
    rows = q("leaderboard")(spark, SF_SMALL).collect()
    assert [r.model for r in rows] and len(rows) == 5
    assert {r.model for r in rows} == {"logistic_regression", "random_forest", "gbt", "linear_svc",
                                       "factorization_machine"}
    aucs = [r.auc for r in rows]
    assert aucs == sorted(aucs, reverse=True)
    assert all(r.n_scored == rows[0].n_scored > 0 for r in rows)


def test_compare_imputers_keeps_more_rows_than_dropping(spark):
    rows = {r.strategy: r for r in q("compare_imputers")(spark, SF_SMALL).collect()}
    assert set(rows) == {"drop_missing", "mean_mode", "grouped_mode"}
    assert rows["mean_mode"].n_scored > rows["drop_missing"].n_scored
    assert rows["grouped_mode"].n_scored == rows["mean_mode"].n_scored
    assert all(r.auc > 0.8 for r in rows.values())
