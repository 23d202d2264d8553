"""Model queries (M1-M15, V6, C12, K1-K5): train on the fixtures with the
reference's settings and return report tables. Model output is not
SQL-expressible, so these carry no oracle; tests hold quality gates and
invariants for them instead.
"""

from __future__ import annotations

import datetime

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import clean, evaluate, features, impute, interpret, models, split
from tessera.plans import experiments, fixtures
from tessera.plans.catalog import query
from tessera.plans.common import (
    ADULT_COLUMNS,
    ADULT_STRINGS,
    adults_clean,
    adults_complete,
    gems_valid,
    sql,
    table,
)
from tessera.session import scratch_path
from tessera.sources import files
from tessera.sources.models import load_pipeline, save_model

CAT = fixtures.ADULTS_CATEGORICAL
NUM = fixtures.ADULTS_NUMERIC


#: Partitions that a training input may have on a cluster of fewer cores.
LEAST_PARTITIONS = 8


def training_partitions(spark: SparkSession) -> int:
    """Partitions of a training input: the session's number for shuffled data, but not more than the
    cores. A tree model's pass makes statistics of every open node in every partition and
    shuffles them, so its cost is nodes times partitions: a number that grows with the input would
    make it grow twice, and more partitions than cores add nothing to an even deal."""
    cores = spark.sparkContext.defaultParallelism
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(cores, LEAST_PARTITIONS))


def even_partitions(spark: SparkSession) -> int:
    """``training_partitions`` in whole rounds of the cores: 8 tasks on 6 cores leave 4 of them idle in the
    second round of every pass, once no other model fills them."""
    cores = spark.sparkContext.defaultParallelism
    rounds = max(1, round(LEAST_PARTITIONS / cores))
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), rounds * cores)


# Census flow (N1): clean -> 60/20/20 -> drop missing -> one-hot + scaled ----------
def census_parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    parts = split.hash_split(adults_clean(spark, sf_dir), "id", split.TRAIN_VAL_TEST)
    return {k: clean.drop_missing(v) for k, v in parts.items()}


def census_rows(spark: SparkSession, sf_dir: str, part: str) -> int:
    """Rows of a part before incomplete ones are dropped."""
    return split.hash_split(adults_clean(spark, sf_dir), "id", split.TRAIN_VAL_TEST)[part].count()


def census_prep() -> Pipeline:
    return features.one_hot_scaled(CAT, NUM)


def _classifier_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = census_parts(spark, sf_dir)
        pipe = Pipeline(stages=[*census_prep().getStages(), models.classifier(name)])
        _, rep = experiments.fit_and_report(pipe, p["train"], p["val"], "classification", "label",
                                            census_rows(spark, sf_dir, "val"), training_partitions(spark))
        return rep.select(F.lit(name).alias("model"), "*")

    run.__doc__ = f"M1-M5 M9: {name} on the census fixture, report on the validation part."
    return run


for _name in models.CLASSIFIERS:
    query(f"train_{_name}_classifier")(_classifier_query(_name))


#: Classifiers that take most of the time, on any rows: fitted first.
LONGEST = ("random_forest", "gbt", "factorization_machine")


@query("leaderboard")
def q_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five classifiers on the same prepared split, best AUC first."""
    p = census_parts(spark, sf_dir)
    names = sorted(models.CLASSIFIERS, key=lambda n: n not in LONGEST)
    ests = {n: models.classifier(n) for n in names}
    return experiments.compare_models(spark, p["train"], p["val"], census_prep(), ests, "classification", "label",
                                      n_in=census_rows(spark, sf_dir, "val"), partitions=even_partitions(spark),
                                      parallelism=3, reads=["features", "label"])


@query("final_test")
def q_final_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 (last step): the chosen model (random forest) scored once on the test part."""
    p = census_parts(spark, sf_dir)
    pipe = Pipeline(stages=[*census_prep().getStages(), models.classifier("random_forest")])
    _, rep = experiments.fit_and_report(pipe, p["train"], p["test"], "classification", "label",
                                        census_rows(spark, sf_dir, "test"), training_partitions(spark))
    return rep.select(F.lit("random_forest").alias("model"), "*")


@query("importance_folded")
def q_importance_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest importances named from the vector metadata,
    folded to source columns, largest first."""
    p = census_parts(spark, sf_dir)
    prep = experiments.fit(census_prep(), p["train"])
    features.check_levels(prep)
    tr = prep.transform(p["train"])
    rf = experiments.fit(Pipeline(stages=[models.classifier("random_forest")]), tr, training_partitions(spark)).stages[-1]
    names = interpret.feature_names(tr, "features")
    imp = interpret.importance(spark, rf, names, interpret.feature_sources(prep))
    return interpret.fold_importance(imp)


@query("compare_imputers")
def q_compare_imputers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop rows vs mean/mode vs grouped mode, same features and logistic regression."""
    parts = split.hash_split(adults_clean(spark, sf_dir), "id", split.TRAIN_VAL_TEST)
    strategies = {
        "drop_missing": Pipeline(stages=[clean.DropMissing()]),
        "mean_mode": impute.mean_mode_imputer(["age", "education_num", "hours_per_week"], ADULT_STRINGS),
        "grouped_mode": Pipeline(stages=[
            *impute.predictive_grouping(["workclass", "occupation"], ["education_num", "sex"],
                                        ADULT_STRINGS).getStages(),
            *impute.mean_mode_imputer(["age", "education_num", "hours_per_week"], []).getStages(),
        ]),
    }
    return experiments.compare_imputers(spark, parts["train"], parts["val"], strategies, census_prep(),
                                        models.classifier("logistic_regression"), partitions=training_partitions(spark))


RUN_PARAMS = ["maxDepth", "numTrees", "maxBins", "seed"]


@query("run_log")
def q_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracked forest run (indexed features, depth 10, 10
    trees), model saved, params/metrics/artifacts appended to the run log,
    then the run read back as one pivoted row."""
    whole = split.hash_split(adults_clean(spark, sf_dir), "id", split.TRAIN_TEST_80)
    parts = {k: clean.drop_missing(v) for k, v in whole.items()}
    prep = experiments.fit(features.indexed(CAT, NUM), parts["train"])
    rf = models.classifier("random_forest", **models.TRACKED_RF)
    # Trees on indexed categories need maxBins >= the largest category count (T-21).
    rf = models.with_min_bins(rf, max(features.category_counts(prep).values()))
    pipe = Pipeline(stages=[*prep.stages, rf])
    params = {"model": type(rf).__name__, **experiments.estimator_params(rf, RUN_PARAMS)}
    path = scratch_path(spark, "runs")  # a test run's log: a user names a durable folder
    run_id = experiments.tracked_run(spark, pipe, parts["train"], parts["test"], params, path, "classification",
                                     "label", importance_names=CAT + NUM, n_in=whole["test"].count(),
                                     partitions=training_partitions(spark))
    runs = experiments.read_runs(spark, experiments.log_path(path)).filter(F.col("run_id") == run_id)
    return experiments.compare_runs(runs, ["model", *RUN_PARAMS], ["auc", "accuracy", "f1", "n_in", "n_scored"],
                                    ["model", "importance"], "auc")


# Diamonds flow (N2): valid rows -> drop redundant sizes -> 75/25 -> ordinal + assemble ------
def gems_parts(spark: SparkSession, sf_dir: str, weights=split.TRAIN_TEST_75) -> dict[str, DataFrame]:
    good, _ = clean.split_valid(fixtures.gems(spark, sf_dir), clean.valid_rule(["x", "y", "z"]))
    return split.hash_split(good.drop("x", "y", "z"), "id", weights)


def gems_stages() -> list:
    return [features.ordinal_encoder(fixtures.GEMS_ORDINAL_LEVELS), features.assembler(fixtures.GEMS_FEATURES)]


def _regressor_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = gems_parts(spark, sf_dir)
        pipe = Pipeline(stages=[*gems_stages(), models.regressor(name)])
        _, rep = experiments.fit_and_report(pipe, p["train"], p["test"], "regression", "price",
                                            partitions=training_partitions(spark))
        return rep.select(F.lit(name).alias("model"), "*")

    run.__doc__ = f"M6-M9: {name} regressor on the gems fixture, report on the test part."
    return run


for _name in models.REGRESSORS:
    query(f"train_{_name}_regressor")(_regressor_query(_name))


@query("train_log_target_regressor")
def q_log_target_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest on ln(price), predictions back in price units;
    same split as the other regressors (T-15)."""
    p = gems_parts(spark, sf_dir)
    pipe = features.log_target(gems_stages(), models.regressor("random_forest"), "price")
    _, rep = experiments.fit_and_report(pipe, p["train"], p["test"], "regression", "price",
                                        partitions=training_partitions(spark))
    return rep.select(F.lit("random_forest_log").alias("model"), "*")


# The what-if row, with the fixture's top levels.
WHAT_IF_ROW = (3.0, "1-URGENT", "MACHINERY", "P", 62.0, 55.0)


@query("what_if")
def q_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score a literal row with the forest fitted on the training part."""
    p = gems_parts(spark, sf_dir)
    model = experiments.fit(Pipeline(stages=[*gems_stages(), models.regressor("random_forest")]), p["train"],
                            training_partitions(spark))
    row = files.literal_rows(spark, [WHAT_IF_ROW],
                             "carat double, cut string, color string, clarity string, depth double, tbl double")
    return model.transform(row).select("carat", "cut", "color", "clarity", "prediction")


@query("tree_bound")
def q_tree_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: forest predictions never exceed the largest training price."""
    p = gems_parts(spark, sf_dir)
    n = training_partitions(spark)
    model = experiments.fit(Pipeline(stages=[*gems_stages(), models.regressor("random_forest")]), p["train"], n)
    return evaluate.tree_bound(model.transform(experiments.spread(p["test"], n)), p["train"], "price")


@query("cross_validation")
def q_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-fold cross-validation of linear regression over a regParam grid."""
    p = gems_parts(spark, sf_dir)
    lr = models.regressor("linear")
    pipe = Pipeline(stages=[*gems_stages(), lr])
    from pyspark.ml.evaluation import RegressionEvaluator

    grid = {lr.regParam: [0.0, 0.1, 1.0]}
    cv = models.cross_validator(pipe, grid, RegressionEvaluator(labelCol="price", metricName="rmse"), folds=3,
                                task="regression")
    folded = experiments.spread(models.with_folds(p["train"], "id"), training_partitions(spark)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cvm = cv.fit(folded)
    finally:
        folded.unpersist()
    rows = [(float(g[lr.regParam]), float(m)) for g, m in zip(cvm.getEstimatorParamMaps(), cvm.avgMetrics)]
    return files.literal_rows(spark, rows, "reg_param double, avg_rmse double").orderBy("avg_rmse")


@query("linreg_single", sql(
    "SELECT round(regr_slope(price, carat), 4) AS slope, round(regr_intercept(price, carat), 4) AS intercept, "
    "round(regr_r2(price, carat), 6) AS r2 FROM gems_valid"))
def q_linreg_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: one-feature linear regression of price on carat (exact OLS: normal equations)."""
    df = gems_valid(spark, sf_dir)
    asm = features.assembler(["carat"], "features")
    lr = models.regressor("linear", features="features", label="price")
    m = lr.fit(asm.transform(df))
    row = [(round(float(m.coefficients[0]), 4), round(float(m.intercept), 4), round(float(m.summary.r2), 6))]
    return files.literal_rows(spark, row, "slope double, intercept double, r2 double")


# Exact forms of model operators: what SQL can say as well ----------------------------------
@query("log_target_fit", sql(
    "SELECT id, carat, round(exp(a + b * carat), 4) AS prediction FROM gems_valid, f",
    ("f", "SELECT regr_intercept(ln(price), carat) AS a, regr_slope(ln(price), carat) AS b FROM gems_valid "
          "WHERE price > 0")))
def q_log_target_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear regression on ln(price), scored on rows that have no price."""
    df = gems_valid(spark, sf_dir).select("id", "carat", "price")
    est = features.log_target([features.assembler(["carat"])], models.regressor("linear"), "price")
    out = est.fit(df).transform(df.drop("price"))
    return out.select("id", "carat", F.round("prediction", 4).alias("prediction"))


@query("score_linear", sql(
    "SELECT id, round(a + b * carat, 4) AS prediction FROM gems_valid, f "
    "UNION ALL SELECT -1, round(a + b * 2.5, 4) FROM f",
    ("f", "SELECT regr_intercept(price, carat) AS a, regr_slope(price, carat) AS b FROM gems_valid")))
def q_score_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-feature model, saved and loaded, applied to every row and to a literal
    row that also holds a date."""
    df = gems_valid(spark, sf_dir).select("id", "carat", "price")
    fitted = Pipeline(stages=[features.assembler(["carat"]), models.regressor("linear")]).fit(df)
    model = load_pipeline(save_model(fitted, scratch_path(spark, "linear-model")))
    row = files.literal_rows(spark, [(-1, 2.5, datetime.date(2020, 1, 2))], "id bigint, carat double, day date")
    both = df.select("id", "carat").unionByName(row.select("id", "carat"))
    return model.transform(both).select("id", F.round("prediction", 4).alias("prediction"))


@query("indexed_features", sql(
    "SELECT id, w.idx AS f_workclass, s.idx AS f_sex, CAST(age AS DOUBLE) AS f_age FROM adults_complete c "
    "JOIN w ON c.workclass = w.v JOIN s ON c.sex = s.v",
    *[(n, f"SELECT v, CAST(row_number() OVER (ORDER BY n DESC, v) - 1 AS DOUBLE) AS idx FROM "
          f"(SELECT {c} AS v, count(*) AS n FROM adults_complete GROUP BY {c})")
      for n, c in (("w", "workclass"), ("s", "sex"))]))
def q_indexed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category indexes and a raw numeric in one vector, flattened."""
    df = adults_complete(spark, sf_dir)
    out = features.indexed(["workclass", "sex"], ["age"]).fit(df).transform(df)
    return features.flatten_vector(out, "features", ["f_workclass", "f_sex", "f_age"], keep=["id"])


@query("importance_fold", "SELECT p_brand AS feature, sum(CAST(p_size AS DOUBLE)) AS importance FROM part "
                          "GROUP BY p_brand")
def q_importance_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over the slots of a source, largest first, ties by name (sizes of parts
    stand for the importances)."""
    part = table(spark, sf_dir, "part")
    slots = part.select(F.col("p_name").alias("feature"), F.col("p_brand").alias("source"),
                        F.col("p_size").cast("double").alias("importance"))
    return interpret.fold_importance(slots)


_RUNS = [("r1", {"depth": 5}, {"auc": 0.75}), ("r2", {"depth": 10}, {"auc": 0.875, "f1": 0.5})]


@query("run_compare", "SELECT 'r2' AS run_id, '10' AS param_depth, '0.875' AS metric_auc, '0.5' AS metric_f1, "
                      "count(*) AS n_orders FROM orders UNION ALL "
                      "SELECT 'r1', '5', '0.75', NULL, count(*) FROM orders")
def q_run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1-K4 O3: two runs appended to a log one after another, read back and pivoted, best first; each
    logs the number of orders it was made from."""
    n = table(spark, sf_dir, "orders").count()
    path = scratch_path(spark, "runs")
    for run_id, params, metrics in _RUNS:
        experiments.log_run(spark, path, run_id, params, {**metrics, "n_orders": n}, {})
    wide = experiments.compare_runs(experiments.read_runs(spark, path), ["depth"], ["auc", "f1", "n_orders"],
                                    order_metric="auc")
    return wide.select("run_id", "param_depth", "metric_auc", "metric_f1",
                       F.col("metric_n_orders").cast("double").cast("bigint").alias("n_orders"))


_VAL = "((('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8))::BIGINT))"


@query("row_accounting", sql(
    f"SELECT model, count(*) AS n_in, count(*) FILTER (WHERE {' AND '.join(c + ' IS NOT NULL' for c in ADULT_COLUMNS)} "
    "AND NOT coalesce(isnan(education_num), false) AND NOT coalesce(isnan(hours_per_week), false)) AS n_scored "
    "FROM adults_clean, (VALUES ('logistic_regression'), ('linear_svc')) t(model) "
    f"WHERE {_VAL} >= {split.cuts(split.TRAIN_VAL_TEST)[1][1]} AND {_VAL} < {split.cuts(split.TRAIN_VAL_TEST)[1][2]} "
    "GROUP BY model"))
def q_row_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 T-3: two models compared on the validation part; rows before any was dropped, and rows scored."""
    p = census_parts(spark, sf_dir)
    ests = {n: models.classifier(n, maxIter=1) for n in ("logistic_regression", "linear_svc")}
    board = experiments.compare_models(spark, p["train"], p["val"], census_prep(), ests, "classification", "label",
                                       n_in=census_rows(spark, sf_dir, "val"))
    return board.select("model", "n_in", "n_scored")


@query("imputer_accounting", sql(
    f"SELECT strategy, count(*) AS n_in, CASE WHEN strategy = 'drop_missing' THEN count(*) FILTER (WHERE "
    f"{' AND '.join(c + ' IS NOT NULL' for c in ADULT_COLUMNS)} AND NOT coalesce(isnan(education_num), false) "
    "AND NOT coalesce(isnan(hours_per_week), false)) ELSE count(*) END AS n_scored "
    "FROM adults_clean, (VALUES ('drop_missing'), ('mean_mode')) t(strategy) "
    f"WHERE {_VAL} >= {split.cuts(split.TRAIN_VAL_TEST)[1][1]} AND {_VAL} < {split.cuts(split.TRAIN_VAL_TEST)[1][2]} "
    "GROUP BY strategy"))
def q_imputer_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12 T-3: strategies that drop rows and that fill them, with rows in and rows scored."""
    parts = split.hash_split(adults_clean(spark, sf_dir), "id", split.TRAIN_VAL_TEST)
    strategies = {"drop_missing": Pipeline(stages=[clean.DropMissing()]),
                  "mean_mode": impute.mean_mode_imputer(NUM, ADULT_STRINGS)}
    out = experiments.compare_imputers(spark, parts["train"], parts["val"], strategies, census_prep(),
                                       models.classifier("logistic_regression", maxIter=1))
    return out.select("strategy", "n_in", "n_scored")


@query("tree_bound_literal", sql(
    "SELECT max(carat * 100) AS max_prediction, max(price) AS max_train_label, "
    "max(carat * 100) <= max(price) + 1e-9 AS bounded FROM gems_valid"))
def q_tree_bound_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: the bound check itself, on predictions that SQL can say (100 a carat)."""
    df = gems_valid(spark, sf_dir)
    pred = df.withColumn("prediction", F.col("carat") * 100)
    return evaluate.tree_bound(pred, df, "price")
