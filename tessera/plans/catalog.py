"""Query catalog: one named query per operator group of the inventory.

Each query is ``(spark, sf_dir) -> DataFrame`` and reads the driver tables (or
fixtures Spark derives from them) in full. Deterministic queries carry the
equivalent DuckDB SQL next to them; the two must agree on row count, column
names and values (doubles are rounded the same way on both sides where the
summation order can differ).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import md5_bucket
from tessera.operators import clean, evaluate, features, impute, profile, split
from tessera.plans import fixtures
from tessera.plans.common import (
    ADULT_STRINGS,
    adults_clean,
    adults_complete,
    gems_valid,
    sql,
    sql_bucket,
    sql_place,
    table,
)
from tessera.session import scratch_path
from tessera.sources import files

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def _r(c, d: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, d)


# ---------------------------------------------------------------------------
# Sources (S1-S7)
# ---------------------------------------------------------------------------
_CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
_CUSTOMER_NAMES = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_CUSTOMER_POSITIONAL = T.StructType([
    T.StructField("_c0", T.LongType()), T.StructField("_c1", T.StringType()), T.StructField("_c2", T.IntegerType()),
    T.StructField("_c3", T.DoubleType()), T.StructField("_c4", T.StringType()),
])


@query("csv_scan", _CUSTOMER_SQL)
def q_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headerless CSV whose fields carry a leading blank (the
    census layout), read with an explicit schema and named by position."""
    cust = table(spark, sf_dir, "customer").select(*_CUSTOMER_NAMES)
    padded = cust.select(*[F.concat(F.lit(" "), F.col(c).cast("string")).alias(c) for c in _CUSTOMER_NAMES])
    path = files.write_csv(padded, scratch_path(spark, "csv-headerless"), header=False)
    raw = files.read_csv(spark, path, schema=_CUSTOMER_POSITIONAL, header=False, strip_leading_space=True)
    return files.name_columns(raw, _CUSTOMER_NAMES)


@query("csv_scan_header", _CUSTOMER_SQL)
def q_csv_scan_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with a header line; names come from the file, types are inferred."""
    cust = table(spark, sf_dir, "customer").select(*_CUSTOMER_NAMES)
    path = files.write_csv(cust, scratch_path(spark, "csv-header"), header=True)
    df = files.read_csv(spark, path, header=True, infer=True)
    return df.select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name",
        F.col("c_nationkey").cast("int").alias("c_nationkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"),
        "c_mktsegment",
    )


@query("preview", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders "
                  "ORDER BY o_orderkey LIMIT 20")
def q_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded preview of a table (first rows in key order; the limit is the feature)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return files.preview(orders.orderBy("o_orderkey"), 20)


# ---------------------------------------------------------------------------
# Projections, filters, scalar functions
# ---------------------------------------------------------------------------
@query(
    "select_rename_drop",
    "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment AS segment, round(c_acctbal / 1000, 3) AS acctbal_k, "
    "'customer' AS source FROM customer WHERE c_acctbal IS NOT NULL",
)
def q_select_rename_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    df = df.filter(F.col("c_acctbal").isNotNull()).select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                                          "c_mktsegment")
    df = df.withColumns({"acctbal_k": F.round(F.col("c_acctbal") / 1000, 3), "source": F.lit("customer")})
    return df.withColumnRenamed("c_mktsegment", "segment").drop("c_name")


@query("trim_label", sql("SELECT * FROM adults_clean"))
def q_trim_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trim every string, label from ``income == '>50K'``."""
    df = clean.trim_strings(fixtures.adults(spark, sf_dir))
    df = clean.sentinel_to_null(df, ADULT_STRINGS + ["income"])
    return clean.binary_label(df, "income", ">50K")


@query(
    "label_contains",
    sql("SELECT id, income, CASE WHEN income IS NULL THEN NULL WHEN contains(income, '>50K') THEN 1 ELSE 0 END "
        "AS label FROM adults"),
)
def q_label_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring form of the label; the source column is kept."""
    df = fixtures.adults(spark, sf_dir).select("id", "income")
    return clean.binary_label(df, "income", ">50K", how="contains", drop_source=False)


@query(
    "sentinel_null",
    sql("SELECT id, age, "
        + ", ".join(f"CASE WHEN trim({c}) IN ('?', '') THEN NULL ELSE {c} END AS {c}"
                    for c in ["workclass", "occupation", "sex", "income"])
        + ", education_num, hours_per_week FROM adults"),
)
def q_sentinel_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentinel texts -> NULL; kept values are left untrimmed."""
    return clean.sentinel_to_null(fixtures.adults(spark, sf_dir))


@query("drop_missing", sql("SELECT * FROM adults_complete"))
def q_drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: rows with any NULL/NaN cell removed."""
    return adults_complete(spark, sf_dir)


# ---------------------------------------------------------------------------
# Profiling
# ---------------------------------------------------------------------------
_ADULT_RAW = ["id", "age", "workclass", "occupation", "sex", "education_num", "hours_per_week", "income"]


def _missing_sql_cond(c: str) -> str:
    if c in ("workclass", "occupation", "sex", "income"):
        return f"{c} IS NULL OR trim({c}) IN ('?', '')"
    if c in ("education_num", "hours_per_week"):
        return f"{c} IS NULL OR isnan({c})"
    return f"{c} IS NULL"


_MISSING_SQL = sql(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", m{i} AS n_missing, 100.0::DOUBLE * m{i} / n AS pct FROM t"
        for i, c in enumerate(_ADULT_RAW)
    ) + ")",
    ("t", "SELECT count(*) AS n, " + ", ".join(
        f"count(*) FILTER (WHERE {_missing_sql_cond(c)}) AS m{i}" for i, c in enumerate(_ADULT_RAW)
    ) + " FROM adults"),
)


@query("missing_profile", _MISSING_SQL)
def q_missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells per column in one pass."""
    return profile.missing_profile(fixtures.adults(spark, sf_dir), _ADULT_RAW)


@query(
    "null_counts",
    sql("SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in _ADULT_RAW) + " FROM adults"),
)
def q_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: ``count(when(isNull))`` for every column, one row."""
    return profile.null_counts(fixtures.adults(spark, sf_dir), _ADULT_RAW)


_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SUMMARY_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS stddev, "
    f"min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM lineitem"
    for c in _LI_NUM
)


@query("summary_exact", _SUMMARY_SQL)
def q_summary_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 (exact form): count, mean, stddev, min, quartiles, max per column."""
    s = profile.summary_exact(table(spark, sf_dir, "lineitem"), _LI_NUM)
    return s.select("column", "n", _r("mean").alias("mean"), _r("stddev").alias("stddev"), "min",
                    _r("p25").alias("p25"), _r("p50").alias("p50"), _r("p75").alias("p75"), "max")


_SMALL = ["l_extendedprice", "l_quantity", "nothing"]
_SMALL_SQL = "WITH t AS (SELECT l_extendedprice * 1e-7 AS l_extendedprice, CASE WHEN l_linenumber = 3 THEN 'NaN'::DOUBLE " \
    "ELSE l_quantity * 1e-7 END AS l_quantity, CAST(NULL AS DOUBLE) AS nothing FROM lineitem), " \
    "u AS (SELECT l_extendedprice, CASE WHEN NOT isnan(l_quantity) THEN l_quantity END AS l_quantity, nothing FROM t) " + \
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 12) AS mean, round(stddev_samp({c}), 12) AS stddev, "
        f"round(min({c}), 12) AS min, round(quantile_cont({c}, 0.25), 12) AS p25, round(quantile_cont({c}, 0.5), 12) AS p50, "
        f"round(quantile_cont({c}, 0.75), 12) AS p75, round(max({c}), 12) AS max FROM u" for c in _SMALL)


@query("summary_small_values", _SMALL_SQL)
def q_summary_small_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 T-11: values of the size 1e-7, NaN cells, and a column without any value."""
    li = table(spark, sf_dir, "lineitem")
    nan = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_quantity") * 1e-7)
    t = li.select((F.col("l_extendedprice") * 1e-7).alias("l_extendedprice"), nan.alias("l_quantity"),
                  F.lit(None).cast("double").alias("nothing"))
    out = profile.summary_exact(t, _SMALL)
    return out.select("column", "n", *[_r(c, 12).alias(c) for c in out.columns[2:]])


@query("summary_approx")
def q_summary_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 (reference form): Spark's ``summary()`` with approximate percentiles."""
    return profile.summary_approx(table(spark, sf_dir, "lineitem").select(*_LI_NUM))


_CORR_SQL = sql(" UNION ALL ".join(
    f"SELECT 'carat' AS col_a, '{c}' AS col_b, round(corr(carat, {c}), 6) AS corr, "
    f"abs(corr(carat, {c})) > 0.95 AS dropped FROM gems_valid" for c in ["x", "y", "z"]
))


@query("corr_pairs", _CORR_SQL)
def q_corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation of carat with each size, one pass; flag for dropping."""
    c = profile.correlations(gems_valid(spark, sf_dir), "carat", ["x", "y", "z"])
    return c.select("col_a", "col_b", _r("corr").alias("corr"), (F.abs("corr") > 0.95).alias("dropped"))


@query("corr_with_nulls", sql(" UNION ALL ".join(
    f"SELECT 'hours_per_week' AS col_a, '{c}' AS col_b, round(corr(hours_per_week, {c}), 6) AS corr FROM adults"
    for c in ["age", "education_num"])))
def q_corr_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation over the rows where both columns have a value."""
    c = profile.correlations(fixtures.adults(spark, sf_dir), "hours_per_week", ["age", "education_num"])
    return c.select("col_a", "col_b", _r("corr").alias("corr"))


@query("corr_drop", sql("SELECT * EXCLUDE (x, y, z) FROM gems_valid"))
def q_corr_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the table without the columns that say the same as carat (|corr| over 0.95)."""
    return profile.drop_correlated(gems_valid(spark, sf_dir), "carat", ["x", "y", "z"], 0.95)[0]


@query("missing_total", sql("SELECT count(*) FILTER (WHERE hours_per_week IS NULL) + count(*) FILTER (WHERE sex IS NULL)"
                            " + count(*) FILTER (WHERE workclass IS NULL) + count(*) FILTER (WHERE occupation IS NULL) "
                            "AS n_missing, CAST((SELECT count(*) FROM adults_complete) AS BIGINT) AS n_complete, "
                            "count(*) AS n_rows FROM adults_clean"))
def q_missing_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing cells of the whole table, and the rows that a verified drop keeps."""
    df = adults_clean(spark, sf_dir)
    n = profile.total_missing(df, ["hours_per_week", *ADULT_STRINGS])
    _, counts = clean.drop_missing_verified(df)
    return files.literal_rows(spark, [(n, counts["n_out"], counts["n_in"])],
                              "n_missing bigint, n_complete bigint, n_rows bigint")


@query("missing_examples", sql("SELECT id, age, occupation FROM adults_clean WHERE occupation IS NULL "
                               "ORDER BY id LIMIT 5"))
def q_missing_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows by key where a column is missing (a report of five)."""
    return profile.missing_examples(adults_clean(spark, sf_dir), "occupation", "id").select("id", "age", "occupation")


_FD_SQL = (
    "WITH pairs AS (SELECT DISTINCT c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey), "
    "a AS (SELECT c_nationkey, count(*) AS k FROM pairs GROUP BY c_nationkey), "
    "b AS (SELECT n_name, count(*) AS k FROM pairs GROUP BY n_name) "
    "SELECT CAST((SELECT sum(k) FROM a) AS BIGINT) AS n_pairs, CAST((SELECT max(k) FROM a) AS BIGINT) AS max_b_per_a, "
    "CAST((SELECT max(k) FROM b) AS BIGINT) AS max_a_per_b, (SELECT max(k) FROM a) <= 1 AS a_determines_b, "
    "(SELECT max(k) FROM b) <= 1 AS b_determines_a"
)


@query("functional_dep", _FD_SQL)
def q_functional_dep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the code determine the name and back (education / education_num check)?"""
    cust = table(spark, sf_dir, "customer").select("c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return profile.functional_dependency(joined, "c_nationkey", "n_name")


@query(
    "class_distribution",
    sql("SELECT label, count(*) AS n, 100.0::DOUBLE * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS pct "
        "FROM adults_clean GROUP BY label"),
)
def q_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share per class."""
    return profile.class_distribution(adults_clean(spark, sf_dir), "label")


def _mode_sql(c: str, src: str) -> str:
    return (f"(SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {src} "
            f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, value LIMIT 1)")


@query("global_mode", sql("SELECT * FROM (" + " UNION ALL ".join(_mode_sql(c, "adults_clean")
                                                                  for c in ADULT_STRINGS) + ")"))
def q_global_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent non-NULL value per column, ties to the smallest value."""
    return profile.modes(adults_clean(spark, sf_dir), ADULT_STRINGS)


@query("distinct_sorted", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def q_distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 O1 O2: distinct pairs in key order."""
    return profile.distinct_values(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query(
    "group_count",
    "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def q_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 A3: rows per key combination."""
    return profile.group_count(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("top_categories",
       "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 5")
def q_top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent brands, ties by name (a top-k report)."""
    return profile.top_categories(table(spark, sf_dir, "part"), "p_brand", 5)


@query(
    "topk_mask",
    "SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part GROUP BY p_brand "
    "ORDER BY count(*) DESC, p_brand LIMIT 5) THEN p_brand ELSE 'Other' END AS p_brand FROM part",
)
def q_topk_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the five most frequent brands, everything else -> 'Other'."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return clean.TopKCategoryMask(inputCol="p_brand", k=5).fit(part).transform(part)


# ---------------------------------------------------------------------------
# Grouped mode, imputation
# ---------------------------------------------------------------------------
def _group_mode_sql(target: str, src: str) -> str:
    return (
        f"SELECT education_num, sex, {target} AS v FROM (SELECT education_num, sex, {target}, row_number() OVER "
        f"(PARTITION BY education_num, sex ORDER BY count(*) DESC, {target}) AS rn FROM {src} "
        f"WHERE {target} IS NOT NULL GROUP BY education_num, sex, {target}) WHERE rn = 1"
    )


_GROUPED_MODE_SQL = sql(
    "SELECT coalesce(wm.education_num, om.education_num) AS education_num, coalesce(wm.sex, om.sex) AS sex, "
    "wm.v AS workclass_mode, om.v AS occupation_mode FROM wm FULL OUTER JOIN om "
    "ON wm.education_num = om.education_num AND wm.sex = om.sex",
    ("wm", _group_mode_sql("workclass", "adults_clean")),
    ("om", _group_mode_sql("occupation", "adults_clean")),
)


@query("grouped_mode", _GROUPED_MODE_SQL)
def q_grouped_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 + top-1 per group as two hash aggregates (no sort)."""
    return impute.group_modes(adults_clean(spark, sf_dir), ["workclass", "occupation"], ["education_num", "sex"])


@query("grouped_mode_window", _GROUPED_MODE_SQL)
def q_grouped_mode_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's ``row_number() over (...)`` + ``rank = 1`` form."""
    return impute.group_modes(adults_clean(spark, sf_dir), ["workclass", "occupation"], ["education_num", "sex"],
                              method="window")


_TRAIN80 = f"{sql_bucket('id')} < 80"
_IMPUTE_GROUPED_SQL = sql(
    "SELECT c.id, c.age, "
    "coalesce(c.workclass, g.workclass_mode, (SELECT v FROM gw), 'Unknown') AS workclass, "
    "coalesce(c.occupation, g.occupation_mode, (SELECT v FROM go), 'Unknown') AS occupation, "
    "coalesce(c.sex, 'Unknown') AS sex, c.education_num, c.hours_per_week, c.label "
    "FROM adults_clean c LEFT JOIN g ON c.education_num = g.education_num AND c.sex = g.sex",
    ("train", f"SELECT * FROM adults_clean WHERE {_TRAIN80}"),
    ("wm", _group_mode_sql("workclass", "train")),
    ("om", _group_mode_sql("occupation", "train")),
    ("g", "SELECT coalesce(wm.education_num, om.education_num) AS education_num, coalesce(wm.sex, om.sex) AS sex, "
          "wm.v AS workclass_mode, om.v AS occupation_mode FROM wm FULL OUTER JOIN om "
          "ON wm.education_num = om.education_num AND wm.sex = om.sex"),
    ("gw", "SELECT workclass AS v FROM train WHERE workclass IS NOT NULL GROUP BY workclass "
           "ORDER BY count(*) DESC, workclass LIMIT 1"),
    ("go", "SELECT occupation AS v FROM train WHERE occupation IS NOT NULL GROUP BY occupation "
           "ORDER BY count(*) DESC, occupation LIMIT 1"),
)


@query("impute_grouped_mode", _IMPUTE_GROUPED_SQL)
def q_impute_grouped_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit group modes on the training part, fill every row
    (group mode, else global mode, else 'Unknown')."""
    df = adults_clean(spark, sf_dir)
    train = df.filter(md5_bucket("id") < 80)
    model = impute.predictive_grouping(["workclass", "occupation"], ["education_num", "sex"], ADULT_STRINGS).fit(train)
    return impute.fill_verified(model, df, ADULT_STRINGS)


_KEYED = ("SELECT o_orderkey, o_orderdate AS day, CASE WHEN o_custkey % 7 = 0 THEN 'NaN'::DOUBLE WHEN o_custkey % 7 = 1 "
          "THEN NULL ELSE CAST(o_custkey % 7 AS DOUBLE) END AS grp, CASE WHEN o_orderkey % 5 = 0 THEN NULL "
          "ELSE o_orderpriority END AS target FROM orders")


def _keyed_fill_sql(key: str) -> str:
    # NaN is equal to NaN and NULL to nothing, in both engines.
    return (f"coalesce(target, (SELECT v FROM m_{key} m WHERE m.k = t.{key}), (SELECT v FROM m_all))")


@query("impute_grouped_mode_keys", f"WITH t AS ({_KEYED}), " + ", ".join(
    f"m_{k} AS (SELECT k, v FROM (SELECT {k} AS k, target AS v, row_number() OVER (PARTITION BY {k} "
    f"ORDER BY count(*) DESC, target) AS rn FROM t WHERE target IS NOT NULL AND {k} IS NOT NULL GROUP BY {k}, target) "
    "WHERE rn = 1)" for k in ("day", "grp"))
    + ", m_all AS (SELECT target AS v FROM t WHERE target IS NOT NULL GROUP BY target ORDER BY count(*) DESC, target "
      f"LIMIT 1) SELECT o_orderkey, {_keyed_fill_sql('day')} AS by_day, {_keyed_fill_sql('grp')} AS by_grp FROM t")
def q_impute_grouped_mode_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by a date, and by a number that is sometimes NaN or NULL; one model saved and loaded."""
    orders = table(spark, sf_dir, "orders")
    r = F.col("o_custkey") % 7
    t = orders.select("o_orderkey", F.col("o_orderdate").alias("day"),
                      F.when(r == 0, F.lit(float("nan"))).when(r != 1, r.cast("double")).alias("grp"),
                      F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("target"))
    by_day = impute.GroupedModeImputer(targetCols=["target"], groupCols=["day"]).fit(t)
    path = scratch_path(spark, "day-modes")
    by_day.write().overwrite().save(path)
    by_day = impute.GroupedModeImputerModel.load(path)
    by_grp = impute.GroupedModeImputer(targetCols=["target"], groupCols=["grp"]).fit(t)
    day = by_day.transform(t).select("o_orderkey", F.col("target").alias("by_day"))
    grp = by_grp.transform(t).select("o_orderkey", F.col("target").alias("by_grp"))
    return day.join(grp, "o_orderkey")


_IMPUTE_MEAN_SQL = sql(
    "SELECT c.id, CAST(coalesce(CAST(c.age AS DOUBLE), (SELECT a FROM m)) AS DOUBLE) AS age, "
    "coalesce(c.workclass, (SELECT v FROM gw)) AS workclass, coalesce(c.occupation, (SELECT v FROM go)) AS occupation, "
    "coalesce(c.sex, (SELECT v FROM gs)) AS sex, "
    "round(coalesce(c.education_num, (SELECT e FROM m)), 6) AS education_num, "
    "round(coalesce(c.hours_per_week, (SELECT h FROM m)), 6) AS hours_per_week, c.label "
    "FROM adults_clean c",
    ("train", f"SELECT * FROM adults_clean WHERE {_TRAIN80}"),
    ("m", "SELECT avg(age) AS a, avg(education_num) AS e, avg(hours_per_week) AS h FROM train"),
    *[(n, f"SELECT {c} AS v FROM train WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1")
      for n, c in [("gw", "workclass"), ("go", "occupation"), ("gs", "sex")]],
)


@query("impute_mean_mode", _IMPUTE_MEAN_SQL)
def q_impute_mean_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric columns cast to double and mean-filled, strings mode-filled;
    statistics from the training part only."""
    df = adults_clean(spark, sf_dir)
    train = df.filter(md5_bucket("id") < 80)
    model = impute.mean_mode_imputer(["age", "education_num", "hours_per_week"], ADULT_STRINGS).fit(train)
    out = impute.fill_verified(model, df, ["age", "education_num", "hours_per_week", *ADULT_STRINGS])
    return out.select("id", "age", "workclass", "occupation", "sex", _r("education_num").alias("education_num"),
                      _r("hours_per_week").alias("hours_per_week"), "label")


# ---------------------------------------------------------------------------
# Validity split, encoding, splitting
# ---------------------------------------------------------------------------
_OK = "coalesce(x > 0 AND y > 0 AND z > 0, false)"


@query(
    "valid_split",
    sql(f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE {_OK}) AS n_good, "
        f"count(*) FILTER (WHERE NOT {_OK}) AS n_bad FROM gems"),
)
def q_valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """good/bad partition by the size rule, counted in one pass."""
    return clean.validity_counts(fixtures.gems(spark, sf_dir), clean.valid_rule(["x", "y", "z"]))


def _ordinal_sql() -> str:
    parts = []
    for c, levels in fixtures.GEMS_ORDINAL_LEVELS.items():
        whens = " ".join(f"WHEN {c} = '{v}' THEN {i + 1}" for i, v in enumerate(levels))
        parts.append(f"CASE {whens} ELSE 0 END AS {c}_score")
    return sql("SELECT id, cut, color, clarity, " + ", ".join(parts) + " FROM gems")


@query("ordinal_encode", _ordinal_sql())
def q_ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal scores from a ``SQLTransformer`` CASE ladder."""
    enc = features.ordinal_encoder(fixtures.GEMS_ORDINAL_LEVELS)
    out = enc.transform(fixtures.gems(spark, sf_dir))
    return out.select("id", "cut", "color", "clarity", "cut_score", "color_score", "clarity_score")


_CUTS = split.cuts(split.TRAIN_VAL_TEST)


@query(
    "hash_split",
    f"SELECT o_orderkey, CASE WHEN {sql_place('o_orderkey')} < {_CUTS[0][2]} THEN 'train' "
    f"WHEN {sql_place('o_orderkey')} < {_CUTS[1][2]} THEN 'val' ELSE 'test' END AS split FROM orders",
)
def q_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60/20/20 by md5 of the key (partitioning-independent)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return split.assign_split(orders, "o_orderkey", split.TRAIN_VAL_TEST)


_RARE = {"train": 0.996, "test": 0.004}
_RARE_KEY = "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey END"


@query(
    "split_null_keys",
    f"SELECT o_orderkey, CASE WHEN {sql_place(f'({_RARE_KEY})')} < {split.cuts(_RARE)[0][2]} THEN 'train' "
    "ELSE 'test' END AS part FROM orders",
)
def q_split_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small part and NULL keys; every row is in exactly one part."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_RARE_KEY).alias("key"))
    parts = split.hash_split(orders, "key", _RARE)
    rows = [df.select("o_orderkey", F.lit(name).alias("part")) for name, df in parts.items()]
    return rows[0].unionByName(rows[1])


# ---------------------------------------------------------------------------
# Feature stages
# ---------------------------------------------------------------------------
_INDEX_SQL = (
    "WITH f AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY o_orderpriority), "
    "r AS (SELECT v, CAST(row_number() OVER (ORDER BY n DESC, v) - 1 AS DOUBLE) AS idx FROM f) "
)


@query("string_index", _INDEX_SQL + "SELECT o_orderkey, o_orderpriority, idx AS o_orderpriority_index "
                                    "FROM orders JOIN r ON o_orderpriority = v")
def q_string_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency-ordered index, ties alphabetical."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return features.string_indexer(["o_orderpriority"], suffix="_index").fit(orders).transform(orders)


@query("one_hot", _INDEX_SQL + "SELECT o_orderkey, idx AS o_orderpriority_index, "
       + ", ".join(f"CASE WHEN idx = {j} THEN 1.0 ELSE 0.0 END::DOUBLE AS oh_{j}" for j in range(4))
       + " FROM orders JOIN r ON o_orderpriority = v")
def q_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot with the last category dropped (5 levels -> 4 columns)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    idx = features.string_indexer(["o_orderpriority"], suffix="_index", handle_invalid="error").fit(orders)
    idx = idx.transform(orders)
    enc = features.one_hot(["o_orderpriority"], in_suffix="_index", out_suffix="_oh", handle_invalid="error")
    enc = enc.fit(idx).transform(idx)
    return features.flatten_vector(enc, "o_orderpriority_oh", [f"oh_{j}" for j in range(4)],
                                   keep=["o_orderkey", "o_orderpriority_index"])


_SCALE_COLS = ["age", "education_num", "hours_per_week"]


@query("standard_scale", sql(
    "SELECT id, " + ", ".join(
        f"round((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}_s" for c in _SCALE_COLS
    ) + " FROM adults_complete"))
def q_standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assemble numerics, standardise with mean and sample stddev."""
    df = adults_complete(spark, sf_dir)
    out = features.standard_scaler(_SCALE_COLS, out="scaled").fit(df).transform(df)
    flat = features.flatten_vector(out, "scaled", [f"{c}_s" for c in _SCALE_COLS], keep=["id"])
    return flat.select("id", *[_r(f"{c}_s").alias(f"{c}_s") for c in _SCALE_COLS])


@query("minmax_scale", sql(
    "SELECT id, " + ", ".join(
        f"round((CAST({c} AS DOUBLE) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}_s"
        for c in _SCALE_COLS
    ) + " FROM adults_complete"))
def q_minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min-max scaling to [0, 1]."""
    df = adults_complete(spark, sf_dir)
    out = features.minmax_scaler(_SCALE_COLS, out="scaled").fit(df).transform(df)
    flat = features.flatten_vector(out, "scaled", [f"{c}_s" for c in _SCALE_COLS], keep=["id"])
    return flat.select("id", *[_r(f"{c}_s").alias(f"{c}_s") for c in _SCALE_COLS])


_FM_CAT = ["workclass", "sex"]
_FM_NUM = ["age", "hours_per_week"]


def _fm_index_cte(c: str) -> tuple[str, str]:
    return (f"ix_{c}", f"SELECT v, CAST(row_number() OVER (ORDER BY n DESC, v) - 1 AS INT) AS idx FROM "
                       f"(SELECT {c} AS v, count(*) AS n FROM train GROUP BY {c})")


_FM_DIMS = {"workclass": 5, "sex": 2}
_FEATURE_MATRIX_SQL = sql(
    "SELECT c.id, "
    + ", ".join(
        f"CASE WHEN ix_{c}.idx = {j} THEN 1.0 ELSE 0.0 END::DOUBLE AS f_{c}_{j}"
        for c in _FM_CAT for j in range(_FM_DIMS[c])
    )
    + ", "
    + ", ".join(f"round((CAST(c.{c} AS DOUBLE) - s.m_{c}) / s.s_{c}, 6) AS f_{c}" for c in _FM_NUM)
    + " FROM adults_complete c "
    + " ".join(f"LEFT JOIN ix_{c} ON c.{c} = ix_{c}.v" for c in _FM_CAT)
    + " CROSS JOIN s",
    ("train", f"SELECT * FROM adults_complete WHERE {_TRAIN80}"),
    *[_fm_index_cte(c) for c in _FM_CAT],
    ("s", "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _FM_NUM) + " FROM train"),
)


@query("feature_matrix", _FEATURE_MATRIX_SQL)
def q_feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot + standardised numerics assembled into one vector,
    fitted on the training part and applied to every row; flattened."""
    df = adults_complete(spark, sf_dir)
    train = df.filter(md5_bucket("id") < 80)
    model = features.one_hot_scaled(_FM_CAT, _FM_NUM).fit(train)
    out = model.transform(df)
    names = [f"f_{c}_{j}" for c in _FM_CAT for j in range(_FM_DIMS[c])] + [f"f_{c}" for c in _FM_NUM]
    flat = features.flatten_vector(out, "features", names, keep=["id"])
    return flat.select("id", *[F.col(n) for n in names[:-len(_FM_NUM)]],
                       *[_r(f"f_{c}").alias(f"f_{c}") for c in _FM_NUM])


@query("log_target", sql(
    "SELECT id, price, round(ln(price), 6) AS log_price, round(exp(ln(price)), 4) AS price_back "
    "FROM gems_valid WHERE price > 0"))
def q_log_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of the target and back."""
    df = gems_valid(spark, sf_dir).select("id", "price")
    lg = df.withColumn("log_price", features.log_label("price")).filter(F.col("log_price").isNotNull())
    return lg.select("id", "price", _r("log_price").alias("log_price"), _r(F.exp("log_price"), 4).alias("price_back"))


# ---------------------------------------------------------------------------
# Evaluation on deterministic scores (V1-V5)
# ---------------------------------------------------------------------------
_SCORE = "0.04 * age + 0.3 * education_num + 0.02 * hours_per_week - 5.5"
_SCORE2 = "CAST(age AS DOUBLE) - 2.0 * education_num"


def _scored(spark: SparkSession, sf_dir: str, score: str = _SCORE) -> DataFrame:
    df = adults_complete(spark, sf_dir)
    return df.select(
        "id",
        F.col("label").cast("double").alias("label"),
        F.expr(f"CAST({score} AS DOUBLE)").alias("score"),
    ).withColumn("prediction", F.when(F.col("score") > 0, 1.0).otherwise(0.0))


_SCORED_CTE = ("p", f"SELECT id, CAST(label AS DOUBLE) AS label, CAST({_SCORE} AS DOUBLE) AS score, "
                    f"CASE WHEN CAST({_SCORE} AS DOUBLE) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction "
                    f"FROM adults_complete")


def _auc_ctes(src: str) -> list[tuple[str, str]]:
    return [
        ("sg", f"SELECT score, CAST(sum(CASE WHEN label > 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS pos, "
               f"CAST(sum(CASE WHEN label > 0.5 THEN 0 ELSE 1 END) AS DOUBLE) AS neg FROM {src} GROUP BY score"),
        ("sr", "SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND "
               "1 PRECEDING), 0) AS nb FROM sg"),
        ("auc", "SELECT sum(pos * (nb + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM sr"),
    ]


_REPORT_SQL = sql(
    "SELECT round(sum(tp) / sum(n_label), 6) AS accuracy, "
    "round(sum(prec * n_label) / sum(n_label), 6) AS weighted_precision, "
    "round(sum(rec * n_label) / sum(n_label), 6) AS weighted_recall, "
    "round(sum(f1c * n_label) / sum(n_label), 6) AS f1, round((SELECT auc FROM auc), 6) AS auc, "
    "(SELECT count(*) FROM p) AS n_in, CAST(sum(n_label) AS BIGINT) AS n_scored, "
    "(SELECT count(*) FROM p WHERE label IS NOT NULL AND score IS NOT NULL) AS n_auc FROM pc",
    _SCORED_CTE,
    ("cm", "SELECT label AS y, prediction AS pr, count(*) AS n FROM p "
           "WHERE label IS NOT NULL AND prediction IS NOT NULL GROUP BY 1, 2"),
    ("bl", "SELECT y AS c, CAST(sum(CASE WHEN y = pr THEN n ELSE 0 END) AS DOUBLE) AS tp, "
           "CAST(sum(n) AS DOUBLE) AS n_label FROM cm GROUP BY y"),
    ("bp", "SELECT pr AS c, CAST(sum(n) AS DOUBLE) AS n_pred FROM cm GROUP BY pr"),
    ("pc0", "SELECT bl.tp, bl.n_label, CASE WHEN coalesce(bp.n_pred, 0) > 0 THEN bl.tp / bp.n_pred ELSE 0.0 END "
            "AS prec, bl.tp / bl.n_label AS rec FROM bl LEFT JOIN bp ON bl.c = bp.c"),
    ("pc", "SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1c FROM pc0"),
    *_auc_ctes("p"),
)


@query("classification_report", _REPORT_SQL)
def q_classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 A1 A2: accuracy, weighted precision/recall, F1 and AUC of a
    deterministic score, with rows in / scored."""
    r = evaluate.classification_report(_scored(spark, sf_dir), "label", "prediction", "score")
    return r.select(*[_r(c).alias(c) for c in ["accuracy", "weighted_precision", "weighted_recall", "f1", "auc"]],
                    "n_in", "n_scored", "n_auc")


@query("auc_roc", sql(
    "SELECT round(auc, 6) AS auc FROM auc",
    ("p2", f"SELECT CAST(label AS DOUBLE) AS label, CAST({_SCORE2} AS DOUBLE) AS score FROM adults_complete"),
    *_auc_ctes("p2"),
))
def q_auc_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: exact ROC area of a score with many ties (rank-sum, ties half)."""
    a = evaluate.auc_roc(_scored(spark, sf_dir, _SCORE2), "label", "score")
    return a.select(_r("auc").alias("auc"))


@query("confusion_matrix", sql("SELECT label, prediction, count(*) AS n FROM p GROUP BY label, prediction",
                               _SCORED_CTE))
def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 O2: rows per (label, prediction), ordered."""
    return evaluate.confusion_matrix(_scored(spark, sf_dir), "label", "prediction")


_GEM_PRED = "round(exp(5.5 + carat), 2)"


def _gems_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gems_valid(spark, sf_dir).withColumn("prediction", F.expr(_GEM_PRED))


@query("regression_metrics", sql(
    "SELECT round(1 - sum((price - prediction) * (price - prediction)) / (var_pop(price) * count(price)), 6) AS r2, "
    "round(sqrt(avg((price - prediction) * (price - prediction))), 6) AS rmse, "
    "round(avg(abs(price - prediction)), 6) AS mae, count(*) AS n_in, count(*) AS n_scored FROM gp",
    ("gp", f"SELECT *, {_GEM_PRED} AS prediction FROM gems_valid"),
))
def q_regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: R^2, RMSE, MAE in one aggregate."""
    r = evaluate.regression_report(_gems_pred(spark, sf_dir), "price", "prediction")
    return r.select(_r("r2").alias("r2"), _r("rmse").alias("rmse"), _r("mae").alias("mae"), "n_in", "n_scored")


@query("worst_residuals", sql(
    "SELECT id, cut, carat, price, prediction, round(price - prediction, 6) AS error, "
    "round(abs(price - prediction), 6) AS abs_error FROM gp",
    ("gp", f"SELECT *, {_GEM_PRED} AS prediction FROM gems_valid"),
))
def q_worst_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's error, the largest first."""
    w = evaluate.worst_residuals(_gems_pred(spark, sf_dir), "price", "prediction", "id", keep=["cut", "carat"])
    return w.select("id", "cut", "carat", "price", "prediction", _r("error").alias("error"),
                    _r("abs_error").alias("abs_error"))
