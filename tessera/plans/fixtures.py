"""Derived fixtures over the driver tables (definitions in FIXTURES.md).

``gems``   - regression: ordinal levels, invalid zero sizes, redundant sizes.
``adults`` - classification: leading spaces, ``?``/``''`` sentinels, NULL numerics.

Each fixture is defined once as a list of SQL expressions. Spark evaluates the
list with ``selectExpr`` over ``orders JOIN customer`` (projection and join are
planned by Catalyst; only the referenced columns are read), and the DuckDB
oracle gets the same list spliced into a ``WITH`` clause, so both engines see
identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import read_table

_ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_CUSTOMER_COLS = ["c_custkey", "c_nationkey", "c_mktsegment"]

GEMS_BASE = [
    "o_orderkey AS id",
    "round(0.2 + CAST(o_orderkey * 7919 % 281 AS DOUBLE) / 100, 2) AS carat",
    "o_orderpriority AS cut",
    "c_mktsegment AS color",
    "o_orderstatus AS clarity",
    "CAST(55 + o_orderkey * 31 % 15 AS DOUBLE) AS depth",
    "CAST(50 + o_orderkey * 17 % 20 AS DOUBLE) AS tbl",
]

GEMS_DERIVED = [
    "CASE WHEN id % 97 = 0 THEN 0.0 ELSE carat * 2.1 END AS x",
    "CASE WHEN id % 89 = 0 THEN 0.0 ELSE carat * 2.0 END AS y",
    "CASE WHEN id % 83 = 0 THEN 0.0 ELSE carat * 1.3 END AS z",
    "round(exp(5.5 + 1.0 * carat"
    " + 0.12 * (6 - CAST(substr(cut, 1, 1) AS INT))"
    " + 0.08 * CASE color WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3"
    " WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END"
    " + 0.2 * (CAST(id * 104729 % 1000 AS DOUBLE) / 1000 - 0.5)), 2) AS price",
]

ADULTS_EXPRS = [
    "o_orderkey AS id",
    "CAST(17 + o_orderkey * 31 % 74 AS INT) AS age",
    "CASE WHEN o_orderkey % 17 = 0 THEN ' ?' WHEN o_orderkey % 53 = 0 THEN ''"
    " ELSE concat(' ', o_orderpriority) END AS workclass",
    "CASE WHEN o_orderkey % 13 = 0 THEN ' ?' ELSE concat(' ', c_mktsegment) END AS occupation",
    "CASE WHEN c_custkey % 2 = 0 THEN ' Male' ELSE ' Female' END AS sex",
    "CAST(1 + c_nationkey % 16 AS DOUBLE) AS education_num",
    "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(20 + o_orderkey * 13 % 60 AS DOUBLE) END AS hours_per_week",
    "CASE WHEN 0.04 * (o_orderkey * 31 % 74) + 0.3 * (c_nationkey % 16) + 0.02 * (o_orderkey * 13 % 60)"
    " + CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0 ELSE 0.0 END"
    " + 2.0 * (CAST(o_orderkey * 104729 % 1000 AS DOUBLE) / 1000 - 0.5) > 5.5"
    " THEN ' >50K' ELSE ' <=50K' END AS income",
]

# Column roles of the fixtures.
GEMS_ORDINAL_LEVELS = {
    # Level order, lowest first, for the gems fixture.
    "cut": ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"],
    "color": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "clarity": ["F", "O", "P"],
}
GEMS_NUMERIC = ["carat", "depth", "tbl"]
GEMS_FEATURES = ["carat", "depth", "tbl", "cut_score", "color_score", "clarity_score"]
ADULTS_CATEGORICAL = ["workclass", "occupation", "sex"]
ADULTS_NUMERIC = ["age", "education_num", "hours_per_week"]


def _orders_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(*_ORDERS_COLS)
    customer = read_table(spark, sf_dir, "customer").select(*_CUSTOMER_COLS)
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "inner")


def gems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, carat, cut, color, clarity, depth, tbl, x, y, z, price."""
    base = _orders_customer(spark, sf_dir).selectExpr(*GEMS_BASE)
    return base.selectExpr("*", *GEMS_DERIVED)


def adults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, age, workclass, occupation, sex, education_num, hours_per_week, income."""
    return _orders_customer(spark, sf_dir).selectExpr(*ADULTS_EXPRS)


def _join_sql() -> str:
    return "orders JOIN customer ON o_custkey = c_custkey"


GEMS_SQL = (
    "SELECT *, " + ", ".join(GEMS_DERIVED) + " FROM (SELECT " + ", ".join(GEMS_BASE) + " FROM " + _join_sql() + ") t"
)
ADULTS_SQL = "SELECT " + ", ".join(ADULTS_EXPRS) + " FROM " + _join_sql()


def with_fixtures(sql: str, *extra_ctes: tuple[str, str]) -> str:
    """Prefix ``sql`` with CTEs ``gems``/``adults`` (+ extra ``(name, body)`` pairs)."""
    ctes = [("gems", GEMS_SQL), ("adults", ADULTS_SQL), *extra_ctes]
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in ctes) + "\n" + sql
