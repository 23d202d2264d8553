"""Shared building blocks of the query catalog: cleaned fixture views in both
engines (Spark functions and the matching SQL text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import clean
from tessera.plans import fixtures
from tessera.sources.files import read_table

ADULT_STRINGS = ["workclass", "occupation", "sex"]
ADULT_COLUMNS = ["id", "age", "workclass", "occupation", "sex", "education_num", "hours_per_week", "label"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def adults_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed, sentinels -> NULL, ``income`` -> ``label`` (NULLs kept)."""
    df = fixtures.adults(spark, sf_dir)
    df = clean.trim_strings(df)
    df = clean.sentinel_to_null(df, ADULT_STRINGS + ["income"])
    return clean.binary_label(df, "income", ">50K")


def adults_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``adults_clean`` without rows that have any missing cell."""
    return clean.drop_missing(adults_clean(spark, sf_dir))


def gems_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = clean.split_valid(fixtures.gems(spark, sf_dir), clean.valid_rule(["x", "y", "z"]))
    return good


def sql_bucket(key: str) -> str:
    """DuckDB form of ``functions.md5_bucket`` (100 buckets, no salt)."""
    return f"((('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8))::BIGINT) % 100)"


def sql_place(key: str) -> str:
    """DuckDB form of ``functions.md5_head``: the place of a key among 2^32."""
    return f"(('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '<null>')), 1, 8))::BIGINT)"


def _sentinel_sql(c: str) -> str:
    return f"CASE WHEN trim({c}) IN ('?', '') THEN NULL ELSE trim({c}) END AS {c}"


ADULTS_CLEAN_SQL = (
    "SELECT id, age, "
    + ", ".join(_sentinel_sql(c) for c in ADULT_STRINGS)
    + ", education_num, hours_per_week, "
    "CASE WHEN trim(income) IN ('?', '') OR income IS NULL THEN NULL "
    "WHEN trim(income) = '>50K' THEN 1 ELSE 0 END AS label FROM adults"
)
ADULTS_COMPLETE_SQL = (
    "SELECT * FROM adults_clean WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in ADULT_COLUMNS)
    + " AND NOT isnan(education_num) AND NOT isnan(hours_per_week)"
)
GEMS_VALID_SQL = "SELECT * FROM gems WHERE coalesce(x > 0 AND y > 0 AND z > 0, false)"

CLEAN_CTES = (("adults_clean", ADULTS_CLEAN_SQL), ("adults_complete", ADULTS_COMPLETE_SQL),
              ("gems_valid", GEMS_VALID_SQL))


def sql(body: str, *extra: tuple[str, str]) -> str:
    """``body`` with the fixture CTEs (gems, adults, cleaned views, extras) in front."""
    return fixtures.with_fixtures(body, *CLEAN_CTES, *extra)
