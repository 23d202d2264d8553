"""Plan shape of the deterministic queries: no Python in the hot path, no
cartesian or nested-loop joins, no single-partition window, no round-robin
shuffle of a table that is only read, pruned scans."""

import re

import pytest

from conftest import SF_SMALL
from tessera.operators import prefix
from tessera.plans import catalog
from tessera.plans import training  # noqa: F401 - registers the model queries

NAMES = sorted(catalog.ORACLES)
ROW_WISE = ["drop_missing", "feature_matrix", "hash_split", "impute_grouped_mode", "impute_mean_mode", "label_contains",
            "log_target", "minmax_scale", "one_hot", "ordinal_encode", "sentinel_null", "standard_scale", "string_index",
            "trim_label"]
# One-row views of a fit or of bounded report tables may meet in a nested-loop join in SQL, never here.
BAD = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "CartesianProduct",
       "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def single_partition_windows(plan: str) -> list[str]:
    """Windows whose rows come from an exchange into one partition."""
    final = plan.split("== Initial Plan ==")[0]
    lines, found = final.splitlines(), []
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            for below in lines[i + 1:]:
                if "Exchange" in below:
                    found += [line] if "SinglePartition" in below else []
                    break
    return found


def test_single_partition_window_is_recognised(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(10).repartition(3).withColumn("s", F.sum("id").over(Window.orderBy("id")))
    assert single_partition_windows(_plan(df))
    df = spark.range(10).withColumn("g", F.col("id") % 2)
    assert not single_partition_windows(_plan(df.withColumn("s", F.sum("id").over(Window.partitionBy("g")))))


@pytest.mark.parametrize("name", NAMES)
def test_plan_shape(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF_SMALL))
    for bad in BAD:
        assert bad not in plan, f"{name}: {bad}"
    # Only the per-class table (class shares), a row for each class, may meet in one task.
    if name != "class_distribution":
        assert not single_partition_windows(plan), name


@pytest.mark.parametrize("name", ROW_WISE)
def test_row_wise_queries_do_not_shuffle_rows(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF_SMALL))
    assert "RoundRobinPartitioning" not in plan
    if name in ("hash_split", "string_index", "one_hot"):
        assert "Exchange" not in plan


def test_prefix_sums_stay_in_generated_code_with_many_ranges(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).select("id", (F.col("id") % 7).alias("w"))
    out = prefix.prefix_sums(df, "id", ["w"], ranges=2000)
    assert not single_partition_windows(_plan(out))
    out.collect()
    assert "*(" in out._jdf.queryExecution().executedPlan().toString()  # generated code, after AQE
    bad = out.join(df.select(F.col("id").alias("i")), F.col("i") == F.col("id")).filter(
        F.col("w_before") != F.floor(F.col("id") / 7) * 21 + (F.col("id") % 7) * (F.col("id") % 7 - 1) / 2)
    assert bad.count() == 0 and out.count() == 20_000


def test_fixture_scans_read_only_used_columns(spark):
    plan = _plan(catalog.QUERIES["drop_missing"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    cols = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert cols == {"o_orderkey", "o_custkey", "o_orderpriority", "c_custkey", "c_nationkey", "c_mktsegment"}
