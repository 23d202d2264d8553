"""A key holding a third of all rows: results stay exact and the hot key is spread."""

from collections import Counter

from pyspark.sql import functions as F

from conftest import SF_MID
from tessera.operators import impute
from tessera.operators.joins import lookup_join
from tessera.plans.common import table


def _skewed(spark):
    orders = table(spark, SF_MID, "orders")
    hot = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_orderkey") % 500)
    return orders.select("o_orderkey", hot.cast("int").alias("k"), "o_orderpriority", "o_orderstatus")


def test_hot_key_is_split_by_the_join(spark):
    """Beyond the broadcast threshold AQE splits a hot partition by its blocks, whatever its rows hold."""
    keep = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in keep}
    for k, v in keep.items():
        spark.conf.set(k, v)
    try:
        # Many tasks before the shuffle: a partition is split between their blocks.
        rows = spark.range(0, 60_000, 1, 40).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).cast("int").alias("k"),
            F.sha2(F.col("id").cast("string"), 256).alias("v"))
        lookup = spark.range(500).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("t"), "id").alias("tag"))
        out = lookup_join(rows, lookup.repartition(3), ["k"])
        joined = out.select("k", "v", "tag", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len({r.p for r in joined if r.k == 0}) >= 2
    assert len(joined) == 60_000 and all(r.tag == f"t{r.k}" for r in joined)


def test_group_modes_exact_under_skew(spark):
    big = _skewed(spark)
    got = {(r.k): (r.o_orderpriority_mode, r.o_orderstatus_mode)
           for r in impute.group_modes(big, ["o_orderpriority", "o_orderstatus"], ["k"]).collect()}
    rows = big.select("k", "o_orderpriority", "o_orderstatus").collect()
    for i, col in enumerate(["o_orderpriority", "o_orderstatus"]):
        by = {}
        for r in rows:
            by.setdefault(r.k, Counter())[r[col]] += 1
        for k, c in by.items():
            best = min(c.items(), key=lambda kv: (-kv[1], kv[0]))[0]
            assert got[k][i] == best
    assert sum(1 for r in rows if r.k == 0) * 3 >= len(rows) - 3
