"""Distributed running sums over a sorted key, without a single-partition window.

A window with no ``partitionBy`` moves every row into one task. Instead the rows
are range-partitioned by ``(group, key)`` and written once to the shared folder with
the number of their range; a running sum inside a range is a window partitioned by
``(group, range)``, and every range's offset is the sum of the ranges before it,
from a table with one row for each group and range. There is no limit on groups,
ranges or keys.

Input rows must already be unique per ``(group_cols, order_col)`` (aggregate
first); the output adds ``<col>_before`` = sum of ``col`` over all rows of the
same group with a strictly smaller key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import scratch_path
from tessera.sources.files import literal_rows

RANGE = "__range"


def prefix_sums(
    df: DataFrame,
    order_col: str,
    sum_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    ranges: int | None = None,
    with_total: bool = False,
) -> DataFrame:
    """Add ``<c>_before`` (and with ``with_total`` also ``<c>_total``) for every ``c`` in ``sum_cols``.

    ``ranges``: number of range partitions (default: the session's shuffle partitions).
    """
    spark = df.sparkSession
    groups = list(group_cols)
    n = int(ranges or spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ranges")
    dealt = df.repartitionByRange(n, *groups, order_col).withColumn(RANGE, F.spark_partition_id())
    dealt.write.parquet(path)  # range numbers are fixed from here on
    dealt = spark.read.schema(dealt.schema).parquet(path)

    inside = Window.partitionBy(*groups, RANGE).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__in_{c}") for c in sum_cols])
    totals = dealt.groupBy(*groups, RANGE).agg(*[F.sum(c).alias(f"__t_{c}") for c in sum_cols])
    if groups:
        earlier = Window.partitionBy(*groups).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*groups)
        offsets = totals.select(
            *groups, RANGE,
            *[F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__off_{c}") for c in sum_cols],
            *[F.sum(f"__t_{c}").over(whole).alias(f"__all_{c}") for c in sum_cols])
        # NULL groups are groups, too.
        other = offsets.withColumnsRenamed({g: f"__g_{g}" for g in groups}).withColumnRenamed(RANGE, "__r")
        same = F.col(RANGE) == F.col("__r")
        for g in groups:
            same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
        out = inner.join(other, same)
    else:
        # One row for each of the n ranges: their sums are added up on the driver.
        sums = {c: 0 for c in sum_cols}
        rows = []
        for r in sorted(totals.collect(), key=lambda r: r[RANGE]):
            rows.append([r[RANGE], *sums.values()])
            sums = {c: v + (r[f"__t_{c}"] or 0) for c, v in sums.items()}
        kinds = {c: totals.schema[f"__t_{c}"].dataType.simpleString() for c in sum_cols}
        ddl = ", ".join([f"{RANGE} int"] + [f"`__off_{c}` {kinds[c]}" for c in sum_cols])
        offsets = literal_rows(spark, rows, ddl)
        out = inner.join(F.broadcast(offsets), RANGE)
        out = out.withColumns({f"__all_{c}": F.lit(sums[c]).cast(kinds[c]) for c in sum_cols})
    extra = [F.col(f"__all_{c}").alias(f"{c}_total") for c in sum_cols] if with_total else []
    return out.select(
        *df.columns,
        *[(F.col(f"__off_{c}") + F.col(f"__in_{c}")).alias(f"{c}_before") for c in sum_cols],
        *extra,
    )
