"""Global byte-size prefix sums cut at equal targets: contiguous, balanced shards.

Only narrow rows move: the key, the byte size and a checksum, never the text.
The rows are range-partitioned by key and written once to the shared checkpoint
folder together with their range number. Each range adds up its own bytes; the
totals (one row for each range) give every range its offset, and offset plus
running sum inside the range is the global prefix sum. A row belongs to the shard
in which the middle of its bytes lies, so a shard differs from the equal target
by half of its first and last row at most.

Edge cases: a null text counts no bytes (size 1, the separator); rows with a
null key come first; equal keys are ordered by checksum and size, and rows equal
in all three are interchangeable; an empty table gives no rows; with fewer rows
than shards some shards stay empty. Other columns of the input are not read, so
their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir


def sized_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32``: what the cut needs of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )


def byte_prefix_sums(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """Add ``bytes_before`` and ``rows_before`` (over all rows in key order) and ``total_bytes``.

    ``rows`` has ``key, size, text_crc32``. ``ranges`` (default: the session's
    shuffle partitions) is the number of sorted ranges; it bounds the table of
    totals, the only one that is broadcast.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    n = int(ranges or spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    dealt = (
        rows.repartitionByRange(n, *order)
        .withColumn("range_no", F.spark_partition_id())
        .checkpoint(eager=True)  # range numbers are fixed from here on
    )
    inside = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = dealt.select(
        "*",
        F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("bytes_in"),
        F.count(F.lit(1)).over(inside).alias("rows_in"),
    )
    totals = dealt.groupBy("range_no").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("r"))
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    whole = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "range_no",
        F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("bytes_off"),
        F.coalesce(F.sum("r").over(earlier), F.lit(0)).alias("rows_off"),
        F.sum("b").over(whole).alias("total_bytes"),
    )
    return running.join(F.broadcast(offsets), "range_no").select(
        "key", "size", "text_crc32",
        (F.col("bytes_off") + F.col("bytes_in")).alias("bytes_before"),
        (F.col("rows_off") + F.col("rows_in")).alias("rows_before"),
        "total_bytes",
    )


def balanced_shards(df: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text",
                    ranges: int | None = None) -> DataFrame:
    """``key, size, text_crc32, shard, slot`` for every row of ``df``.

    ``shard`` counts from 0 to ``n_shards - 1`` in key order, ``slot`` without
    gaps from 0 inside each shard.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    placed = byte_prefix_sums(sized_rows(df, key, text), ranges)
    twice_middle = F.col("bytes_before") * 2 + F.col("size")
    shard = F.least(F.lit(n_shards - 1).cast("long"),
                    F.expr(f"({n_shards} * (bytes_before * 2 + size)) div (2 * total_bytes)"))
    # Beyond 2^62 the product would overflow; decimals are only needed there.
    exact = F.floor(twice_middle.cast("decimal(38,0)") * n_shards / (F.col("total_bytes").cast("decimal(20,0)") * 2))
    small = F.col("total_bytes") < F.lit((1 << 61) // max(1, 2 * n_shards))
    placed = placed.withColumn("shard", F.when(small, shard).otherwise(
        F.least(F.lit(n_shards - 1).cast("long"), exact.cast("long"))).cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("rows_before").alias("first_row"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "key", "size", "text_crc32", "shard", (F.col("rows_before") - F.col("first_row")).alias("slot"))
