"""Rows dealt to key ranges by fixed cuts: pairs (key, tie) of 64-bit numbers in order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key of rows whose key is null: before all others.
NULL_KEY = -(1 << 63)


def packed(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Pairs of signed numbers as byte strings in the pairs' order."""
    both = np.empty((len(key), 2), ">u8")
    both[:, 0] = key.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    both[:, 1] = tie.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.frombuffer(both.tobytes(), "S16") if len(key) else np.zeros(0, "S16")


def key_of(column: Column) -> Column:
    return F.coalesce(column.cast("long"), F.lit(NULL_KEY))


def first_keys(pairs: DataFrame) -> np.ndarray:
    """Sorted cuts from ``pairs (key, tie)``, one row for each range: the caller bounds their number."""
    found = sorted((r["key"], r["tie"]) for r in pairs.select("key", "tie").collect())
    return packed(np.array([k for k, _ in found], np.int64), np.array([t for _, t in found], np.int64))


def range_firsts(rows: DataFrame, n: int) -> np.ndarray:
    """The first pair of each of at most ``n`` ranges of about equal numbers of rows."""
    dealt = rows.select("key", "tie").repartitionByRange(n, "key", "tie")
    firsts = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("key", "tie")).alias("f"))
    return first_keys(firsts.select("f.key", "f.tie"))


def placing(spark, firsts: np.ndarray):
    """A function of (key, tie): twice the range's number, plus 1 for a range's first pair."""
    cuts = spark.sparkContext.broadcast(firsts)

    @F.pandas_udf("long")
    def place(key: pd.Series, tie: pd.Series) -> pd.Series:
        own = packed(key.to_numpy(), tie.to_numpy())
        at = np.maximum(np.searchsorted(cuts.value, own, side="right") - 1, 0)
        return pd.Series(at * 2 + (cuts.value[at] == own))

    return place
