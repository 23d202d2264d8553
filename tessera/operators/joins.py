"""Lookup joins against a table with one row per key.

The join strategy is Spark's: a lookup side below the broadcast threshold (by its
measured size, also at run time) is broadcast, a larger one is a sort-merge join
whose skewed partitions AQE splits, also when all rows of a hot key are identical.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup_join(big: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``big JOIN lookup USING (keys)``; column order of ``big`` first, then the
    lookup's value columns (the USING form would move the keys to the front)."""
    keys = list(keys)
    values = [c for c in lookup.columns if c not in keys]
    return big.join(lookup, on=keys, how=how).select(*big.columns, *values)
