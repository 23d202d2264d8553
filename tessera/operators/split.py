"""Deterministic splitting.

``randomSplit`` draws per partition, so the same seed gives different rows
when the input is partitioned differently (trap T-17). ``hash_split`` assigns
each row by the first 32 bits of md5 of a key column instead: the assignment
depends on the key only, survives executor loss / recomputation, and is
reproducible in SQL. It is a projection + filter - no shuffle. Parts are cut from
2^32 places, so weights are kept to one in four billion; rows with a NULL key are
one key like any other, so the parts always cover the input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import md5_head

PLACES = 1 << 32


def cuts(weights: Mapping[str, float]) -> list[tuple[str, int, int]]:
    """``(part, first place, place after its last)``; a part with a positive weight has places."""
    total = float(sum(weights.values()))
    if total <= 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative and must sum to a positive number")
    out, acc = [], 0.0
    names = list(weights)
    for i, name in enumerate(names):
        lo = out[-1][2] if out else 0
        acc += weights[name]
        hi = PLACES if i == len(names) - 1 else round(acc / total * PLACES)
        if weights[name] > 0 and hi <= lo:
            raise ValueError(f"the weight of {name!r} is too small for a part of its own")
        out.append((name, lo, hi))
    return out


def split_label(key: str | Column, weights: Mapping[str, float], salt: str = "") -> Column:
    """Name of the part each row belongs to."""
    place = md5_head(key, salt)
    expr = None
    for name, lo, hi in cuts(weights):
        cond = (place >= lo) & (place < hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def assign_split(df: DataFrame, key: str, weights: Mapping[str, float], out: str = "split",
                 salt: str = "") -> DataFrame:
    return df.withColumn(out, split_label(key, weights, salt))


def hash_split(df: DataFrame, key: str, weights: Mapping[str, float], salt: str = "") -> dict[str, DataFrame]:
    """``{part: DataFrame}``; parts are disjoint and cover the input."""
    place = md5_head(key, salt)
    return {name: df.filter((place >= lo) & (place < hi)) for name, lo, hi in cuts(weights)}


def random_split(df: DataFrame, weights: Sequence[float], seed: int = 42) -> list[DataFrame]:
    """The reference's ``randomSplit`` (partitioning-dependent), kept as an option."""
    return df.randomSplit(list(weights), seed=seed)


# The reference's split proportions.
TRAIN_VAL_TEST = {"train": 0.6, "val": 0.2, "test": 0.2}
TRAIN_TEST_75 = {"train": 0.75, "test": 0.25}
TRAIN_TEST_80 = {"train": 0.8, "test": 0.2}
