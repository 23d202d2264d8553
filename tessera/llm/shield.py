"""Columns that an operator hands on under names of its own, so that no name of the input can clash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.columns import named


def inner(i: int) -> str:
    return f"__carried_{i}"


def shielded(columns: Sequence[str]) -> list[Column]:
    """The columns, to be selected under inner names."""
    return [named(c).alias(inner(i)) for i, c in enumerate(columns)]


def restored(columns: Sequence[str]) -> list[Column]:
    """The columns from their inner names."""
    return [F.col(inner(i)).alias(c) for i, c in enumerate(columns)]
