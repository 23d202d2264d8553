"""Column helpers: typed selectors, predicates and small scalar expressions.

All helpers return ``Column`` expressions built from ``pyspark.sql.functions``
so they stay inside whole-stage code generation; none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Missing-value sentinels of the census CSV (compared after trim).
DEFAULT_SENTINELS = ("?", "")

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def string_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def numeric_cols(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC) and f.name not in skip]


def is_float_type(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def is_missing(df: DataFrame, name: str, sentinels: Sequence[str] | None = None) -> Column:
    """Missing := NULL; for float columns also NaN (trap T-11); for string
    columns optionally a sentinel after trimming (``"?"``, ``" ?"``, ``""``)."""
    c = named(name)
    cond = c.isNull()
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        cond = cond | F.isnan(c)
    elif isinstance(dtype, T.StringType) and sentinels:
        cond = cond | F.trim(c).isin(list(sentinels))
    return cond


def select_rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename several columns in one projection, keeping column order."""
    return df.select([F.col(c).alias(mapping.get(c, c)) for c in df.columns])


def percent(n: Column | str, total: Column | str) -> Column:
    """``100 * n / total`` as a column; a zero total gives NULL, not an error."""
    n = F.col(n) if isinstance(n, str) else n
    total = F.col(total) if isinstance(total, str) else total
    return F.lit(100.0) * n.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))


def named(name: str) -> Column:
    """A column by its whole name: dots and backticks in it are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation over the rows where both columns have a value (not
    NULL, not NaN), as an aggregate that returns NULL (not an ANSI division
    error) when either column is constant there (trap T-23)."""
    x, y = named(a).cast("double"), named(b).cast("double")
    both = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    x, y = F.when(both, x), F.when(both, y)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


#: Text that stands for a NULL key.
NULL_KEY = "<null>"


def md5_head(key: Column | str, salt: str = "") -> Column:
    """The first 32 bits of ``md5(salt || key)`` as a number; a NULL key is a key
    of its own. Independent of partitioning (trap T-17) and reproducible in any
    SQL engine that has md5."""
    k = named(key) if isinstance(key, str) else key
    text = F.coalesce(k.cast("string"), F.lit(NULL_KEY))
    text = F.concat(F.lit(salt), text) if salt else text
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def md5_bucket(key: Column | str, buckets: int = 100, salt: str = "") -> Column:
    """Deterministic bucket in ``[0, buckets)`` from ``md5_head``."""
    return (md5_head(key, salt) % F.lit(int(buckets))).cast("int")
