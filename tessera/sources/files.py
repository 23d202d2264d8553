"""Table sources: Parquet tables, CSV files (with or without header), literal rows.

S1/S2: ``read_csv`` takes an explicit ``StructType`` first; schema inference is
only a fallback because it costs one extra pass over the files.
S3/S4: ``name_columns`` renames positional ``_c0.._cN`` columns in one
projection instead of a chain of ``withColumnRenamed`` calls.
S5: ``literal_rows`` builds a small DataFrame from Python tuples and a typed schema; values must fit it.
S6: ``preview`` is a bounded ``limit``; nothing unbounded is brought to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables (filters and projections push down to the scan)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    header: bool = False,
    names: Sequence[str] | None = None,
    sep: str = ",",
    strip_leading_space: bool = True,
    infer: bool | None = None,
) -> DataFrame:
    """Read CSV files.

    * ``schema`` given: no inference pass, types are exact.
    * ``schema`` absent: ``inferSchema`` (one more pass over the files).
    * ``names``: positional names for headerless files (S3/S4).
    * ``strip_leading_space``: fields such as ``" 39"``, ``" State-gov"`` lose the
      leading blank at parse time, so numbers parse as numbers and strings
      compare equal to their trimmed form (trap T-1).
    """
    reader = spark.read.option("header", str(bool(header)).lower()).option("sep", sep)
    reader = reader.option("ignoreLeadingWhiteSpace", str(bool(strip_leading_space)).lower())
    if schema is not None:
        reader = reader.schema(schema)
    elif infer is None or infer:
        reader = reader.option("inferSchema", "true")
    df = reader.csv(path if isinstance(path, str) else list(path))
    if names is not None:
        df = name_columns(df, names)
    return df


def name_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Assign names by position (one projection)."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def write_csv(df: DataFrame, path: str, header: bool = False, sep: str = ",") -> str:
    """Write a DataFrame as CSV (used for round trips through the CSV reader)."""
    df.write.mode("overwrite").option("header", str(bool(header)).lower()).option("sep", sep).csv(path)
    return path


def literal_rows(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType | str) -> DataFrame:
    """A small DataFrame from literal tuples with an explicit schema.

    The rows become an Arrow table of exactly these types (dates, timestamps and
    decimals included; a value that does not fit its type is an error), which
    Spark holds as a local relation: no Python worker is started to read it.
    Meant for driver-side values of bounded size (a what-if row, a report).
    """
    st = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(st)
    columns = list(zip(*rows)) or [()] * len(st)
    if len(columns) != len(st):
        raise ValueError(f"rows of {len(columns)} values for {len(st)} columns")
    table = pa.Table.from_arrays([pa.array(list(c)).cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, schema=st)


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """Bounded preview of a table (S6); stays a DataFrame."""
    return df.limit(int(n))
