"""Tables written once to the cluster's shared checkpoint folder.

A step that several later steps read, or that must not be computed again when an
executor is lost, is written as Parquet below ``spark.checkpoint.dir`` and read
back. ``drop`` removes tables that later ones have superseded, ``clear`` all that a
session has written, when its results are stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.session import scratch_path

#: Paths by application: one session does not delete another's.
_WRITTEN: dict[str, list[str]] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh path of the shared folder, and read from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` gave, once everything computed from them is stored itself."""
    for t in tables:
        mine = _WRITTEN.get(t.sparkSession.sparkContext.applicationId, [])
        if t.stored_at in mine:
            mine.remove(t.stored_at)
            _delete(t.sparkSession, t.stored_at)


def clear(spark: SparkSession) -> None:
    """Delete the tables that ``stored`` has written in this application."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
