"""Imputation as Estimator/Model pairs (C5-C7): fit on the training split,
apply the *same* statistics to every split (trap T-4).

* ``ModeImputer``        - most frequent non-NULL value per string column.
* ``CastColumns`` + Spark ``Imputer`` - mean of numeric columns, after a cast
  to double so 3.67 is not stored as 3 (T-10); label/id are never in the list (T-9).
* ``GroupedModeImputer`` - mode of the target inside groups of other columns,
  global mode as fallback (C6), for several targets with one join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.feature import Imputer
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.clean import FillConstant
from tessera.operators.joins import lookup_join
from tessera.operators.profile import assert_no_missing, mode_values
from tessera.operators.stages import Persistable, list_param, str_param
from tessera.session import checkpoint_dir, scratch_path


class NoModeError(ValueError):
    """A column to fill has no value at all in the training rows (trap T-9)."""


class CastColumns(Transformer, Persistable):
    inputCols = list_param("inputCols", "columns to cast")
    dataType = str_param("dataType", "target SQL type")

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None, dataType: str = "double"):
        super().__init__()
        self._setDefault(dataType="double")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        todo = set(self.getOrDefault(self.inputCols))
        dt = self.getOrDefault(self.dataType)
        return df.select([F.col(c).cast(dt).alias(c) if c in todo else F.col(c) for c in df.columns])


class ModeImputer(Estimator, Persistable):
    inputCols = list_param("inputCols", "categorical columns to fill")

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ModeImputerModel":
        cols = self.getOrDefault(self.inputCols)
        modes = mode_values(df, cols)
        if empty := [c for c in cols if modes.get(c) is None]:
            raise NoModeError(f"no value to fill {empty} with")
        m = ModeImputerModel(inputCols=cols)
        m._set_json(m.modes, modes)
        return m


class ModeImputerModel(Model, Persistable):
    inputCols = list_param("inputCols", "categorical columns to fill")
    modes = str_param("modes", "JSON object column -> mode")

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None):
        super().__init__()
        self._setDefault(modes="{}")
        self._set(**self._input_kwargs)

    def mode_map(self) -> dict[str, str]:
        return self._get_json(self.modes, {})

    def _transform(self, df: DataFrame) -> DataFrame:
        m = self.mode_map()
        return df.na.fill(m) if m else df


def mean_mode_imputer(num_cols: Sequence[str], cat_cols: Sequence[str]) -> Pipeline:
    """C5 as one pipeline: cast numerics to double, mean-impute them (NULL and
    NaN are missing), mode-impute the categorical columns."""
    stages = []
    if num_cols:
        stages += [
            CastColumns(inputCols=list(num_cols)),
            Imputer(inputCols=list(num_cols), outputCols=list(num_cols), strategy="mean"),
        ]
    if cat_cols:
        stages.append(ModeImputer(inputCols=list(cat_cols)))
    return Pipeline(stages=stages)


def value_counts(df: DataFrame, targets: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """``(groups..., __target, __value, __n)``: rows per non-NULL value of each
    target inside each group (partial + final hash aggregate, so a group with a
    large share of the rows is pre-aggregated in every task)."""
    targets, groups = list(targets), list(groups)
    long = (
        df.select(*groups, *[F.col(t).cast("string").alias(t) for t in targets])
        .unpivot(groups, targets, "__target", "__value")
        .filter(F.col("__value").isNotNull())
    )
    return long.groupBy(*groups, "__target", "__value").agg(F.count(F.lit(1)).alias("__n"))


def modes_from_counts(counts: DataFrame, targets: Sequence[str], groups: Sequence[str],
                      method: str = "aggregate") -> DataFrame:
    """``(groups..., <target>_mode...)`` from ``value_counts`` (ties to the smallest value)."""
    targets, groups = list(targets), list(groups)
    if method == "window":
        from pyspark.sql import Window

        w = Window.partitionBy(*groups, "__target").orderBy(F.desc("__n"), F.asc("__value"))
        best = counts.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") == 1)
        best = best.select(*groups, "__target", F.col("__value").alias("__mode"))
        wide = best.groupBy(*groups).pivot("__target", targets).agg(F.first("__mode"))
        return wide.select(*groups, *[F.col(t).alias(f"{t}_mode") for t in targets])
    # One aggregate per group: for each target the smallest (-count, value).
    key = F.struct((-F.col("__n")).alias("neg"), F.col("__value").alias("v"))
    best = counts.groupBy(*groups).agg(
        *[F.min(F.when(F.col("__target") == t, key)).alias(f"__b{i}") for i, t in enumerate(targets)]
    )
    return best.select(*groups, *[F.col(f"__b{i}.v").alias(f"{t}_mode") for i, t in enumerate(targets)])


def group_modes(df: DataFrame, targets: Sequence[str], groups: Sequence[str], method: str = "aggregate") -> DataFrame:
    """``(groups..., <target>_mode...)``: most frequent non-NULL value of each
    target inside each group, ties to the smallest value.

    ``aggregate`` (default): count per (group, value), then a second hash
    aggregate keeps ``min(struct(-count, value))`` - no sort.
    ``window``: the reference's ``row_number() over (partition by group order
    by count desc)`` + ``rank = 1`` (W1/W2), with the value as tie-break;
    Spark plans it with a ``WindowGroupLimit`` before the shuffle.
    """
    return modes_from_counts(value_counts(df, targets, groups), targets, groups, method)


class GroupedModeImputer(Estimator, Persistable):
    """Fill each target with the mode of its group (``groupCols``), else the
    global mode; NULL group keys never match and fall back to the global mode,
    NaN keys are one group."""

    targetCols = list_param("targetCols", "categorical columns to fill")
    groupCols = list_param("groupCols", "grouping columns")

    @keyword_only
    def __init__(self, targetCols: list[str] | None = None, groupCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "GroupedModeImputerModel":
        targets = self.getOrDefault(self.targetCols)
        groups = self.getOrDefault(self.groupCols)
        # One pass over the data: the pre-aggregated counts are checkpointed and
        # both the group modes and the global modes are derived from them.
        checkpoint_dir(df.sparkSession)
        counts = value_counts(df, targets, groups).checkpoint(eager=True)
        totals = counts.groupBy("__target", "__value").agg(F.sum("__n").alias("__n"))
        best = totals.groupBy("__target").agg(F.min(F.struct((-F.col("__n")).alias("neg"),
                                                              F.col("__value").alias("v"))).alias("b"))
        model = GroupedModeImputerModel(targetCols=targets, groupCols=groups)
        model._set_json(model.globalModes, {r["__target"]: r["b"]["v"] for r in best.collect()})
        model.table_path = scratch_path(df.sparkSession, "group-modes")
        modes_from_counts(counts, targets, groups).write.parquet(model.table_path)
        return model


class _TableWriter(DefaultParamsWriter):
    """Params as usual, and the group-mode table beside them."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        table = self.instance.mode_table(self.sparkSession)
        table.write.parquet(f"{path.rstrip('/')}/{MODES}")


class _TableReader(DefaultParamsReader):
    def load(self, path: str) -> "GroupedModeImputerModel":
        model = super().load(path)
        model.table_path = f"{path.rstrip('/')}/{MODES}"
        return model


MODES = "modes.parquet"


class GroupedModeImputerModel(Model, Persistable):
    """The group modes are a Parquet table of any size: in the shared folder after
    fitting, inside the model's own folder once it is saved."""

    targetCols = list_param("targetCols", "categorical columns to fill")
    groupCols = list_param("groupCols", "grouping columns")
    globalModes = str_param("globalModes", "JSON object target -> global mode")

    table_path: str = ""

    @keyword_only
    def __init__(self, targetCols: list[str] | None = None, groupCols: list[str] | None = None):
        super().__init__()
        self._setDefault(globalModes="{}")
        self._set(**self._input_kwargs)

    def copy(self, extra=None):
        that = super().copy(extra)
        that.table_path = self.table_path
        return that

    def write(self) -> _TableWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> _TableReader:
        return _TableReader(cls)

    def mode_table(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.table_path)

    def _transform(self, df: DataFrame) -> DataFrame:
        targets = self.getOrDefault(self.targetCols)
        groups = self.getOrDefault(self.groupCols)
        glob = self._get_json(self.globalModes, {})
        joined = lookup_join(df, self.mode_table(df.sparkSession), groups)
        fills = {
            t: F.coalesce(F.col(t), F.col(f"{t}_mode"), F.lit(glob.get(t)).cast("string")).alias(t)
            for t in targets
        }
        return joined.select([fills.get(c, F.col(c)) for c in df.columns])


def fill_verified(model, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df`` filled by a fitted imputer; an error if a cell of ``cols`` is still missing."""
    return assert_no_missing(model.transform(df), cols, "the filled rows")


def predictive_grouping(targets: Sequence[str], groups: Sequence[str], fill_cols: Sequence[str]) -> Pipeline:
    """Grouped-mode fill for ``targets``, then ``"Unknown"`` for any string NULL left in ``fill_cols``."""
    return Pipeline(
        stages=[
            GroupedModeImputer(targetCols=list(targets), groupCols=list(groups)),
            FillConstant(inputCols=list(fill_cols), value="Unknown"),
        ]
    )
