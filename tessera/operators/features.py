"""Feature engineering (E1-E11) as Spark ML stages.

All heavy lifting is in JVM stages (``SQLTransformer``, ``StringIndexer``,
``OneHotEncoder``, ``VectorAssembler``, ``StandardScaler``, ``MinMaxScaler``);
fitting them is one aggregation each (value counts, column moments).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import (
    MinMaxScaler,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.stages import Persistable, int_param, str_param

def _sql_str(v: str) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def ordinal_case(col: str, levels: Sequence[str], default: int = 0) -> str:
    """``CASE`` ladder: levels[i] -> i+1, anything else (NULL included) -> default."""
    whens = " ".join(f"WHEN `{col}` = {_sql_str(v)} THEN {i + 1}" for i, v in enumerate(levels))
    return f"CASE {whens} ELSE {int(default)} END"


def ordinal_encoder(mapping: Mapping[str, Sequence[str]], suffix: str = "_score", default: int = 0) -> SQLTransformer:
    """``SELECT *, CASE ... END AS <col>_score ... FROM __THIS__`` as a
    ``SQLTransformer`` (JVM-side, persistable). Output type int."""
    parts = [f"{ordinal_case(c, lv, default)} AS `{c}{suffix}`" for c, lv in mapping.items()]
    return SQLTransformer(statement="SELECT *, " + ", ".join(parts) + " FROM __THIS__")


#: Names of the columns that the stages put between the inputs and the features.
INDEXED, ENCODED, SCALED = "__ix", "__oh", "scaled_inputs"


def string_indexer(cols: Sequence[str], suffix: str = INDEXED, handle_invalid: str = "keep") -> StringIndexer:
    """Index by frequency (desc), ties alphabetical. Default ``keep``: NULL
    and unseen values get the extra index instead of silently dropping the row
    (trap T-3); ``skip`` reproduces the reference."""
    return StringIndexer(
        inputCols=list(cols), outputCols=[c + suffix for c in cols], handleInvalid=handle_invalid,
        stringOrderType="frequencyDesc",
    )


def one_hot(cols: Sequence[str], in_suffix: str = INDEXED, out_suffix: str = ENCODED, drop_last: bool = True,
            handle_invalid: str = "error") -> OneHotEncoder:
    """Index -> sparse indicator vector, last category dropped. Indexes from
    ``string_indexer`` are always in range (its ``keep`` reserves a slot for
    unseen values), so the encoder itself never needs ``keep``."""
    return OneHotEncoder(
        inputCols=[c + in_suffix for c in cols], outputCols=[c + out_suffix for c in cols], dropLast=drop_last,
        handleInvalid=handle_invalid,
    )


def one_hot_scaled(cat_cols: Sequence[str], num_cols: Sequence[str], features: str = "features",
                   handle_invalid: str = "keep", scaled: str = SCALED) -> Pipeline:
    """Index + one-hot categoricals, assemble + standardise numerics,
    assemble everything into ``features``."""
    cat_cols, num_cols = list(cat_cols), list(num_cols)
    stages: list = []
    inputs: list[str] = []
    if cat_cols:
        # With ``keep`` the indexer already reserves index k for unseen values, so
        # the encoder sees k+1 categories and dropLast leaves k columns: one per
        # seen value, the unseen value as the all-zero vector.
        stages += [string_indexer(cat_cols, handle_invalid=handle_invalid), one_hot(cat_cols, handle_invalid="error")]
        inputs += [c + ENCODED for c in cat_cols]
    if num_cols:
        stages += [
            VectorAssembler(inputCols=num_cols, outputCol=f"{scaled}_in"),
            StandardScaler(inputCol=f"{scaled}_in", outputCol=scaled, withMean=True, withStd=True),
        ]
        inputs.append(scaled)
    stages.append(VectorAssembler(inputCols=inputs, outputCol=features))
    return Pipeline(stages=stages)


def indexed(cat_cols: Sequence[str], num_cols: Sequence[str], features: str = "features",
            handle_invalid: str = "keep") -> Pipeline:
    """Tree-friendly features - category indexes and raw numerics."""
    cat_cols, num_cols = list(cat_cols), list(num_cols)
    stages: list = [string_indexer(cat_cols, handle_invalid=handle_invalid)] if cat_cols else []
    stages.append(VectorAssembler(inputCols=[c + INDEXED for c in cat_cols] + num_cols, outputCol=features,
                                  handleInvalid="skip" if handle_invalid == "skip" else "error"))
    return Pipeline(stages=stages)


def assembler(cols: Sequence[str], out: str = "features", handle_invalid: str = "error") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid)


def standard_scaler(cols: Sequence[str], out: str = "scaled") -> Pipeline:
    """E4 + E5: assemble numerics, ``(x - mean) / stddev_samp``; a constant column gives 0."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(cols), outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol=out, withMean=True, withStd=True),
    ])


def minmax_scaler(cols: Sequence[str], out: str = "scaled") -> Pipeline:
    """``(x - min) / (max - min)``; a constant column gives 0.5."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(cols), outputCol="__raw"),
        MinMaxScaler(inputCol="__raw", outputCol=out),
    ])


def flatten_vector(df: DataFrame, col: str, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Vector column -> one double column per element (API edge / oracle form)."""
    arr = vector_to_array(F.col(col))
    return df.select(*keep, *[arr[i].alias(n) for i, n in enumerate(names)])


def vector_size(df: DataFrame, col: str) -> int:
    """Vector length from the ML attribute metadata (no job)."""
    meta = df.schema[col].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    return sum(len(v) for v in meta.get("attrs", {}).values())


def category_counts(model: PipelineModel) -> dict[str, int]:
    """Input column -> number of indexes of the fitted string indexers in ``model`` (the extra
    one for unseen values included). Exact, no job: trees need ``maxBins`` of the largest (T-21)."""
    out = {}
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            extra = int(stage.getHandleInvalid() == "keep")
            out.update({c: len(labels) + extra for c, labels in zip(stage.getInputCols(), stage.labelsArray)})
    return out


def check_levels(model: PipelineModel) -> None:
    """E3 pre-check: ``OneHotEncoder`` with ``dropLast`` cannot encode a column with fewer than two
    categories; raises with their names."""
    few = [c for c, n in category_counts(model).items() if n < 2]
    if few:
        raise ValueError(f"columns with fewer than two categories cannot be one-hot encoded: {few}")


# E10 ---------------------------------------------------------------------------
def log_label(label: str) -> Column:
    """``ln(label)`` of positive labels, NULL otherwise."""
    c = F.col(label)
    return F.when(c > 0, F.log(c))


class LogTargetRegressor(Estimator, Persistable):
    """Fits ``pipeline`` (features and a regressor on ``log_label``) on the logarithm of ``labelCol``
    and predicts in the label's own unit. Rows without a positive label are left out of the fit;
    ``LogTargetModel.n_left_out`` counts them. Scoring needs no label."""

    labelCol = str_param("labelCol", "label column")

    def __init__(self, pipeline: Pipeline | None = None, labelCol: str = "price"):
        super().__init__()
        self.pipeline = pipeline
        self._set(labelCol=labelCol)

    def copy(self, extra=None):
        that = super().copy(extra)
        that.pipeline = self.pipeline
        return that

    def _fit(self, df: DataFrame) -> "LogTargetModel":
        logged = df.withColumn(LOG_LABEL, log_label(self.getOrDefault(self.labelCol)))
        n_in, n_used = logged.agg(F.count(F.lit(1)), F.count(LOG_LABEL)).first()
        model = LogTargetModel(self.pipeline.fit(logged.filter(F.col(LOG_LABEL).isNotNull())))
        model._set(leftOut=int(n_in - n_used))
        return model


LOG_LABEL = "log_label"


class _InnerWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.inner.write().overwrite().save(f"{path.rstrip('/')}/inner")


class _InnerReader(DefaultParamsReader):
    def load(self, path: str) -> "LogTargetModel":
        model = super().load(path)
        model.inner = PipelineModel.load(f"{path.rstrip('/')}/inner")
        return model


class LogTargetModel(Model, Persistable):
    """The fitted pipeline, its prediction as ``log_prediction`` and ``exp`` of that as ``prediction``."""

    leftOut = int_param("leftOut", "training rows without a positive label")

    def __init__(self, inner: PipelineModel | None = None):
        super().__init__()
        self._setDefault(leftOut=0)
        self.inner = inner

    def copy(self, extra=None):
        that = super().copy(extra)
        that.inner = self.inner
        return that

    @property
    def n_left_out(self) -> int:
        return self.getOrDefault(self.leftOut)

    def write(self) -> _InnerWriter:
        return _InnerWriter(self)

    @classmethod
    def read(cls) -> _InnerReader:
        return _InnerReader(cls)

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.inner.transform(df).withColumnRenamed("prediction", "log_prediction")
        return out.withColumn("prediction", F.exp("log_prediction"))


def log_target(feature_stages: Sequence, regressor, label: str) -> LogTargetRegressor:
    """``feature_stages`` and ``regressor`` on ``ln(label)``, predictions in the label's unit."""
    return LogTargetRegressor(Pipeline(stages=[*feature_stages, regressor.copy().setLabelCol(LOG_LABEL)]), label)
