"""Feature importance.

Names come from the ML attribute metadata of the features vector (binary,
numeric and nominal groups), which works for one-hot, indexed and raw inputs
alike; the source column of each vector slot is followed through the fitted
stages, not guessed from names. The importance vector has one entry per feature,
so it is small and is turned into a DataFrame; folding and ranking are Spark
expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoderModel, StandardScalerModel, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import literal_rows


def feature_names(df: DataFrame, features: str = "features") -> list[str]:
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    flat = [a for group in ("binary", "numeric", "nominal") for a in attrs.get(group, [])]
    flat.sort(key=lambda a: a["idx"])
    return [a.get("name", f"f{a['idx']}") for a in flat]


def feature_sources(prep: PipelineModel, features: str = "features") -> list[str]:
    """The input column behind every slot of the features vector of a fitted pipeline."""
    slots: dict[str, list[str]] = {}
    for stage in prep.stages:
        if isinstance(stage, StringIndexerModel):
            slots.update({o: slots.get(i, [i]) for i, o in zip(stage.getInputCols(), stage.getOutputCols())})
        elif isinstance(stage, OneHotEncoderModel):
            dropped = int(stage.getDropLast()) - int(stage.getHandleInvalid() == "keep")
            slots.update({o: slots.get(i, [i]) * (n - dropped)
                          for i, o, n in zip(stage.getInputCols(), stage.getOutputCols(), stage.categorySizes)})
        elif isinstance(stage, VectorAssembler):
            slots[stage.getOutputCol()] = [s for c in stage.getInputCols() for s in slots.get(c, [c])]
        elif isinstance(stage, StandardScalerModel):
            slots[stage.getOutputCol()] = slots[stage.getInputCol()]
    return slots[features]


def importance(spark: SparkSession, model, names: Sequence[str], sources: Sequence[str] | None = None) -> DataFrame:
    """``(feature, source, importance)`` for a tree model (``featureImportances``) or a
    linear model (``|coefficients|``)."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray().tolist()
    else:
        values = [abs(v) for v in model.coefficients.toArray().tolist()]
    sources = list(names if sources is None else sources)
    if not len(values) == len(names) == len(sources):
        raise ValueError(f"{len(values)} importances for {len(names)} names and {len(sources)} sources")
    return literal_rows(spark, list(zip(names, sources, [float(v) for v in values])),
                        "feature string, source string, importance double")


def fold_importance(imp: DataFrame) -> DataFrame:
    """Importances summed over the slots of a source column, the largest first."""
    return (
        imp.groupBy(F.col("source").alias("feature"))
        .agg(F.sum("importance").alias("importance"))
        .orderBy(F.desc("importance"), F.asc("feature"))
    )


def top_features(imp: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` largest of the unfolded importances."""
    return imp.orderBy(F.desc("importance"), F.asc("feature")).limit(int(n))
