"""Model sink (S8): save and load fitted pipelines on any Hadoop URI.

Custom stages of this library are ``DefaultParamsWritable``; their fitted
state is kept in params, so ``PipelineModel.load`` restores them too.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.base import Model


def save_model(model: Model, uri: str) -> str:
    """Overwrite-save a fitted model or pipeline at ``uri``."""
    model.write().overwrite().save(uri)
    return uri


def load_pipeline(uri: str) -> PipelineModel:
    return PipelineModel.load(uri)
