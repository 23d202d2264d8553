"""Small base for the library's own ML stages.

Stages keep all fitted state in JSON-typed params, so the default
``DefaultParamsWriter`` persists them and a ``Pipeline``/``PipelineModel``
containing them saves and loads on any Hadoop URI (S8).
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable


def str_param(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=TypeConverters.toString)


def list_param(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=TypeConverters.toListString)


def int_param(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=TypeConverters.toInt)


class Persistable(DefaultParamsReadable, DefaultParamsWritable):
    """Mixin: default params persistence plus JSON helpers for state params."""

    def _set_json(self, param: Param, value: Any) -> None:
        self._set(**{param.name: json.dumps(value, sort_keys=True)})

    def _get_json(self, param: Param, default: Any = None) -> Any:
        if not self.isDefined(param):
            return default
        return json.loads(self.getOrDefault(param))
