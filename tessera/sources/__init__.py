"""Sources and sinks: Parquet tables, CSV, literal rows, saved models."""

from tessera.sources.files import literal_rows, name_columns, preview, read_csv, read_table, write_csv
from tessera.sources.models import load_pipeline, save_model

__all__ = [
    "literal_rows",
    "load_pipeline",
    "name_columns",
    "preview",
    "read_csv",
    "read_table",
    "save_model",
    "write_csv",
]
