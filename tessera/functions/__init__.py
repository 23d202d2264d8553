"""Column-level helpers (typed selectors, predicates, scalar expressions)."""

from tessera.functions.columns import (
    DEFAULT_SENTINELS,
    is_float_type,
    is_missing,
    md5_bucket,
    numeric_cols,
    percent,
    safe_corr,
    select_rename,
    string_cols,
)

__all__ = [
    "DEFAULT_SENTINELS",
    "is_float_type",
    "is_missing",
    "md5_bucket",
    "numeric_cols",
    "percent",
    "safe_corr",
    "select_rename",
    "string_cols",
]
