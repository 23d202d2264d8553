"""Cleaning: trim, labels, sentinels, dropping missing rows, validity splits,
constant fills and cardinality masks (C1-C4, C8-C11).

Each operator is a DataFrame function; the ones used inside model pipelines
are also ML stages, so cleaning is fitted/applied the same way on every split
(trap T-3) and persists with the pipeline.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import DEFAULT_SENTINELS, is_missing, string_cols
from tessera.operators.profile import assert_no_missing, top_categories
from tessera.operators.stages import Persistable, int_param, list_param, str_param


# C1 -------------------------------------------------------------------------
def trim_strings(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Trim every (or the given) string column, one projection."""
    todo = set(cols if cols is not None else string_cols(df))
    return df.select([F.trim(F.col(c)).alias(c) if c in todo else F.col(c) for c in df.columns])


# C2 -------------------------------------------------------------------------
def label_expr(col: str, positive: str, how: str = "equals") -> Column:
    """1 if the text matches ``positive`` (equality, or substring for
    ``how="contains"``), 0 otherwise; a NULL text stays a NULL label."""
    c = F.col(col)
    hit = c.contains(positive) if how == "contains" else (c == F.lit(positive))
    return F.when(c.isNull(), F.lit(None).cast("int")).when(hit, F.lit(1)).otherwise(F.lit(0))


def binary_label(
    df: DataFrame, col: str, positive: str, out: str = "label", how: str = "equals", drop_source: bool = True
) -> DataFrame:
    df = df.withColumn(out, label_expr(col, positive, how))
    return df.drop(col) if drop_source and col != out else df


# C3 -------------------------------------------------------------------------
def sentinel_to_null(
    df: DataFrame, cols: Sequence[str] | None = None, sentinels: Sequence[str] = DEFAULT_SENTINELS
) -> DataFrame:
    """String cells whose trimmed text is a sentinel become NULL; other values are kept as they are."""
    todo = set(cols if cols is not None else string_cols(df))
    sent = list(sentinels)
    return df.select(
        [
            F.when(F.trim(F.col(c)).isin(sent), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
            if c in todo
            else F.col(c)
            for c in df.columns
        ]
    )


# C4 -------------------------------------------------------------------------
def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL (or NaN, in float columns) in any of ``cols``."""
    return df.na.drop(how="any", subset=list(cols) if cols else None)


def drop_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(n_in, n_out, n_dropped)`` of ``drop_missing``, in one aggregate."""
    missing = None
    for c in cols or df.columns:
        m = is_missing(df, c, None)
        missing = m if missing is None else missing | m
    n_in, n_dropped = F.count(F.lit(1)), F.count_if(missing).cast("bigint")
    return df.agg(n_in.alias("n_in"), (n_in - n_dropped).alias("n_out"), n_dropped.alias("n_dropped"))


def drop_missing_verified(df: DataFrame, cols: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """C4: the complete rows, verified (an error if any cell is still missing), and the drop's counts."""
    counts = drop_counts(df, cols).first().asDict()
    return assert_no_missing(drop_missing(df, cols), cols, "the rows that are kept"), counts


# C8 / C9 --------------------------------------------------------------------
def valid_rule(cols: Sequence[str]) -> Column:
    """Rule of the size columns: every one strictly positive."""
    cond = None
    for c in cols:
        cond = (F.col(c) > 0) if cond is None else (cond & (F.col(c) > 0))
    return cond


def split_valid(df: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad) with ``bad := NOT coalesce(rule, false)``: NULL and
    negative values land in ``bad``, so the two parts always partition the
    input (trap T-5)."""
    ok = F.coalesce(rule, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def validity_counts(df: DataFrame, rule: Column) -> DataFrame:
    """One pass: ``(n_rows, n_good, n_bad)``; n_good + n_bad = n_rows by construction."""
    ok = F.coalesce(rule, F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(ok).cast("bigint").alias("n_good"),
        F.count_if(~ok).cast("bigint").alias("n_bad"),
    )


def split_valid_checked(df: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(good, bad, counts); an error if the parts' rows do not add up to the input's."""
    r = validity_counts(df, rule).first().asDict()
    good, bad = split_valid(df, rule)
    if r["n_rows"] != r["n_good"] + r["n_bad"]:
        raise AssertionError(f"rows lost by the validity split: {r}")
    return good, bad, r


# C10 ------------------------------------------------------------------------
def fill_unknown(df: DataFrame, cols: Sequence[str] | None = None, value: str = "Unknown") -> DataFrame:
    cols = list(cols if cols is not None else string_cols(df))
    return df.na.fill({c: value for c in cols}) if cols else df


# C11 ------------------------------------------------------------------------
def mask_categories(df: DataFrame, col: str, allowed: Sequence[str], other: str = "Other") -> DataFrame:
    """Keep values in ``allowed``; every other value, NULL included, becomes ``other``."""
    c = F.col(col)
    return df.withColumn(col, F.when(c.isin(list(allowed)), c).otherwise(F.lit(other)))


# ML stages --------------------------------------------------------------------
class TrimStrings(Transformer, Persistable):
    inputCols = list_param("inputCols", "string columns to trim (empty: all string columns)")

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None):
        super().__init__()
        self._setDefault(inputCols=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return trim_strings(df, self.getOrDefault(self.inputCols) or None)


class SentinelToNull(Transformer, Persistable):
    inputCols = list_param("inputCols", "string columns (empty: all string columns)")
    sentinels = list_param("sentinels", "texts that mean missing, compared after trim")

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None, sentinels: list[str] | None = None):
        super().__init__()
        self._setDefault(inputCols=[], sentinels=list(DEFAULT_SENTINELS))
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return sentinel_to_null(df, self.getOrDefault(self.inputCols) or None, self.getOrDefault(self.sentinels))


class DropMissing(Transformer, Persistable):
    inputCols = list_param("inputCols", "columns checked (empty: all)")

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None):
        super().__init__()
        self._setDefault(inputCols=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return drop_missing(df, self.getOrDefault(self.inputCols) or None)


class FillConstant(Transformer, Persistable):
    inputCols = list_param("inputCols", "columns to fill (empty: all string columns)")
    value = str_param("value", "fill text")

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None, value: str = "Unknown"):
        super().__init__()
        self._setDefault(inputCols=[], value="Unknown")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return fill_unknown(df, self.getOrDefault(self.inputCols) or None, self.getOrDefault(self.value))


class TopKCategoryMask(Estimator, Persistable):
    """Learn the ``k`` most frequent values of ``inputCol`` (ties by value) and
    map every other value to ``other``. The learned list has at most ``k``
    entries, so it is held in a param."""

    inputCol = str_param("inputCol", "categorical column")
    k = int_param("k", "number of categories kept")
    other = str_param("other", "replacement text")

    @keyword_only
    def __init__(self, inputCol: str | None = None, k: int = 5, other: str = "Other"):
        super().__init__()
        self._setDefault(k=5, other="Other")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "TopKCategoryMaskModel":
        col = self.getOrDefault(self.inputCol)
        top = [r[col] for r in top_categories(df, col, self.getOrDefault(self.k)).collect()]
        m = TopKCategoryMaskModel(inputCol=col, other=self.getOrDefault(self.other))
        m._set_json(m.allowed, [v for v in top if v is not None])
        return m


class TopKCategoryMaskModel(Model, Persistable):
    inputCol = str_param("inputCol", "categorical column")
    other = str_param("other", "replacement text")
    allowed = str_param("allowed", "JSON list of kept values")

    @keyword_only
    def __init__(self, inputCol: str | None = None, other: str = "Other"):
        super().__init__()
        self._setDefault(other="Other", allowed="[]")
        self._set(**self._input_kwargs)

    def allowed_values(self) -> list[str]:
        return self._get_json(self.allowed, [])

    def _transform(self, df: DataFrame) -> DataFrame:
        return mask_categories(df, self.getOrDefault(self.inputCol), self.allowed_values(),
                               self.getOrDefault(self.other))

