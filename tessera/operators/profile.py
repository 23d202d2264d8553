"""Profiling: counts, missing values, summary statistics, correlation,
functional dependencies, class balance, modes and top-k categories (A1-A15).

Every profile is **one** aggregation job over the table (the reference ran one
job per column and per metric); long-form results are produced with
``unpivot`` on the one-row aggregate, not by re-scanning the input.
"""

from __future__ import annotations

from collections.abc import Sequence

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import is_missing, named, numeric_cols, percent, safe_corr
from tessera.sources.files import literal_rows


def _long(wide: DataFrame, columns: Sequence[str], rows: Sequence[Sequence[Column]]) -> DataFrame:
    """One row for each of ``rows`` from a one-row aggregate."""
    structs = [F.struct(*[c.alias(n) for n, c in zip(columns, r)]) for r in rows]
    return wide.select(F.inline(F.array(*structs)))


# A2 / A3 --------------------------------------------------------------------
def group_count(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per key combination (partial + final hash aggregate)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


# A4 / O1 --------------------------------------------------------------------
def distinct_values(df: DataFrame, cols: Sequence[str], sort: bool = True) -> DataFrame:
    out = df.select(*cols).distinct()
    return out.orderBy(*[F.asc_nulls_first(c) for c in cols]) if sort else out


# A5 -------------------------------------------------------------------------
def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row, one ``count_if(col IS NULL)`` per column, one pass."""
    cols = list(cols or df.columns)
    return df.agg(*[F.count_if(named(c).isNull()).cast("bigint").alias(c) for c in cols])


# A6 / A7 --------------------------------------------------------------------
def missing_profile(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    sentinels: Sequence[str] | None = ("?", ""),
    only_missing: bool = False,
) -> DataFrame:
    """``(column, n_missing, pct)`` for every column in one aggregation.

    Missing = NULL, NaN for float columns, or (strings) a sentinel after trim.
    """
    cols = list(cols or df.columns)
    wide = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(is_missing(df, c, sentinels)).cast("bigint").alias(f"m{i}") for i, c in enumerate(cols)],
    )
    out = _long(wide, ["column", "n_missing", "pct"],
                [[F.lit(c), F.col(f"m{i}"), percent(f"m{i}", "__n")] for i, c in enumerate(cols)])
    return out.filter(F.col("n_missing") > 0) if only_missing else out


def total_missing(df: DataFrame, cols: Sequence[str] | None = None) -> int:
    """Total missing cells (NULL or NaN), one job; 0 means clean."""
    cols = list(cols or df.columns)
    expr = sum((F.count_if(is_missing(df, c, None)) for c in cols), F.lit(0))
    return int(df.agg(expr.alias("n")).first()["n"])


def missing_examples(df: DataFrame, col: str, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by ``key`` where ``col`` is missing."""
    return df.filter(is_missing(df, col, None)).orderBy(named(key)).limit(n)


class MissingCellsError(ValueError):
    """Cells that should have been filled or dropped are still missing."""


def assert_no_missing(df: DataFrame, cols: Sequence[str] | None = None, what: str = "table") -> DataFrame:
    """``df``, after one job that has found no missing cell in ``cols``."""
    n = total_missing(df, cols)
    if n:
        raise MissingCellsError(f"{n} missing cells remain in {what}")
    return df


# A8 -------------------------------------------------------------------------
def summary_approx(df: DataFrame, *stats: str) -> DataFrame:
    """Spark's ``summary()`` (approximate percentiles, one pass)."""
    return df.summary(*stats)


def _value(col: str) -> Column:
    """The column as double; NaN is missing (T-11)."""
    c = named(col).cast("double")
    return F.when(~F.isnan(c), c)


#: Relative error of the quantile sketch, and so many distinct values are ranked exactly at once.
SKETCH_ACCURACY = 10_000
RANKED_VALUES = 100_000


def _brackets(df: DataFrame, wanted: list[tuple[str, float, Column]], extra: Sequence[Column] = ()):
    """Sketch quantiles a little below and above the fractions of some values, in one aggregate."""
    eps = 2.0 / SKETCH_ACCURACY
    sketches = [F.percentile_approx(v, [max(0.0, f - eps), min(1.0, f + eps)], SKETCH_ACCURACY).alias(f"b{i}")
                for i, (_, f, v) in enumerate(wanted)]
    row = df.agg(*extra, *sketches).first()
    out = []
    for i, (_, f, _) in enumerate(wanted):
        lo, hi = row[f"b{i}"] or (None, None)
        out.append((-math.inf if f - eps <= 0 else lo, math.inf if f + eps >= 1 else hi))
    return row, out


def _select(df: DataFrame, counts: dict[str, int], targets: list[tuple[str, float]], first: list[tuple]) -> list:
    """Exact quantiles by narrowing: of each target only the values between two bounds around
    its rank are looked at, and those bounds are drawn closer until few distinct values are left.
    Every round is one aggregate over the columns; the driver gets some numbers for each target."""
    found: list = [None] * len(targets)
    open_ = {i: first[i] for i, (c, _) in enumerate(targets) if counts[c]}
    ranks = {i: (math.floor((counts[c] - 1) * p), math.ceil((counts[c] - 1) * p))
             for i, (c, p) in enumerate(targets)}
    whole = (-math.inf, math.inf)
    while open_:
        aggs = []
        for i, (lo, hi) in open_.items():
            v = _value(targets[i][0])
            inside = F.when((v >= lo) & (v <= hi), v)
            aggs += [F.count_if(v < lo).alias(f"below{i}"), F.count(inside).alias(f"in{i}"),
                     F.approx_count_distinct(inside).alias(f"d{i}")]
        row = df.agg(*aggs).first()
        last, narrow = [], []
        for i, (lo, hi) in open_.items():
            below, n = row[f"below{i}"], row[f"in{i}"]
            a, b = ranks[i][0] - below, ranks[i][1] - below
            if a < 0 or b >= n:
                narrow.append((i, whole, None))  # the sketch was off: from the start again, all values
            elif lo == hi:
                found[i] = lo
            elif row[f"d{i}"] <= RANKED_VALUES or (lo, hi) == whole:
                last.append((i, a / max(1, n - 1), b / max(1, n - 1)))
            else:
                narrow.append((i, (lo, hi), a / max(1, n - 1)))
        if last:
            picks = []
            for i, a, b in last:
                v = _value(targets[i][0])
                inside = F.when((v >= open_[i][0]) & (v <= open_[i][1]), v)
                picks.append(F.percentile(inside, F.array(F.lit(a), F.lit(b))).alias(f"q{i}"))
            row = df.agg(*picks).first()
            for i, _, _ in last:
                c, p = targets[i]
                h = (counts[c] - 1) * p
                lo, hi = row[f"q{i}"]
                found[i] = lo + (h - math.floor(h)) * (hi - lo) if hi != lo else lo
        following = {i: bounds for i, bounds, f in narrow if f is None}
        again = [(i, bounds, f) for i, bounds, f in narrow if f is not None]
        if again:
            wanted = []
            for i, (lo, hi), f in again:
                v = _value(targets[i][0])
                wanted.append((targets[i][0], f, F.when((v >= lo) & (v <= hi), v)))
            _, new = _brackets(df, wanted)
            for (i, old, _), (lo, hi) in zip(again, new):
                bounds = (max(old[0], lo), min(old[1], hi))
                following[i] = bounds if bounds != old else whole
        open_ = following
    return found


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    names: Sequence[str] | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles (same definition as SQL
    ``percentile`` / ``quantile_cont``) without sorting or gathering a column: a sketch
    brackets each rank, and only the values in the bracket are ranked.
    Result: ``(column, <name_0>, <name_1>, ...)``, one row per column (NULLs for one without values).
    """
    cols, probs = list(cols), [float(p) for p in probs]
    names = list(names or [f"q{j}" for j in range(len(probs))])
    values, _ = _quantiles(df, cols, probs)
    rows = [[c, *values[c]] for c in cols]
    return literal_rows(df.sparkSession, rows, ", ".join(["column string"] + [f"`{n}` double" for n in names]))


def _quantiles(df: DataFrame, cols: list[str], probs: list[float], extra: Sequence[Column] = ()):
    """``{column: quantiles}`` and the row of ``extra`` aggregates, which share the first pass."""
    targets = [(c, p) for c in cols for p in probs]
    counting = [F.count(_value(c)).alias(f"n{i}") for i, c in enumerate(cols)]
    row, first = _brackets(df, [(c, p, _value(c)) for c, p in targets], [*counting, *extra])
    counts = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    found = _select(df, counts, targets, first)
    return {c: found[i * len(probs):(i + 1) * len(probs)] for i, c in enumerate(cols)}, row


def summary_exact(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column, n, mean, stddev, min, p25, p50, p75, max)`` per numeric column,
    with exact quantiles (oracle-checkable form of ``summary()``).

    Count, mean, deviation and extremes are one direct aggregate, which also brackets the
    quantiles; two more passes select those. NaN is missing; a column without values has
    a row with n = 0.
    """
    cols = list(cols or numeric_cols(df))
    extra = []
    for i, c in enumerate(cols):
        v = _value(c)
        extra += [F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"), F.min(v).alias(f"min{i}"),
                  F.max(v).alias(f"max{i}")]
    values, row = _quantiles(df, cols, [0.25, 0.5, 0.75], extra)
    rows = [[c, row[f"n{i}"], row[f"mean{i}"], row[f"std{i}"], row[f"min{i}"], *values[c], row[f"max{i}"]]
            for i, c in enumerate(cols)]
    return literal_rows(df.sparkSession, rows, "column string, n bigint, mean double, stddev double, min double, "
                                               "p25 double, p50 double, p75 double, max double")


# A9 / A10 -------------------------------------------------------------------
def correlations(df: DataFrame, anchor: str, cols: Sequence[str]) -> DataFrame:
    """``(col_a, col_b, corr)`` for ``anchor`` against every column, one pass.
    A constant column gives NULL instead of an ANSI division error."""
    cols = list(cols)
    wide = df.agg(*[safe_corr(anchor, c).alias(f"c{i}") for i, c in enumerate(cols)])
    return _long(wide, ["col_a", "col_b", "corr"], [[F.lit(anchor), F.lit(c), F.col(f"c{i}")]
                                                    for i, c in enumerate(cols)])


def drop_correlated(df: DataFrame, anchor: str, cols: Sequence[str], threshold: float = 0.95):
    """Drop columns whose |corr| with ``anchor`` exceeds ``threshold``.
    Returns ``(df_without, dropped_names)``; only ``len(cols)`` numbers reach the driver."""
    rows = correlations(df, anchor, cols).collect()
    dropped = [r["col_b"] for r in rows if r["corr"] is not None and abs(r["corr"]) > threshold]
    return df.drop(*dropped), dropped


# A11 ------------------------------------------------------------------------
def functional_dependency(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: is ``a -> b`` and ``b -> a`` a function?

    Two aggregates over the distinct pairs; no pair list reaches the driver."""
    pairs = df.select(a, b).distinct()
    per_a = pairs.groupBy(a).agg(F.count(F.lit(1)).alias("k")).select(F.lit("ab").alias("side"), "k")
    per_b = pairs.groupBy(b).agg(F.count(F.lit(1)).alias("k")).select(F.lit("ba").alias("side"), "k")
    side_ab, side_ba = F.col("side") == "ab", F.col("side") == "ba"
    out = per_a.unionByName(per_b).agg(
        F.sum(F.when(side_ab, F.col("k"))).cast("bigint").alias("n_pairs"),
        F.max(F.when(side_ab, F.col("k"))).cast("bigint").alias("max_b_per_a"),
        F.max(F.when(side_ba, F.col("k"))).cast("bigint").alias("max_a_per_b"),
    )
    return out.select(
        "n_pairs",
        "max_b_per_a",
        "max_a_per_b",
        (F.col("max_b_per_a") <= 1).alias("a_determines_b"),
        (F.col("max_a_per_b") <= 1).alias("b_determines_a"),
    )


# A12 ------------------------------------------------------------------------
def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, pct)``; the share uses a window over the (tiny) per-class table."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(label, "n", percent(F.col("n"), total).alias("pct"))


# A13 ------------------------------------------------------------------------
def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent non-NULL value per column: ``(column, value, n)``.

    Ties go to the smallest value (trap T-6); NULL is never a mode (T-7).
    A column without values has the mode NULL, n = 0. Two hash aggregates
    (map-side partial), no sort and no window.
    """
    cols = list(cols)
    wide = df.select(*[named(c).cast("string").alias(c) for c in cols])
    long = wide.unpivot([], [named(c) for c in cols], "column", "value")
    vc = long.groupBy("column", "value").agg(F.count("value").alias("n"))  # NULL counts nothing
    best = vc.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value"))).alias("b"))
    return best.select("column", F.col("b.value").alias("value"), (-F.col("b.neg_n")).alias("n"))


def mode_values(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Column -> mode; one small row per column reaches the driver."""
    return {r["column"]: r["value"] for r in modes(df, cols).collect()}


# A14 ------------------------------------------------------------------------
def top_categories(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """``(value, n)`` of the ``k`` most frequent values, ties by value."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_first(col)).limit(int(k))

