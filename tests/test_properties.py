"""Property tests (hypothesis) for the invariants of SURVEY section 5.2."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import clean, evaluate, impute, prefix, profile, split

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

sizes = st.one_of(st.none(), st.floats(-2, 5, allow_nan=False), st.just(0.0))


@SETTINGS
@given(st.lists(st.tuples(sizes, sizes, sizes), min_size=1, max_size=40))
def test_valid_split_partitions_input(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, x double, y double, z double")
    good, bad = clean.split_valid(df, clean.valid_rule(["x", "y", "z"]))
    g = {r.id for r in good.collect()}
    b = {r.id for r in bad.collect()}
    assert g.isdisjoint(b) and g | b == set(range(len(rows)))
    for r in good.collect():
        assert r.x > 0 and r.y > 0 and r.z > 0
    c = clean.validity_counts(df, clean.valid_rule(["x", "y", "z"])).first()
    assert c.n_rows == c.n_good + c.n_bad == len(rows)


@SETTINGS
@given(st.integers(1, 400), st.integers(1, 7))
def test_hash_split_disjoint_covering_and_partition_independent(spark, n, parts):
    df = spark.range(n).withColumnRenamed("id", "k")
    a = split.hash_split(df, "k", split.TRAIN_VAL_TEST)
    b = split.hash_split(df.repartition(parts), "k", split.TRAIN_VAL_TEST)
    seen = set()
    for name in a:
        ka = {r.k for r in a[name].collect()}
        kb = {r.k for r in b[name].collect()}
        assert ka == kb
        assert seen.isdisjoint(ka)
        seen |= ka
    assert seen == set(range(n))


def test_random_split_depends_on_partitioning(spark):
    """Trap T-17: the reference's randomSplit is not partitioning-invariant."""
    df = spark.range(2000)
    a = {r.id for r in split.random_split(df.repartition(3), [0.6, 0.4])[0].collect()}
    b = {r.id for r in split.random_split(df.repartition(7), [0.6, 0.4])[0].collect()}
    assert a != b


cats = st.one_of(st.none(), st.sampled_from(["a", "b", "c", "d"]))


@SETTINGS
@given(st.lists(st.tuples(cats, cats), min_size=1, max_size=40))
def test_mode_imputer_fills_only_missing(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, u string, v string")
    if any(all(r[j] is None for r in rows) for j in (0, 1)):
        with pytest.raises(impute.NoModeError):  # nothing to fill with
            impute.ModeImputer(inputCols=["u", "v"]).fit(df)
        return
    out = impute.ModeImputer(inputCols=["u", "v"]).fit(df).transform(df)
    got = {r.id: r for r in out.collect()}
    for i, (u, v) in enumerate(rows):
        if u is not None:
            assert got[i].u == u
        if v is not None:
            assert got[i].v == v
    for c, vals in (("u", [r[0] for r in rows]), ("v", [r[1] for r in rows])):
        if any(x is not None for x in vals):
            assert all(getattr(r, c) is not None for r in got.values())


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(-5, 5)), min_size=2, max_size=60))
def test_auc_matches_pair_count_and_invariants(spark, rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    df = spark.createDataFrame([(float(y), float(s)) for y, s in rows], "label double, score double")
    got = evaluate.auc_roc(df, "label", "score").first().auc
    if not pos or not neg:
        assert got is None
        return
    brute = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert math.isclose(got, brute, abs_tol=1e-12)
    mono = evaluate.auc_roc(df.withColumn("score", F.exp(F.col("score") / 3)), "label", "score").first().auc
    assert math.isclose(mono, got, abs_tol=1e-12)
    neg_auc = evaluate.auc_roc(df.withColumn("score", -F.col("score")), "label", "score").first().auc
    assert math.isclose(neg_auc, 1 - got, abs_tol=1e-12)


@SETTINGS
@given(st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=1, max_size=80))
def test_exact_quantiles_equal_numpy_linear(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    r = profile.exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.9, 1.0]).first()
    want = np.percentile(np.array(xs), [0, 25, 50, 90, 100], method="linear")
    for j, w in enumerate(want):
        assert math.isclose(r[f"q{j}"], w, rel_tol=1e-9, abs_tol=1e-9)


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["g1", "g2"]), st.integers(-50, 50), st.integers(0, 9)),
                min_size=1, max_size=60, unique_by=lambda t: (t[0], t[1])))
def test_prefix_sums_equal_bruteforce(spark, rows):
    df = spark.createDataFrame(rows, "g string, k int, w int").withColumn("w", F.col("w").cast("bigint"))
    ranked = prefix.prefix_sums(df, "k", ["w"], ["g"], ranges=4)
    got = {(r.g, r.k): r.w_before for r in ranked.collect()}
    glob = {r.k: r.w_before for r in prefix.prefix_sums(df.filter("g = 'g1'"), "k", ["w"], ranges=8).collect()}
    single = {r.k: r.w_before for r in prefix.prefix_sums(df.filter("g = 'g1'"), "k", ["w"], ranges=1).collect()}
    for k, before in glob.items():
        assert before == got[("g1", k)] == single[k]
    for g, k, _ in rows:
        assert got[(g, k)] == sum(w for g2, k2, w in rows if g2 == g and k2 < k)


def test_weighted_recall_equals_accuracy(spark):
    rows = [(float(i % 3), float((i * 7) % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "label double, prediction double")
    r = evaluate.classification_report(df, score=None).first()
    assert math.isclose(r.weighted_recall, r.accuracy, abs_tol=1e-12)
