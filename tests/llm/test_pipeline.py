"""The corpus pipeline against the stages' plain meaning, and without its near relatives."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from test_methods import _brute_components
from tessera.llm import queries


def test_stages_keep_columns_and_take_effect(spark):
    docs = queries.table(spark, SF_SMALL, "documents")
    clashing = ["accepted", "language", "means", "n_words", "items", "contaminated", "hit_spans", "node", "id", "_text", "a.b"]
    for c in clashing:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")))
    columns = docs.columns
    benchmark = queries.table(spark, SF_SMALL, "benchmark")
    junk = [(10**6, "жзш" * 300, "en", "s", 900), (10**6 + 1, None, "en", "s", 0),
            (10**6 + 2, benchmark.first().text, "en", "s", 1)]
    junk = [(*r, *["extra"] * len(clashing)) for r in junk]
    docs = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            before, kept[name] = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
            assert all(before[d] == r for d, r in kept[name].items())  # nothing but rows goes
            gone = set(before) - set(kept[name])
            if name == "language":
                assert {10**6, 10**6 + 1} <= gone and len(gone) <= 4
            if name == "near_duplicates":
                want = _brute_components([(d, r.text) for d, r in before.items()])
                assert gone == {d for d, (_, c) in want.items() if c != d}
            if name == "decontaminated":
                assert 10**6 + 2 in gone
        docs = out
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(kept["decontaminated"])
    assert all(r["ids"] and r.sample in (1, 2) for r in rows)


def test_near_duplicates_at_five_words_and_four_fifths(spark):
    """Against brute force, with pairs between that limit and the one of op4 (4 words, 0.85)."""
    rnd = random.Random(5)
    texts = []
    for n in [*range(44, 56), 100, 150]:
        words = [f"w{rnd.randrange(5000)}" for _ in range(n)]
        texts += [words, [*words[:n // 2], "edit", *words[n // 2 + 1:]]]
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    assert all(len(sets[i] & sets[j]) == 0 for i in range(len(texts)) for j in range(i) if i // 2 != j // 2)
    gone = {i + 1 for i in range(0, len(texts), 2) if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    out = corpus_pipeline.near_duplicates(spark, df, SF_SMALL)
    assert set(range(len(texts))) - {r.doc_id for r in out.collect()} == gone
    four = [{tuple(t[i:i + 4]) for i in range(len(t) - 3)} for t in texts]
    assert any(100 * len(four[i] & four[i - 1]) < 85 * len(four[i] | four[i - 1]) for i in gone)


def test_one_row_of_each_group_stays(spark):
    """Repeated rows, null ids, and a text of its own under the id of a near copy."""
    rnd = random.Random(6)
    a, b, c, d, e = ([f"w{rnd.randrange(5000)}" for _ in range(80)] for _ in range(5))
    near = lambda t: [*t[:40], "edit", *t[41:]]
    rows = [(3, a, "x"), (5, near(a), "x"), (5, b, "x"), (7, c, "x"), (7, c, "x"), (7, c, "x"), (None, c, "x"),
            (None, d, "x"), (None, d, "x"), (None, near(d), "x"), (9, e, "x"), (9, e, "y"), (9, near(e), "x"),
            (None, [], "x"), (11, [], "x")]
    df = spark.createDataFrame([(i, " ".join(t), s) for i, t, s in rows], "doc_id bigint, text string, source string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df.repartition(5), SF_SMALL).collect()]
    want = [(3, a), (5, b), (7, c), (None, []), (11, [])]
    for i, t in want:
        assert got.count((i, " ".join(t))) == 1
    assert sum(i is None and t != "" for i, t in got) == 1 and sum(i == 9 for i, t in got) == 1
    assert len(got) == len(want) + 2
    again = corpus_pipeline.near_duplicates(spark, df.repartition(2), SF_SMALL)
    assert sorted(got, key=str) == sorted([(r.doc_id, r.text) for r in again.collect()], key=str)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert {"doc_id", "sample", "ids", "log_prob", "log_inclusion"} <= set(out.columns) and out.count() > 100


def test_nothing_in_the_library_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent / "tessera"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) tessera\.llm", path.read_text(), re.M), path


def test_only_rows_that_may_go_are_looked_up(spark):
    """The lookup of what goes takes the rows that a bitmap lets through, not all documents."""
    rows = spark.range(20000).select("id", F.xxhash64("id").alias("row")).union(
        spark.createDataFrame([(None, 5), (None, 6)], "id bigint, row bigint"))
    keys = rows.filter("id % 50 = 0 OR row = 5")
    marked = corpus_pipeline._marked(rows, keys)
    assert marked.columns == ["id", "row", "maybe"] and marked.count() == 20002
    assert marked.filter("maybe AND (id % 50 = 0 OR row = 5)").count() == keys.count()
    assert marked.filter("maybe").count() < 4000
    assert not corpus_pipeline._marked(rows, keys.limit(0)).filter("maybe").count()
