import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert {"r2", "rmse", "mae", "n_in", "n_scored"} <= set(df.columns)
    assert rows[0]["n_scored"] == rows[0]["n_in"] > 0


def test_query_names_are_unique_and_callable():
    qs = E.queries()
    assert len(qs) >= 40
    assert all(callable(f) for f in qs.values())
    assert set(E.oracle_sql()) <= set(qs)


def test_entry_works_without_the_training_data_modules(monkeypatch):
    import sys

    for name in ("tessera.llm", "tessera.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    left = E.queries()
    assert len(left) >= 40 and not any(n.startswith("op") or n == "pipeline" for n in left)
