"""The filter audit's keyed state: batches in any order, retraction, what the state holds."""

import os
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.llm import filter_audit

ROWS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])


def _files(folder, chunks, at=0):
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(chunks):
        path = f"{folder}/part-{at + i:03d}.parquet"
        pq.write_table(pa.Table.from_pylist([dict(zip(ROWS.names, r)) for r in rows], ROWS), path)
        os.utime(path, (1_700_000_000 + at + i,) * 2)  # the order in which they are taken


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _mask(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    return (len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words)) + 4 * (
        100 * capitals > 10 * len(text)) + 8 * bool(re.search(r"[#$%&*|]", text))


def _brute(rows, labels):
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({r[0] for r in labels if r[k] == 1} for k in (1, 2))
    n, g, x = Counter(), Counter(), Counter()
    for i, lang, t in rows:
        kind = (lang or "", _mask(t or "") | (16 if i is not None and i > least[t or ""] else 0))
        n[kind] += 1
        g[kind] += i in good
        x[kind] += i in toxic
    return {(*k, n[k], g[k], x[k]) for k in n}


def _got(counters):
    return {(r["part"], r["mask"], r["n"], r["good"], r["toxic"]) for r in counters.collect()}


@pytest.mark.parametrize("files_per_batch", [2, 5])
def test_counters_of_batches_are_those_of_all_rows(spark, tmp_path, files_per_batch):
    rnd = random.Random(files_per_batch)
    texts = [None, "", "One two", "UPPER #", " ".join(f"w{i}" for i in range(120)), "again " * 150]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(["en", "de", None]), rnd.choice(texts)) for _ in range(120)]
    rows.sort(key=lambda r: -(r[0] or 0) + rnd.randint(-4, 4))  # smaller ids come later
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in [*range(0, 40, 2), 2, 4]]
    docs, folder = str(tmp_path / "docs"), str(tmp_path / "state")
    _files(docs, [rows[i : i + 15] for i in range(0, 90, 15)])
    first = filter_audit.part_counters(spark, docs, _labels(spark, labels), folder, files_per_batch)
    assert _got(first) == _brute(rows[:90], labels)
    _files(docs, [rows[90:105], rows[105:]], 6)
    again = filter_audit.part_counters(spark, docs, _labels(spark, labels), folder, files_per_batch)
    assert _got(again) == _brute(rows, labels)


def test_state_is_a_table_of_smallest_ids(spark, tmp_path):
    """One row for each text, however many copies: no call, and no store of a partition, for each of them."""
    docs, folder = str(tmp_path / "docs"), str(tmp_path / "state")
    chunks = [[(i, "en", "copied") for i in range(50, 90)] + [(100 + i, "en", f"own {i}") for i in range(20)],
              [(i, "en", "copied") for i in range(30, 50)], [(i, "en", "copied") for i in range(200, 240)]]
    _files(docs, chunks)
    counters = filter_audit.part_counters(spark, docs, _labels(spark, []), folder, 1)
    assert _got(counters) == _brute(sum(chunks, []), [])
    held = spark.read.parquet(f"{folder}/held").groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in held} == {0: 21, 1: 1}
    assert not os.path.exists(f"{folder}/checkpoint/state")


def test_batches_of_many_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filter_audit, "FILES_PER_CORE", 1)
    docs, folder = str(tmp_path / "docs"), str(tmp_path / "state")
    n = 9 * spark.sparkContext.defaultParallelism
    _files(docs, [[(n - i, "en", "same")] for i in range(n)])
    counters = filter_audit.part_counters(spark, docs, _labels(spark, []), folder)
    assert _got(counters) == {("en", 1, 1, 0, 0), ("en", 17, n - 1, 0, 0)}
    assert len(os.listdir(f"{folder}/checkpoint/commits")) // 2 <= filter_audit.MAX_BATCHES
