"""Removal of repeated strings against a table of all windows."""

import hashlib
import random

import numpy as np
import pytest

from _oracle import connect
from conftest import SF_SMALL
from tessera.llm import queries, suffix_dedup

L = suffix_dedup.LENGTH
COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _expected(rows):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - L + 1):
            w = data[k : k + L]
            if w in seen:
                gone[k : k + L] = True
            seen.add(w)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes()
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.select(COLUMNS).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_classes_equal_sorted_prefixes():
    rnd = random.Random(4)
    for length in (1, 2, 5, 13):
        for _ in range(40):
            text = np.array([rnd.randint(0, 2) for _ in range(rnd.randint(1, 60))] * rnd.randint(1, 3) + [rnd.randint(0, 3)])
            order, kind = suffix_dedup.common_classes(text, length)
            turned = [tuple(np.roll(text, -int(i))[:length].tolist()) for i in order]
            if len(text) < length:
                continue
            assert turned == sorted(turned)
            assert [a == b for a, b in zip(turned, turned[1:])] == [a == b for a, b in zip(kind, kind[1:])]


def test_query_equals_all_windows(spark):
    rows = connect(SF_SMALL).sql("SELECT doc_id, text FROM documents").fetchall()
    assert _got(queries.QUERIES["op11_suffix_dedup"](spark, SF_SMALL)) == _expected(rows)


@pytest.mark.parametrize("group", [2048, 2])
def test_planted_repeats(spark, group):
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abc dé") for _ in range(n))
    passage, row = text(140), text(95)
    rows = [(None, text(50) + passage), (1, None), (2, ""), (3, "a" * 400), (4, "ab" * 300), (5, passage), (6, passage[:99])]
    rows += [(i, text(rnd.randint(0, 90)) + passage + text(30) + row + text(20)) for i in range(10, 40)]
    rows += [(i, text(60) + row + text(40)) for i in range(50, 80)] + [(90, rows[9][1]), (91, rows[9][1] + rows[10][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS `a.b`", "3 AS tie")
    assert _got(suffix_dedup.remove_repeats(df.repartition(5), group)) == _expected(rows)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
