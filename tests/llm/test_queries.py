"""The registered queries: against their SQL, or against a plain reading of the contract."""

import hashlib
import re
from collections import Counter

import pytest

from _oracle import canonical, connect
from conftest import SF_SMALL
from tessera.llm import queries


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


@pytest.fixture(scope="module")
def documents(con):
    return con.sql("SELECT doc_id, text, lang FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF_SMALL)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(rel.columns, rel.fetchall())


def test_all_are_there():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_token_counts_equal_the_library(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    want = {d: len(t.encode(x or "", add_special_tokens=False).ids) for d, x, _ in documents}
    got = {r.doc_id: r for r in queries.QUERIES["op5_token_counts"](spark, SF_SMALL).collect()}
    assert {d: r.n_tokens for d, r in got.items()} == want
    assert all(r.n_bytes == len((x or "").encode()) and r.over_limit == (want[d] > 512)
               for d, x, _ in documents for r in [got[d]])


def _passages(text):
    out = []
    for x in re.split(r"(?<=\n)|(?<=[.!?] )", text):
        b = x.encode()
        out += [b[i:i + 4096] for i in range(0, len(b), 4096)]
    return Counter(out)


def _like(a, b):
    a, b = _passages(a), _passages(b)
    whole = sum((a | b).values())
    return sum((a & b).values()) / whole if whole else 1.0


def test_fingerprints_equal_brute_force(spark, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op6_iblt"](spark, SF_SMALL).collect()}
    for i, (d, text, _) in enumerate(documents):
        follows = documents[(i + 1) % len(documents)][1]
        k = len(text) // 2
        edited = text[:len(text) - k] + follows[:k]
        assert got[d].n_chars == len(text)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].near_edited == pytest.approx(_like(text, edited), abs=1e-12)
        assert got[d].near_next == pytest.approx(_like(text, follows), abs=1e-12)
    by_text = {}
    for d, text, _ in documents:
        by_text.setdefault(text, set()).add(got[d].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert len({f for s in by_text.values() for f in s}) == len(by_text)


def test_languages_agree_with_labels(spark, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op7_language_id"](spark, SF_SMALL).collect()}
    assert sum(got[d].language == lang for d, _, lang in documents) >= 0.97 * len(documents)
    assert sum(r.accepted for r in got.values()) >= 0.99 * len(documents)


def test_samples_decode_to_their_texts(spark, documents):
    rows = queries.QUERIES["op2_gumbel_top_k"](spark, SF_SMALL).collect()
    text = {d: hashlib.sha256(x.encode()).hexdigest() for d, x, _ in documents}
    assert all(r.decoded_sha256 == text[r.doc_id] for r in rows)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(text)
    for samples in by_doc.values():
        assert len({r.ids_sha256 for r in samples}) == len(samples) <= queries.SAMPLES
        assert all(r.log_inclusion <= 1e-12 for r in samples)


def test_pages_give_their_articles(spark, con):
    from html import unescape

    got = {r.page_id: r for r in queries.QUERIES["op10_style_tree"](spark, SF_SMALL).collect()}
    for page, html in con.sql("SELECT page_id, html FROM pages").fetchall():
        article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        blocks = [" ".join(unescape(x.replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1|b)>", article)]
        assert got[page].text == "\n\n".join(b for b in blocks if b)
        assert got[page].n_chars == len(got[page].text)
