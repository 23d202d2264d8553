"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names: each operator's stated result."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import (
    decontaminate,
    host_reputation,
    iblt,
    language_id,
    partenum,
    sharding,
    sp_sampling,
    store,
    style_tree,
    token_counts,
    warc,
)
from tessera.llm.queries import LANGUAGES, tokenizer_path
from tessera.session import scratch_path

LONG = "so long a text. " * 40_000 + "x" * 5000
DOCS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (None, "no id here"),
        (2, None), (3, ""), (4, "  \n "), (5, LONG), (1, "the same id"), (6, "twice"), (6, "twice"),
        (7, "ünï ©ode 日本語 𝔘 \x00 end")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "en", "s") for r in DOCS], "doc_id bigint, text string, lang string, source string")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter(F.lit(False))


# -- 1
def _bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_decontaminate_edges(spark, docs, nothing):
    bench = _bench(spark, [(10, "Two THREE four! five six seven eight nine ten eleven twelve thirteen fourteen"),
                           (11, "the same id"), (12, None), (13, "..."), (None, "twice"), (11, "no id here"), (2, "twice")])
    clashing = docs.withColumn("n_words", F.lit("clash")).withColumn("items", F.lit(0))
    rows = decontaminate.judge(clashing, bench).orderBy("doc_id", "n_words").collect()
    assert len(rows) == len(DOCS)
    by = {(r.doc_id, r.n_words): r for r in rows}
    assert by[1, 14].n_hit == 13 and by[1, 14]["items"] == ["10"] and by[1, 14].contaminated
    assert by[1, 3]["items"] == ["11"] and by[None, 3].n_hit == 3
    assert by[2, 0].n_hit == by[3, 0].n_hit == by[4, 0].n_hit == 0 and not by[2, 0].contaminated
    assert [r["items"] for r in rows if r.doc_id == 6] == [["2"], ["2"]]
    assert by[5, 160_001].n_hit == 0
    assert decontaminate.judge(nothing, bench).count() == 0
    assert decontaminate.judge(docs, bench.filter("false")).filter("n_hit > 0").count() == 0


def test_decontaminate_in_parts_equals_whole(spark, docs):
    bench = _bench(spark, [(i, f"word{i} two three four five six seven eight nine ten eleven twelve thirteen") for i in
                           range(30)] + [(40, "two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
                                         (41, "the same id"), (42, "one two")])
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items", "hit_spans", "contaminated"]
    whole, parts = (sorted(map(str, decontaminate.judge(docs, bench, carry=["doc_id"], max_bytes=m).select(cols).collect()))
                    for m in (64 << 20, 200))
    assert whole == parts


def test_remove_spans_cuts_hits_only(spark):
    df = spark.createDataFrame([(1, "é keep, THE same ID! and ü"), (2, "clean — text"), (3, None)], "doc_id int, text string")
    bench = _bench(spark, [(1, "the same id")])
    got = {r.doc_id: r.text for r in decontaminate.remove_spans(df, bench).collect()}
    assert got == {1: "é keep, ! and ü", 2: "clean — text", 3: None}
    assert [r.doc_id for r in decontaminate.remove_documents(df, bench).orderBy("doc_id").collect()] == [2, 3]


# -- 2
def test_sampling_edges(spark, docs, nothing):
    path = tokenizer_path("piece_bpe_32k.model")
    enc = sp_sampling.encode(docs.withColumn("sample", F.lit("clash")), path, 3, carry=["doc_id", "text", "sample"])
    assert enc.columns == ["doc_id", "text", "sample", "ids", "log_prob", "perturbed", "log_inclusion"]
    rows = sp_sampling.decode(enc, path).collect()
    for r in rows:
        assert r.decoded == (r.text or "")
    empty = [r for r in rows if not r.text]
    assert [(r.sample, r["ids"], r.log_prob, r.log_inclusion) for r in empty] == [(1, [], 0.0, 0.0)] * 2
    twice = sorted(str((r.sample, r["ids"])) for r in rows if r.doc_id == 6)
    assert twice[0::2] == twice[1::2]
    assert sp_sampling.encode(nothing, path).count() == 0
    again = sp_sampling.encode(docs.repartition(3), path, 3, carry=["doc_id", "text"])
    assert sorted(map(str, again.select("doc_id", "sample", "ids").collect())) == sorted(
        map(str, enc.select("doc_id", "sample", "ids").collect()))


# -- 3
PAGES = [(3, "http://a/x y\r\nInjected: 1", "p" * 200), (1, None, "p" * 200), (2, "http://b/", "short"), (4, "http://b/", "short"),
         (5, "http://b/é", None), (None, "http://c/", "p" * 200), (6, "http://d/", "q" * 100), (6, "http://d/", "q" * 100),
         (7, "http://d/", "q" * 100), (8, "u", "ü" * 60_000)]


def test_warc_round_trip_edges(spark):
    pages = spark.createDataFrame([(*p, 0) for p in PAGES], "page_id bigint, url string, html string, shard int")
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_warc(pages, folder, roll_bytes=300, min_shards=4)
    rows = warc.with_referred_pages(warc.read_warc(manifest, folder)).collect()
    assert len(rows) == len(PAGES) and len({r.record_id for r in rows}) == len(rows)
    want = sorted((p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in PAGES if p)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in rows if r.page_id) == want
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in rows}
    assert kinds == {(1, "response", None), (3, "revisit", 1), (None, "revisit", 1), (2, "response", None),
                     (4, "response", None), (5, "response", None), (6, "response", None), (7, "revisit", 6),
                     (8, "response", None)}
    assert next(r for r in rows if r.page_id == 3).url == "http://a/x%20y%0D%0AInjected:%201"
    assert bytes(next(r for r in rows if r.page_id == 8).payload).decode() == "ü" * 60_000
    files = {r.name: r.sha256 for r in manifest.collect()}
    assert len(files) > 4
    other = scratch_path(spark, "warc-test")
    again = warc.write_warc(pages.repartition(5), other, roll_bytes=300, min_shards=4)
    assert {r.name: r.sha256 for r in again.collect()} == files  # equal files however the rows are dealt
    assert warc.write_warc(pages.filter("false"), scratch_path(spark, "warc-test")).count() == 0


def test_warc_reader_finds_damage(spark):
    pages = spark.createDataFrame([p for p in PAGES if p[0] == 8], "page_id bigint, url string, html string")
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_warc(pages, folder, min_shards=1)
    path = f"{folder}/{manifest.first().name}".removeprefix("file:")
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-30])
    with pytest.raises(Exception):
        warc.read_warc(manifest, folder).collect()


# -- 4
def test_jaccard_edges(spark, docs, nothing):
    clashing = docs.withColumn("node", F.lit("clash")).withColumn("id", F.lit(1))
    rows = partenum.jaccard_components(clashing).rows.collect()
    assert len(rows) == len(DOCS)
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in rows), key=str)
    assert got.count((6, 1, 6)) == 2 and (1, 11, 1) in got and (1, 1, 1) in got
    assert (2, 0, 2) in got and (3, 0, 3) in got and (4, 0, 4) in got and (None, 1, None) in got
    assert partenum.jaccard_components(nothing).rows.count() == 0


# -- 5
def test_token_count_edges(spark, docs, nothing):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("clash")), path).collect()
    assert len(rows) == len(DOCS)
    assert {(r.n_bytes, r.n_tokens) for r in rows if not r.text} == {(0, 0)}
    special = spark.createDataFrame([("a<|endoftext|>b",), ("  <|endoftext|>",)], "text string")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for r in [*rows, *token_counts.count_tokens(special, path).collect()]:
        assert r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids)
    assert token_counts.count_tokens(nothing, path).count() == 0


# -- 6
def test_fingerprint_edges(spark, docs, nothing):
    rows = iblt.fingerprint_edits(docs, ranges=4).collect()
    assert len(rows) == len(DOCS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].fingerprint == by[3][0].fingerprint and by[2][0].near_next == 1.0
    assert sorted(r.near_next for r in by[6])[-1] == 1.0
    assert iblt.fingerprint_edits(nothing).count() == 0
    one = iblt.fingerprint_edits(docs.filter("doc_id = 5")).first()
    half = len(LONG) // 2
    assert one.edited_sha256 == hashlib.sha256((LONG[:len(LONG) - half] + LONG[:half]).encode()).hexdigest()
    assert one.near_next == 1.0


def test_versions_give_their_differences(spark):
    lines = [f"line {i}.\n" for i in range(500)]
    new = lines[:200] + ["other.\n"] + lines[203:]
    df = spark.createDataFrame([(1, "".join(lines), "".join(new)), (2, None, ""), (3, "a", None)],
                               "k int, old string, new string")
    rows = {r.k: r for r in iblt.compare_versions(df, "old", "new", ["k"]).collect()}
    assert len(rows[1].removed) == 3 and len(rows[1].added) == 1 and rows[1].likeness == 497 / 501
    assert rows[2].likeness == 1.0 and rows[3].likeness == 0.0 and len(rows[3].removed) == 1


# -- 7
def test_language_edges(spark, docs, nothing):
    train = spark.createDataFrame([("the cat and the dog are in the house " * 5, "en"), ("der hund und die katze sind im haus " * 5, "de")]
                                  * 20, "text string, lang string")
    model = language_id.train(train, LANGUAGES)
    rows = spark.createDataFrame(
        [(1, "the dog and the cat", "de", "a.com", "com"), (2, None, "en", None, None), (3, "", None, "b.de", "de"),
         (4, "жвзфцчшщ" * 60, "en", "a.com", "com"), (5, "die katze und der hund", None, "b.de", "de"),
         (5, "die katze und der hund", None, "b.de", "de"), (6, "ab", "en", "c", "c")],
        "doc_id int, text string, lang string, language string, sfx string")
    got = language_id.identify(rows, model, declared=F.col("lang"), suffix=F.col("sfx"), host=F.col("language"))
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == 7 and got.columns[-4:] == ["language", "probability", "accepted", "log_likelihood"]
    assert by[1].language == "en" and by[5].language == "de" and by[1].accepted and by[5].accepted
    assert not by[2].accepted and not by[3].accepted and by[2].log_likelihood is None
    assert not by[4].accepted  # no language's text
    assert language_id.identify(rows.filter("false"), model).count() == 0
    empty = language_id.train(train.filter("false"), LANGUAGES)
    assert language_id.identify(rows, empty).count() == 7


def test_evidence_decides_where_texts_do_not(spark):
    train = spark.createDataFrame([("aaaa bbbb " * 30, "en"), ("cccc dddd " * 30, "de")] * 10, "text string, lang string")
    model = language_id.train(train, ("en", "de"))
    rows = [(i, "aaaa bbbb " * 30, "en", "h1") for i in range(40)] + [(100 + i, "cccc dddd " * 30, "de", "h2") for i in range(40)]
    rows += [(1000, "zzzz", "en", "h1"), (1001, "zzzz", "de", "h2")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    got = {r.doc_id: r for r in language_id.identify(df, model, declared=F.col("lang"), host=F.col("source")).collect()}
    assert got[1000].language == "en" and got[1001].language == "de"


# -- 8
def test_sharding_edges(spark, docs, nothing):
    rows = sharding.balanced_shards(docs.withColumn("shard", F.lit("clash")), 4, ranges=3).collect()
    assert len(rows) == len(DOCS)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    keys = [(-1 if r.key is None else r.key, r.shard) for r in rows]
    assert sorted(keys) == sorted(keys, key=lambda k: (k[1], k[0]))  # contiguous in key order
    assert {r.key: r.size for r in rows}[2] == 1
    assert sharding.balanced_shards(nothing, 4).count() == 0


def test_shards_are_balanced(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    for ranges in (1, 7):
        size = {r.shard: r.b for r in sharding.balanced_shards(df, 16, ranges=ranges).groupBy("shard").agg(
            F.sum("size").alias("b")).collect()}
        target = sum(size.values()) / 16
        assert len(size) == 16 and all(abs(b - target) <= 97 for b in size.values())


# -- 9
def test_reputation_edges(spark):
    rules = [host_reputation.Rule("block", "net", "/"), host_reputation.Rule("allow", "example.net", "/en/")]
    urls = [None, "no scheme", "http://EXAMPLE.net/en/x?y", "http://a.example.net/de#f", "x://net", "http://notnet/", "http://net/",
            "a://b://c/d", "http://user:1@H.Org:80?q"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, None, "clash")],
                                  "page_id bigint, url string, host string")
    labels = spark.createDataFrame([(2, 1, 1), (None, 0, 1), (3, None, None), (8, 0, None)],
                                   "doc_id bigint, quality int, toxic int")
    got = {r.page_id: r for r in host_reputation.judge_urls(pages, labels, rules).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [
        ("", "", None), ("", "", None), ("example.net", "/en/x", "example.net/en/"), ("a.example.net", "/de", "net/"),
        ("net", "", None), ("notnet", "/", None), ("net", "/", "net/"), ("b:", "//c/d", None), ("user:1@h.org:80", "", None)]
    assert got[2].verdict == "allow" and got[3].verdict == "block"
    assert host_reputation.judge_urls(pages, labels, rules).count() == 10
    assert host_reputation.judge_urls(pages.filter("false"), labels, rules).count() == 0
    assert host_reputation.judge_urls(pages, labels.filter("false"), []).count() == 10


def test_bad_hosts_are_blocked_and_unknown_ones_follow_their_domain(spark):
    hosts = [("bad.evil.com", 60, 57), ("also.evil.com", 60, 58), ("good.nice.com", 60, 2), ("more.nice.com", 60, 1),
             ("one.nice.com", 1, 1), ("new.evil.com", 0, 0), ("new.nice.com", 0, 0)]
    out = host_reputation.host_posteriors(spark.createDataFrame(hosts, "host string, n bigint, bad bigint"))
    low = {r.host: r.low for r in out.select("host", host_reputation.bad_rate_bound(F.col("a"), F.col("b"), 1.64).alias(
        "low")).collect()}
    assert low["bad.evil.com"] > 0.5 and low["also.evil.com"] > 0.5 and low["good.nice.com"] < 0.3
    assert low["one.nice.com"] < 0.3  # one label does not outweigh its domain
    assert low["new.evil.com"] > low["new.nice.com"]


# -- 10
SITE = ('<html><body><div class="top">Site name and slogan {n}</div><div class="c"><h2>Title {i}</h2><p>Text {i} &amp; '
        'more.</p><p>Other {i}<br>line</p></div><div class="b">Read our terms of use on this site</div></body></html>')


def test_style_tree_removes_repeated_branches(spark):
    rows = [(i, f"http://h.org/{i}", SITE.format(i=i, n="")) for i in range(30)]
    rows += [(100 + i, "http://few.org/", SITE.format(i=i, n="")) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extract_text(df).collect()}
    assert got[7] == "Title 7\n\nText 7 & more.\n\nOther 7 line"
    assert got[100].startswith("Site name and slogan")  # too few pages to tell


def test_style_tree_judges_rare_and_few_nodes(spark):
    """A section's template on 2 % of its host's pages, and a host of six pages."""
    plain = "<html><body><div class=c><p>Story {i} of the day</p></div></body></html>"
    section = ('<html><body><div class="c"><p>Story {i} of the day</p></div><div class="strip">Subscribers read this '
               'section first</div></body></html>')
    rows = [(i, "http://hot.org/", (section if i % 50 == 0 else plain).format(i=i)) for i in range(600)]
    rows += [(1000 + i, "http://six.org/", section.format(i=i)) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extract_text(df).collect()}
    assert got == {i: f"Story {i % 1000} of the day" for i, _, _ in rows}


def test_articles_are_evidence_and_no_filter(spark):
    """A body in a div beside one teaser, a notice longer than half of a short article, and related articles."""
    story = "The council of town {i} met on day {i} to vote."
    notice = "Share this story with all of your friends and sign up for our letter to get one more every day."
    teaser = f"<html><body><div class=story><p>{story}</p></div><article><h3>Teaser {{i}}</h3></article></body></html>"
    short = f"<html><body><article><p>{story}</p><div class=end>{notice}</div></article></body></html>"
    related = (f"<html><body class=has-sidebar><div><p>{story}</p></div><div class=related><article>See {{i}}</article></div>"
               "</body></html>")
    only = f"<html><body><div class='sidebar-wrap'><article><p>{story}</p></article></div></body></html>"
    rows = [(1000 * k + i, f"http://h{k}.org/", page.format(i=i)) for k, page in enumerate((teaser, short, related, only))
            for i in range(30)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extract_text(df).collect()}
    for i in range(30):
        assert got[i] == story.format(i=i) + f"\n\nTeaser {i}"
        assert got[1000 + i] == got[2000 + i] == got[3000 + i] == story.format(i=i)


def test_extraction_edges(spark):
    page = ('<html><head><title>t</title><body class=home><div id=cookie-notice>We use cookies</div><header><a href=/>Home</a>'
            '</header><div class="with-sidebar"><main><h1>T &amp; U</h1>\n<p>One<br>two <b>bold</b>  text<p>Three <ul><li>a<li>b'
            '</ul><table><tr><td>c1<td>c2</table><form><input><button>Go</button></form><pre>x\n  y</pre><aside>side</aside>'
            '<section id="comments"><article class="comment"><p>nice</p></article></section><script>if(a<b){}</script>'
            '<!-- <p>no</p> --><p hidden>not seen</p></main></div><footer>f</footer>')
    rows = [(1, "http://a/", page), (2, None, None), (3, "http://a/", ""), (4, "x", "just text"), (5, "x", "<p>" * 3000 + "deep"),
            (1, "http://a/", page), (6, "x", "<p>a <b>" + "w " * 200_000), (7, "x", "<nav>only menu</nav>"), (8, "x", "<a '<p>q")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id int, url string, html string, text string")
    got = {r.page_id: r for r in style_tree.extract_text(df).collect()}
    assert got[1].text.split("\n\n") == ["T & U", "One two bold text", "Three", "a", "b", "c1", "c2", "x y"]
    assert got[2].text == got[3].text == got[7].text == "" and got[4].text == "just text" and got[5].text == "deep"
    assert got[6].n_chars == 2 + 400_000 - 1
    assert style_tree.extract_text(df).count() == len(rows)
    assert style_tree.extract_text(df.filter("false")).count() == 0


def test_stored_tables_can_be_cleared(spark):
    import os

    df = store.stored(spark.range(3), "clear-test")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    store.clear(spark)
    assert not os.path.exists(path)
