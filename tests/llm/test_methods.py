"""What the methods promise: no lost links, exact sampling, ends that meet."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import components, partenum, sp_sampling, textscan, token_counts
from tessera.llm.queries import tokenizer_path


# -- words
def test_words_and_hashes_equal_the_pattern():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aAbB zZ9\t\n.é日\x0b") for _ in range(rnd.randint(0, 60))) for _ in range(300)] + [None, "x" * 3_000_000]
    data, offs = textscan.text_bytes(pa.array(texts))
    for lex, pattern in ((textscan.letters_and_digits(), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
                         (textscan.without_blanks(), r"[^\x20\x09-\x0D]+")):
        w = textscan.words(data, offs, lex)
        want = [re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
        assert w.per_row.tolist() == [len(x) for x in want]
        seen = {}
        for h, word in zip(w.hash.tolist(), (x for row in want for x in row)):
            assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


# -- 4
def _links(sets, percent=85):
    out = []
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                out.append((j, i))
    return out


@pytest.mark.parametrize("percent", [85, 50, 95])
def test_linked_sets_share_a_signature(percent):
    rnd = random.Random(5)
    sets = []
    part = (100 - percent) / 100 * 0.75
    for size in [*range(1, 60), 80, 120, 200, 333, 500, 900, 1500]:
        base = {rnd.getrandbits(64) for _ in range(size)}
        sets.append(base)
        for _ in range(6):
            new = set(base)
            for x in rnd.sample(sorted(new), rnd.randint(0, min(size, int(size * part) + 1))):
                new.discard(x)
                if rnd.random() < 0.5:
                    new.add(rnd.getrandbits(64))
            for _ in range(rnd.randint(0, int(size * part))):
                new.add(rnd.getrandbits(64))
            sets.append(new or base)
    h = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    sizes = np.array([len(s) for s in sets])
    sig, row = partenum.signatures(h, np.repeat(np.arange(len(sets)), sizes), sizes, percent)
    of = [set() for _ in sets]
    for s, r in zip(sig.tolist(), row.tolist()):
        of[r].add(s)
    links = _links(sets, percent)
    assert len(links) > 300
    for b, c in zip(partenum.bands(percent, 5000), partenum.bands(percent, 5000)[1:]):
        assert c.low == b.high + 1 and b.reach <= c.high
    assert all(of[i] & of[j] for i, j in links)


def _brute_components(texts):
    sets = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, j in _links([sets[d] for d in ids]):
        a, b = find(ids[i]), find(ids[j])
        root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("partitions", [1, 5])  # in one run of texts, frequent signatures travel spread out
def test_components_equal_brute_force_with_large_groups(spark, partitions):
    """Copies, near copies far over the star size, chains of near copies, and a passage many texts share."""
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    texts = []
    base = words(90)
    for _ in range(150):  # near copies of one text, many of them only similar through others
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
        texts.append(t)
    chain = words(60)
    for _ in range(60):  # each one edit from the last
        chain = list(chain)
        chain[rnd.randrange(len(chain))] = rnd.choice(vocabulary)
        texts.append(chain)
    passage = words(40)
    texts += [words(rnd.randint(3, 25)) + passage + words(rnd.randint(3, 25)) for _ in range(150)]
    texts += [base] * 100 + [words(rnd.randint(0, 6)) for _ in range(100)]
    rnd.shuffle(texts)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(partitions)
    got = {r.id: (r.n_shingles, r.component_id) for r in partenum.jaccard_components(df).rows.collect()}
    assert got == _brute_components(docs)


@pytest.mark.parametrize("partitions", [1, 4])  # in one run of texts, frequent signatures travel spread out
def test_all_links_equal_brute_force(spark, partitions):
    """Links inside large components too: edited copies far over the star size, copies, and a shared passage."""
    rnd = random.Random(13)
    words = lambda n: [f"w{rnd.randrange(300)}" for _ in range(n)]
    base, passage = words(90), words(40)
    texts = [base] * 5
    for _ in range(60):
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(300)}"
        texts.append(t)
    texts += [words(rnd.randint(3, 9)) + passage + words(rnd.randint(3, 9)) for _ in range(30)]
    texts += [words(rnd.randint(0, 3)) for _ in range(20)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[i:i + 4]) for i in range(len(t) - 3)} if len(t) >= 4 else ({tuple(t)} if t else set()) for t in texts]
    want = {(i, j) for i, j in _links(sets, 85)} | {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[i] == sets[j]}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(partitions)
    joined = partenum.jaccard_components(df, all_links=True)
    of = {}
    for r in joined.keys.filter("n_shingles > 0").collect():
        of.setdefault(r.node, []).append(r.id)
    pairs = [(r.a, r.b) for r in joined.links.collect()]
    assert len(set(pairs)) == len(pairs) and all(a < b for a, b in pairs)
    got = {(min(i, j), max(i, j)) for a, b in pairs for i in of[a] for j in of[b]}
    assert got | {(i, j) for ids in of.values() for i in ids for j in ids if i < j} == want
    counts = Counter(x for pair in want for x in pair)
    assert {r.id: r.n_links for r in joined.counts.collect()} == {d: counts[d] for d, _ in docs}


def test_connected_components_of_paths_and_stars(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    rnd.shuffle(edges)
    df = spark.createDataFrame([e if rnd.random() < 0.5 else e[::-1] for e in edges], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 500 for i in range(501, 560)}
    assert components.components(df.filter("false")).count() == 0


# -- 2
@pytest.fixture(scope="module")
def pieces():
    return sp_sampling.load(tokenizer_path("piece_bpe_32k.model"))


def _segmentations(word, sp):
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        i = sp.piece_to_id(word[:n].replace(" ", "▁"))
        if i != sp.unk_id():
            for rest in _segmentations(word[n:], sp):
                yield (i, *rest)


def test_samples_have_the_distribution_without_replacement(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    flat = sp_sampling.Pieces(tokenizer_path("piece_bpe_32k.model"))
    flat.log_p = flat.log_p / 4  # flatter, so that all segmentations are seen
    flat.weight = flat.weight ** 0.25
    word, n = "abc", 20_000
    segments = list(_segmentations(" " + word, sp))
    logs = np.array([sum(flat.log_p[i] for i in s) for s in segments])
    p = np.exp(logs - np.logaddexp.reduce(logs))
    at = {s: i for i, s in enumerate(segments)}
    first, pairs, weight = Counter(), Counter(), np.zeros(len(segments))
    for a in range(0, n, 2000):
        for samples in sp_sampling.sampled([word] * 2000, list(range(a, a + 2000)), flat, 2, 7):
            i, j = (at[tuple(s[0].tolist())] for s in samples)
            assert samples[0][1] == pytest.approx(math.log(p[i])) and samples[0][2] >= samples[1][2]
            first[i] += 1
            pairs[i, j] += 1
            for s, k in zip(samples, (i, j)):
                weight[k] += math.exp(s[1] - s[3])
    for i in range(len(segments)):
        assert abs(first[i] / n - p[i]) < 4.5 * math.sqrt(p[i] * (1 - p[i]) / n)
        if p[i] > 0.01:
            assert weight[i] / n == pytest.approx(p[i], rel=0.12)  # inclusion scores make the samples unbiased
        for j in range(len(segments)):
            if i != j:
                q = p[i] * p[j] / (1 - p[i])
                assert abs(pairs[i, j] / n - q) < 4.5 * math.sqrt(q * (1 - q) / n) + 1 / n


def test_samples_are_those_of_the_library_alphabet(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    text = "Über 3 kleine Häuser,\n\tand  two more 日本\x00!"
    for ids, *_ in list(sp_sampling.sampled([text], [1], pieces, 4, 0))[0]:
        assert sp.decode(ids.tolist()) == text


# -- 5
def test_pre_tokens_equal_the_pattern():
    import regex

    find = regex.compile(token_counts.PATTERN).findall
    rnd = random.Random(1)
    alphabet = [*" \n\t\r\x0b\x0c\x85\xa0\u2003\u3000'''''stmdrevlSTx\u00e91\u00b2\u00bd\u2460\u4e00\U0001f642.!-\u0301\x00"] + ["'re", "'ll", "'s", "  "]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    chars, offs = token_counts.code_points(texts)
    begins = set(token_counts.pre_token_begins(chars, offs).tolist())
    want = set()
    for text, at in zip(texts, offs.tolist()):
        for m in find(text):
            want.add(at)
            at += len(m)
    assert begins == want


def test_whole_tokens_are_single_tokens():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t, proved = Tokenizer.from_file(path), token_counts.whole_tokens(path)
    assert 40_000 < len(proved) < 50_257
    c = token_counts.Counting(path, proved)
    words = [" the", "ing", " Zebra", "'s", "\n", "qzxv", " qzxv"]
    assert c.count(words).tolist() == [len(t.encode(w).ids) for w in words]


@pytest.mark.parametrize("size", [200, 400, 600, 3000])
def test_unrelated_sets_share_no_frequent_signature(size):
    h = np.random.default_rng(size).integers(0, 2**63, 300 * size, dtype=np.uint64)
    sig, _ = partenum.signatures(h, np.repeat(np.arange(300), size), np.full(300, size), 80)
    assert np.unique(sig, return_counts=True)[1].max() <= 8


def _peak_mb(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_task_has_one_python_step(spark, monkeypatch):
    """Two in a row need two workers a task, whose memory an executor keeps."""
    plans, keep = [], partenum.stored
    monkeypatch.setattr(partenum, "stored", lambda df, name: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join([*words[:59], f"end{i}"])) for i in range(30)], "doc_id bigint, text string")
    assert {r.component_id for r in partenum.jaccard_components(df).rows.collect()} == {0}
    steps = [plan.count("MapInArrow") for plan in plans]
    assert steps.count(1) >= 3
    # Between the two steps of the signatures their rows are dealt anew.
    assert all(n <= 1 + plan.count("RepartitionByExpression") for n, plan in zip(steps, plans))


def test_sketches_and_comparisons_take_little_memory_at_once():
    rnd = np.random.default_rng(3)
    n, size = 1024, 4000
    h = rnd.integers(0, 1 << 62, (n, size))
    batch = pa.RecordBatch.from_pydict({"node": pa.array(range(n), pa.int64()), "shingles": pa.ListArray.from_arrays(
        pa.array(np.arange(0, n * size + 1, size, np.int32)), pa.array(h.ravel()))})
    out = []
    assert _peak_mb(lambda: out.extend(partenum._sketches(iter([batch])))) < 24
    rows = pa.Table.from_batches(out)
    block = pa.RecordBatch.from_pydict({c: pa.array([0] * n) for c in ("sig", "i", "j", "block")} | {
        "root": rows["node"].combine_chunks(), **{c: rows[c].combine_chunks() for c in ("node", "size", "sketch")}})
    assert _peak_mb(lambda: list(partenum._compare(80, False)(iter([block])))) < 24


@pytest.mark.parametrize("closest", [True, False])
def test_many_pairs_of_a_block_are_handed_on_as_they_come(closest, monkeypatch):
    """All pairs of a block pass: what a task holds is bounded, and what it gives is the same."""
    n = 300
    rnd = np.random.default_rng(4)
    sketch = np.frombuffer(rnd.bytes(64), np.uint64)
    near = [(sketch ^ np.uint64(1 << int(i))).tobytes() for i in rnd.integers(0, 8, n)]
    block = pa.RecordBatch.from_pydict({c: pa.array([0] * n) for c in ("sig", "i", "j", "block")} | {
        "node": pa.array(rnd.permutation(n)), "root": pa.array(rnd.integers(0, 20, n)), "size": pa.array([400] * n),
        "sketch": pa.array(near, pa.binary())})
    given, largest = [], []
    for limit, at_once in ((1 << 30, 1 << 30), (500, 1 << 10)):
        monkeypatch.setattr(partenum._Found, "LIMIT", limit)
        monkeypatch.setattr(partenum, "PAIRS_AT_ONCE", at_once)
        out = list(partenum._compare(80, closest)(iter([block])))
        largest.append(max(b.num_rows for b in out))
        given.append(sorted({(r["a"], r["b"]) for b in out for r in b.to_pylist()}))
    assert given[0] == given[1] and len(given[0]) == (190 if closest else len(given[0]))
    assert closest or largest[1] < 3000 < largest[0]


def test_components_write_one_table_a_round_and_end_at_stars(spark, monkeypatch):
    """Each table costs a write task for each shuffle partition, however few its rows."""
    written, keep = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: written.append(name) or keep(df, name))
    stars = [(1, i) for i in range(2, 40)] + [(50, 51), (51, 50), (3, 1), (60, 60)]
    got = components.components(spark.createDataFrame(stars, "a bigint, b bigint"))
    assert sorted(map(tuple, got.collect())) == [(i, 1) for i in range(2, 40)] + [(51, 50)] and len(written) == 1
    written.clear()
    joined = [(1, i) for i in range(2, 20)] + [(30, i) for i in range(31, 50)] + [(19, 49), (19, 40), (60, 61), (62, 61)]
    got = components.components(spark.createDataFrame(joined, "a bigint, b bigint"))
    assert {r.node: r.root for r in got.collect()} == {i: 1 for i in [*range(2, 20), *range(30, 50)]} | {61: 60, 62: 60}
    assert len(written) <= 3


def test_a_join_writes_few_tables(spark, monkeypatch):
    """Groups of near copies under one frequent signature, some linked only across groups."""
    written, keep = [], partenum.stored
    for module in (partenum, components):
        monkeypatch.setattr(module, "stored", lambda df, name: written.append(name) or keep(df, name))
    rnd = random.Random(5)
    base, docs = [f"w{i}" for i in range(80)], []
    for i in range(120):
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(300)}"
        docs.append((i, " ".join(t)))
    got = partenum.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r.id: (r.n_shingles, r.component_id) for r in got.rows.collect()} == _brute_components(docs)
    assert "apart" in written and len(written) <= 26


def test_a_block_of_few_pairs_gives_them_all():
    """Then no later round has to look for those that were left out."""
    rnd = np.random.default_rng(6)
    sketches = [np.frombuffer(rnd.bytes(64), np.uint64) for _ in range(40)]
    rows = [s.tobytes() for s in sketches for _ in range(2)]  # only twins are close

    def given(root, rows):
        n = len(rows)
        block = pa.RecordBatch.from_pydict({c: pa.array([0] * n) for c in ("sig", "i", "j", "block")} | {
            "node": pa.array(range(n)), "root": pa.array(root), "size": pa.array([400] * n), "sketch": pa.array(rows, pa.binary())})
        return [r for b in partenum._compare(80, True)(iter([block])) for r in b.to_pylist()]

    few = given([i % 2 for i in range(80)], rows)  # two components, 40 pairs
    assert {(r["a"], r["b"]) for r in few} == {(2 * i, 2 * i + 1) for i in range(40)} and {r["kind"] for r in few} == {0}
    many = given([i % 2 for i in range(80)], rows[:1] * 80)  # 1600 pairs
    assert len(many) == 1 and many[0]["kind"] == 1


def test_words_of_long_texts_take_little_memory_at_once():
    data = np.frombuffer(b"some words of a text " * 50_000, np.uint8)
    offs = np.array([0, len(data)])
    textscan._POWERS.__init__()
    kept = sum(x.nbytes for x in textscan.words(data[:100], np.array([0, 100]), textscan.without_blanks()))
    assert kept < 10_000 and sum(x.nbytes for x in textscan._POWERS.get(1)) < 4e6
    textscan._POWERS.__init__()
    out = []
    peak = _peak_mb(lambda: out.append(textscan.words(data, offs, textscan.without_blanks())))
    assert peak < 8 + 2 * sum(x.nbytes for x in out[0]) / 1e6


def test_sketches_of_large_sets_tell_far_pairs_and_keep_links():
    """Far pairs of large sets do not pass, so what the blocks give grows with the close pairs; links always pass."""
    rnd = np.random.default_rng(11)
    sets, kinds = [], []
    for size in (3, 60, 511, 513, 900, 2000, 3500):
        for part in (0.99, 0.9, 0.5):  # of the features that both have
            both = rnd.integers(0, 1 << 62, int(size * part))
            pair = [np.unique(np.concatenate((both, rnd.integers(0, 1 << 62, size - len(both))))) for _ in "ab"]
            n = len(np.intersect1d(*pair))
            sets += pair
            kinds.append((size, 100 * n >= 80 * (len(pair[0]) + len(pair[1]) - n), part))
    batch = pa.RecordBatch.from_pydict({"node": pa.array(range(len(sets)), pa.int64()), "shingles": pa.array(
        [s.tolist() for s in sets], pa.list_(pa.int64()))})
    rows = pa.Table.from_batches(partenum._sketches(iter([batch]))).to_pydict()
    pairs = {"a": rows["node"][::2], "b": rows["node"][1::2]}
    for c in ("size", "sketch"):
        pairs |= {f"{c}_a": rows[c][::2], f"{c}_b": rows[c][1::2]}
    passed = pa.Table.from_batches(partenum._likely(80)(iter([pa.RecordBatch.from_pydict(pairs)])))["a"].to_pylist()
    for i, (size, linked, part) in enumerate(kinds):
        assert not linked or 2 * i in passed
        assert part != 0.5 or size < 60 or 2 * i not in passed
    # In blocks, each pair is given once and only if it passes.
    n = len(sets)
    block = pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in {
        "sig": [1] * n, "i": [0] * n, "j": [0] * n, "block": [0] * n, "node": rows["node"], "root": rows["node"],
        "size": rows["size"], "sketch": rows["sketch"]}.items()})
    given = pa.Table.from_batches(partenum._compare(80, False)(iter([block])))
    given = list(zip(given["a"].to_pylist(), given["b"].to_pylist()))
    assert len(given) == len(set(given)) and set(passed) == {a for a, b in given if b == a + 1 and a % 2 == 0}
    assert {2 * i for i, k in enumerate(kinds) if k[1]} <= set(passed)
