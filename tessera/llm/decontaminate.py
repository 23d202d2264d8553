"""Benchmark decontamination: a broadcast hash set of test n-grams against training windows.

The benchmark's normalised word windows (13 words; a shorter item is one window)
are hashed into one sorted array that is broadcast after a check of its size.
Tasks hash every window of the training texts, look the hashes up (a bitmap first,
then the array), and compare each hit's words with the benchmark's, so a hash
collision never counts. The words inside any occurrence are hit. A text is
contaminated when it has hits and at least one word in ``one_in`` is hit.

A benchmark of more than ``max_bytes`` of text is not broadcast at once: its items
are dealt by hash into parts below that bound, each part is broadcast and scans the
texts in turn, and a row carries its marks from one scan to the next. Test sets of
the usual size need one scan.

Edge cases: a null or empty text (or one without words) has no words and no hits
and is clean; null or wordless items have no windows; an item id that occurs on
several rows counts once, null item ids are left out; equal windows of several
items hit for all of them; repeated training rows are each judged; an empty table
gives no rows, an empty benchmark no hits. Added columns are ``n_words, n_hit,
n_items, items, contaminated, hit_spans``; columns of those names in the input
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textscan
from tessera.llm.shield import inner, restored, shielded

WINDOW = 13
_BITS = 22
MARKS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(T.StructType([
        T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("hit_words", T.ArrayType(T.LongType())),  # begin, end, begin, end, ... in words
])


class WindowSet:
    """Benchmark windows: hashes in order, for each its words and the items that have it."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        lex, found = textscan.letters_and_digits(), {}
        for item, text in items:
            if text is None:
                continue
            data, offs = textscan.text_bytes(pa.array([text], pa.large_string()))
            w = textscan.words(data, offs, lex)
            n = min(window, len(w.hash))
            if not n:
                continue
            hashes, at = textscan.window_hashes(w, n)
            low = data.tobytes().lower()
            tokens = [low[b:e] for b, e in zip(w.begin.tolist(), w.end.tolist())]
            for h, i in zip(hashes.tolist(), at.tolist()):
                found.setdefault((n, h), {}).setdefault(b" ".join(tokens[i : i + n]), set()).add(item)
        self.lengths = sorted({n for n, _ in found})
        self.by_length = {}
        for n in self.lengths:
            hashes = np.array(sorted(h for m, h in found if m == n), np.uint64)
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[hashes >> np.uint64(64 - _BITS)] = True
            self.by_length[n] = (hashes, bitmap, [found[n, h] for h in hashes.tolist()])

    def __len__(self) -> int:
        return sum(len(x[0]) for x in self.by_length.values())


def marks(data: np.ndarray, offs: np.ndarray, lex: textscan.Lexicon, windows: WindowSet,
          earlier: list[tuple[list, list]] | None = None):
    """For each row: words, hit words, item ids (sorted strings), hit spans in bytes and in words.

    ``earlier``: the item ids and word spans that each row has from other parts of the benchmark.
    """
    w = textscan.words(data, offs, lex)
    rows = len(offs) - 1
    cover = np.zeros(len(w.hash) + 1, np.int64)
    items: dict[int, set] = {}
    for r, (ids, edges) in enumerate(earlier or ()):
        if ids:
            items[r] = set(ids)
            cover[w.first[r] + np.array(edges[::2])] += 1
            np.subtract.at(cover, w.first[r] + np.array(edges[1::2]), 1)
    for n in windows.lengths:
        known, bitmap, texts = windows.by_length[n]
        hashes, at = textscan.window_hashes(w, n)
        maybe = np.flatnonzero(bitmap[hashes >> np.uint64(64 - _BITS)])
        slot = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
        same = known[slot] == hashes[maybe]
        for i, s in zip(at[maybe[same]].tolist(), slot[same].tolist()):  # hits only
            tokens = b" ".join(data[w.begin[j] : w.end[j]].tobytes().lower() for j in range(i, i + n))
            ids = texts[s].get(tokens)
            if ids:
                cover[i] += 1
                cover[i + n] -= 1
                items.setdefault(int(w.row[i]), set()).update(ids)
    hit = np.cumsum(cover[:-1]) > 0
    n_hit = np.bincount(w.row[hit], minlength=rows)[:rows] if rows else np.zeros(0, np.int64)
    spans: dict[int, list] = {}
    edges: dict[int, list] = {}
    for r in items:
        a, b = w.first[r], w.first[r + 1]
        edge = np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))
        for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            spans.setdefault(r, []).append((int(w.begin[a + x] - offs[r]), int(w.end[a + y - 1] - offs[r])))
            edges.setdefault(r, []).extend((x, y))
    return w.per_row, n_hit, {r: sorted(s) for r, s in items.items()}, spans, edges


def _scan(column: str, windows, carried: list[str], again: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, known = textscan.letters_and_digits(), windows.value
        for batch in batches:
            data, offs = textscan.text_bytes(batch.column(batch.schema.get_field_index(column)))
            for a, b in textscan.runs(offs):
                rows = batch.slice(a, b - a)
                earlier = [rows.column(rows.schema.get_field_index(c)).to_pylist()
                           for c in ("items", "hit_words")] if again else None
                n_words, n_hit, items, spans, edges = marks(
                    data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], lex, known,
                    list(zip(*earlier)) if again else None)
                out = {c: rows.column(rows.schema.get_field_index(c)) for c in carried}
                out["n_words"] = pa.array(n_words, pa.int64())
                out["n_hit"] = pa.array(n_hit, pa.int64())
                out["n_items"] = pa.array([len(items.get(i, ())) for i in range(b - a)], pa.int64())
                out["items"] = pa.array([items.get(i, []) for i in range(b - a)], pa.list_(pa.string()))
                out["hit_spans"] = pa.array([[{"begin": x, "end": y} for x, y in spans.get(i, [])]
                                             for i in range(b - a)],
                                            pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
                out["hit_words"] = pa.array([edges.get(i, []) for i in range(b - a)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)
    return scan


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW,
                      max_bytes: int = 64 << 20) -> Iterator[WindowSet]:
    """The benchmark's windows on the driver, in parts of about ``max_bytes`` of text at most."""
    known = benchmark.filter(F.col(item).isNotNull() & F.col(text).isNotNull())
    size = known.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0
    parts = max(1, -(-size // max_bytes))
    for part in range(parts):
        mine = known if parts == 1 else known.filter(F.pmod(F.xxhash64(F.col(text)), F.lit(parts)) == part)
        yield WindowSet([tuple(r) for r in mine.select(F.col(item).cast("string"), F.col(text)).collect()], window)


def judge(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
          benchmark_text: str = "text", one_in: int = 20, window: int = WINDOW,
          carry: list[str] | None = None, max_bytes: int = 64 << 20) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all) with the marks and ``contaminated``."""
    spark = docs.sparkSession
    added = [f.name for f in MARKS] + ["contaminated"]
    carried = [c for c in (docs.columns if carry is None else carry) if c not in added]
    out = docs.select(*dict.fromkeys([*carried, text]))
    types = {c: out.schema[c] for c in out.columns}
    parts = benchmark_windows(benchmark, item, benchmark_text, window, max_bytes)
    part, first = next(parts), True
    while part is not None:
        following = next(parts, None)
        kept = carried if following is None else list(types)  # the text only goes on to a further scan
        schema = T.StructType([types[c] for c in kept] + MARKS.fields)
        out = out.mapInArrow(_scan(text, spark.sparkContext.broadcast(part), kept, not first), schema)
        part, first = following, False
    return out.select(*carried, *[f.name for f in MARKS if f.name != "hit_words"],
                      is_contaminated(F.col("n_hit"), F.col("n_words"), one_in).alias("contaminated"))


def is_contaminated(n_hit: Column, n_words: Column, one_in: int = 20) -> Column:
    return (n_hit > 0) & (n_hit * one_in >= n_words)


def remove_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated rows, all columns as they were."""
    names = docs.columns
    judged = judge(docs.select(*shielded(names)), benchmark, text=inner(names.index(text)), **options)
    return judged.filter(~F.col("contaminated")).select(*restored(names))


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with every hit span cut out of the text; clean rows stay byte for byte."""
    names = docs.columns
    text = inner(names.index(text))
    judged = judge(docs.select(*shielded(names)), benchmark, text=text, **options)
    raw = F.col(text).cast("binary")
    # The bytes between the spans: from each span's end (or 0) to the next begin (or the end).
    begins = F.concat(F.transform("hit_spans", lambda s: s["begin"]), F.array(F.octet_length(F.col(text)).cast("long")))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("hit_spans", lambda s: s["end"]))
    pieces = F.zip_with(ends, begins, lambda e, b: F.substr(raw, (e + 1).cast("int"), (b - e).cast("int")))
    joined = F.aggregate(pieces, F.lit(b""), lambda acc, p: F.concat(acc, p))
    cut = F.when(F.col("n_hit") > 0, joined.cast("string")).otherwise(F.col(text))
    return judged.withColumn(text, cut).select(*restored(names))
