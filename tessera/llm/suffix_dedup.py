"""Exact substring deduplication: bytes covered by a string of ``LENGTH`` bytes that also starts earlier.

Strings are judged through intervals of suffixes. Every window of ``LENGTH`` bytes has an anchor: of the
hashes of its ``GRAM``-byte strings the least, the leftmost of equal ones. Windows that follow each other and have
one anchor, in the same half of the places it may have, are a context; its key hashes the bytes that all
windows of that half have in common with the anchor there. Equal windows have equal anchors and places, so
equal keys: each key can be judged alone. Then

* keys that occur once have no repeat; of equal contexts all but the first are covered whole (found by
  aggregates that combine in the tasks, so copies cost no group);
* different contexts of one key go to one task as a small text, whose Burrows-Wheeler transform is
  extended backwards breadth first: all intervals of strings of length 0, then 1, and so on; an interval whose
  upper border has no common prefix yet sets it to that length and is extended. At ``LENGTH`` it stops: borders
  without a value are common prefixes of ``LENGTH`` or more, and the suffixes between set borders share a string.
  Its first start stays, the others are covered;
* keys of over ``GROUP`` different contexts (a passage between ``LENGTH`` and the common bytes in very many
  surroundings) are judged by whole windows instead, each aggregated by its bytes, spread over all tasks.

Edge cases: a null text is empty; a null id is before all others; rows equal in id and text are one document
and have the same result; rows of one id are in the order of a hash of their text, and an empty table gives no rows.
Contexts are told apart by 128 bits of hashes. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import named
from tessera.llm import textscan
from tessera.llm.keyranges import key_of
from tessera.llm.store import stored

LENGTH, GRAM = 100, 24
#: Places an anchor may have in a window, and those of a half.
PLACES = LENGTH - GRAM + 1
HALF = (PLACES + 1) // 2
#: Different contexts of a key that are judged as one text, and bytes of texts that are judged at once.
GROUP, TEXT_BYTES = 2048, 1 << 18
#: Bytes of rows that are hashed at once, so that their arrays stay in the processor's cache.
RUN = 1 << 17
#: Bits of a place in a run of texts.
_PLACE_BITS = np.uint64(30)
_STEPS = [np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)]


_VALUES = textscan.mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEPS[0])


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hashes:
    """Hashes of any stretch of the bytes: sums of byte values times powers, divided by the first power."""

    def __init__(self, data: np.ndarray, step: np.uint64):
        n = len(data)
        size = 1 << max(20, n.bit_length())
        self.back = _powers(pow(int(step), -1, 1 << 64), size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[data] * _powers(int(step), size)[:n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return textscan.mix((self.sums[end] - self.sums[begin]) * self.back[begin])


def contexts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, offset, windows, key and content hash of all contexts of the rows, in order."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    one, two = _Hashes(data, _STEPS[0]), _Hashes(data, _STEPS[1])
    at = np.arange(n - GRAM + 1)
    least = one.of(at, at + GRAM) >> _PLACE_BITS << _PLACE_BITS | at.astype(np.uint64)
    width = 1
    while width * 2 <= PLACES:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[PLACES - width :][: n - LENGTH + 1])
    anchor = (least & np.uint64((1 << 30) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: n - LENGTH + 1]
    start = np.arange(n - LENGTH + 1)
    inside = start + LENGTH <= offs[row + 1]
    start, row, anchor = start[inside], row[inside], anchor[inside]
    half = (anchor - start) // HALF
    new = np.ones(len(start), bool)
    new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (half[1:] != half[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(start)))
    begin, a, h = start[first], anchor[first], half[first]
    # What all windows of the half have: from its least place before the anchor on, up to the end of the one that begins first.
    key = two.of(a - h * HALF, a - np.minimum((h + 1) * HALF, PLACES) + 1 + LENGTH) + h.astype(np.uint64)
    lead = (a - begin).astype(np.uint64)
    content = textscan.mix(one.of(begin, begin + windows + LENGTH - 1) + lead) + windows.astype(np.uint64)
    return row[first], begin - offs[row[first]], windows, key, content


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = textscan.text_bytes(batch.column(2))
        for a, b in textscan.runs(offs, RUN):
            row, off, windows, key, content = contexts(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0).take(pa.array(row + a)), "tie": batch.column(1).take(pa.array(row + a)),
                "off": pa.array(off), "windows": pa.array(windows), "key": _signed(key), "content": _signed(content)})


_CONTEXT = "id long, tie long, off long, windows long, key long, content long"


def _sorted_rotations(text: np.ndarray, length: int) -> np.ndarray:
    """Starts of the rotations in the order of their first ``length`` symbols (of 9 bits); beyond that it is free."""
    n, width = len(text), 7
    key = text
    for i in range(1, width):
        key = key << 9 | np.roll(text, -i)
    order = np.argsort(key)
    slots, told, rank = np.arange(n), key[order], np.empty(n, np.int64)
    while True:
        # Equal rotations have the place of their first as rank; those alone in it are done.
        new = np.concatenate(([True], told[1:] != told[:-1]))
        rank[order[slots]] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        many = ~(new & np.append(new[1:], True))
        slots = slots[many]
        if width >= length or not len(slots):
            return order
        at = order[slots]
        key = rank[at] * n + rank[(at + width) % n]
        by = np.argsort(key)
        order[slots], told = at[by], key[by]
        width *= 2


def common_classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rotations of ``text`` (small numbers), and the class of each in it: those of one class share
    their first ``length`` symbols. By extension of intervals on the Burrows-Wheeler transform."""
    n = len(text)
    order = _sorted_rotations(text.astype(np.int64), length + 2)
    before = text[order - 1].astype(np.int64)
    by_symbol = np.argsort(before.astype(np.uint16), kind="stable")
    step = np.empty(n, np.int64)  # where a row goes when its symbol is put in front
    step[by_symbol] = np.arange(n)
    run = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    prefix = np.full(n + 1, -1, np.int64)
    prefix[[0, n]] = 0
    low, high = np.zeros(1, np.int64), np.full(1, n)
    for value in range(length):
        if not len(low):
            break
        alike = run[low] == run[high - 1]  # one symbol before all: the ends tell the interval
        ends_of = step[low[alike]], step[high[alike] - 1] + 1
        low, high = low[~alike], high[~alike]
        sizes = high - low
        of = np.repeat(np.arange(len(low)), sizes)
        rows = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[of]
        to = step[rows]
        by = np.argsort(to)  # the rows of an interval with one symbol go to places next to each other
        pair, to = (of * 512 + before[rows])[by], to[by]
        begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1])))
        ends = np.append(begins[1:], len(pair))[: len(begins)] - 1
        low, high = np.concatenate((ends_of[0], to[begins])), np.concatenate((ends_of[1], to[ends] + 1))
        # All of one length are disjoint: each border is met once at most, the text's end starts the chain.
        open_ = (prefix[high] < 0) | ((high == n) & (value == 0)) | ((high == n) & (prefix[n] == value))
        prefix[n] = value + 1 if (open_ & (high == n)).any() else prefix[n]
        low, high = low[open_], high[open_]
        prefix[high[high < n]] = value
    return order, np.cumsum(prefix[:n] >= 0)


def covered(pieces: list[tuple[int, int, int, int, int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
    """(id, tie, off, windows) of the windows that are not the first of their class; pieces (key, id, tie, off,
    windows, bytes) in order: one text with a mark after each."""
    text = np.frombuffer(b"\0".join(p[5] for p in pieces) + b"\0", np.uint8).astype(np.int64) + 1
    lens = np.array([len(p[5]) for p in pieces])
    begin = np.concatenate(([0], np.cumsum(lens + 1)))
    text[begin[1:] - 1] = 0
    order, kind = common_classes(text, LENGTH)
    of = np.searchsorted(begin, order, side="right") - 1
    whole = order - begin[of] < np.array([p[4] for p in pieces])[of]
    order, kind = order[whole], kind[whole]
    new = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    least = np.minimum.reduceat(order, new)
    late = np.sort(order[order != np.repeat(least, np.diff(np.append(new, len(order))))])
    runs = np.flatnonzero(np.concatenate(([True], late[1:] != late[:-1] + 1))) if len(late) else late
    for a, n in zip(late[runs].tolist(), np.diff(np.append(runs, len(late))).tolist()):
        i = int(np.searchsorted(begin, a, side="right")) - 1
        yield *pieces[i][1:3], pieces[i][3] + a - int(begin[i]), n


_COVERED = "id long, tie long, off long, windows long"


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of whole keys, as many as make ``TEXT_BYTES``; rows come in the order of key, id, tie, off."""
    def told(pieces):
        # One text may hold several keys: their windows differ, and the order within a key is kept.
        found = list(covered(pieces))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(4)],
                                          ["id", "tie", "off", "windows"])

    pieces, size = [], 0
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= TEXT_BYTES and r[0] != pieces[-1][0]:
                yield told(pieces)
                pieces, size = [], 0
            pieces.append(r)
            size += len(r[5])
    if pieces:
        yield told(pieces)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each document's contexts."""
    for batch in batches:
        out = []
        for i, tie, text, places in zip(*(c.to_pylist() for c in batch.columns)):
            data = text.encode()
            out += [(p["key"], i, tie, p["off"], p["windows"], data[p["off"] : p["off"] + p["windows"] + LENGTH - 1], p["hot"])
                    for p in places]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int64()] * 5 + [pa.binary(), pa.bool_()])],
            ["key", "id", "tie", "off", "windows", "bytes", "hot"])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column(0), []
        for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = (text or "").encode()
            kept, at, removed, spans = [], 0, 0, 0
            for off, end in sorted((p["off"], p["off"] + p["windows"] + LENGTH - 1) for p in places or ()):
                if off > at or not spans:
                    spans += 1
                    kept.append(data[at:off])
                    at = off
                if end > at:
                    removed, at = removed + end - at, end
            kept.append(data[at:])
            out.append((len(data), removed, spans, b"".join(kept)))
        yield pa.RecordBatch.from_arrays(
            [ids, *(pa.array([r[k] for r in out], pa.int64()) for k in range(3)),
             pa.array([hashlib.sha256(r[3]).hexdigest() for r in out], pa.string()),
             pa.array([r[3] for r in out], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


_STRIPPED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def covered_windows(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """``id, tie, off, windows`` of all runs of windows that start earlier as well; ``docs``: id, tie, text."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.mapInArrow(_scan, _CONTEXT)
    keys = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    keys = stored(keys.filter("n > 1").select("key", (F.col("lo") != F.col("hi")).alias("differ")), "repeated-keys")
    again = stored(found.join(keys, "key"), "repeated-contexts")
    place = F.struct("id", "tie", "off")
    firsts = again.groupBy("key", "content").agg(F.min(place).alias("first"), F.any_value("windows").alias("windows"),
                                                 F.any_value("differ").alias("differ"))
    firsts = stored(firsts, "first-contexts")
    later = again.join(firsts.select("key", "content", "first"), ["key", "content"]).filter(place != F.col("first")).select(
        "id", "tie", "off", "windows")
    differ = firsts.filter("differ")
    hot = differ.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group).select("key", F.lit(True).alias("hot"))
    wanted = differ.join(hot, "key", "left").select(
        "first.id", "first.tie", F.struct("key", F.col("first.off").alias("off"), "windows",
                                          F.coalesce("hot", F.lit(False)).alias("hot")).alias("place"))
    places = wanted.groupBy("id", "tie").agg(F.collect_list("place").alias("places"))  # at most a document's own
    texts = docs.dropDuplicates(["id", "tie"]).join(places, ["id", "tie"]).select("id", "tie", "text", "places")
    cut = stored(texts.mapInArrow(_cut, "key long, id long, tie long, off long, windows long, bytes binary, hot boolean"), "context-bytes")
    names = ["key", "id", "tie", "off", "windows", "bytes"]
    extended = cut.filter("NOT hot").select(*names).repartition(n, "key").sortWithinPartitions("key", "id", "tie", "off").mapInArrow(
        _extend, _COVERED)
    single = cut.filter("hot").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1))).select(
        "id", "tie", (F.col("off") + F.col("i")).alias("off"),
        F.substring("bytes", F.col("i").cast("int") + 1, F.lit(LENGTH)).alias("window"))
    single = stored(single, "windows")
    earliest = single.groupBy("window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    alone = single.join(earliest, "window").filter(place != F.col("first")).select("id", "tie", "off", F.lit(1).cast("long").alias("windows"))
    return later.union(extended).union(alone)


def remove_repeats(table: DataFrame, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes that stay) of every document."""
    docs = table.select(key_of(named("doc_id")).alias("id"), F.xxhash64(named("text")).alias("tie"),
                        F.coalesce(named("text"), F.lit("")).alias("text"), named("doc_id").cast("long").alias("doc_id"))
    spans = covered_windows(docs.select("id", "tie", "text"), group)
    marks = stored(spans.groupBy("id", "tie").agg(F.collect_list(F.struct("off", "windows")).alias("places")), "covered")
    return docs.join(marks, ["id", "tie"], "left").select("doc_id", "text", "places").mapInArrow(_strip, _STRIPPED)
