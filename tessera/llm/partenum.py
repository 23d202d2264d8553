"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

A text's set is its distinct word shingles, as 64-bit hashes. Two sets link when
``100 * intersection >= percent * union``. Sets are put into bands of sizes; a band
has one bound ``k`` on the symmetric difference of any two of its sets that can
link. For a band the feature domain is cut by hash into ``n1`` partitions, so two
linked sets differ in few features of at least one of them, and each partition into
``n2`` parts of which all subsets of ``n2 - k2`` are enumerated: some subset agrees
exactly, and its features' hash is a signature that both sets have. A set just above
a band's sizes also takes part in that band. No linked pair is lost:

* ``n1`` exceeds ``k // (k2 + 1)``, the number of partitions with over ``k2`` differences;
* signatures without features are left out, as long as the set has more partitions
  that cannot be empty under any subset than can differ; a set that has not emits
  its empty ones as well (two sets meet if one of them needs no empty signature). With
  ``n2 = 1`` there are so many partitions that sets of a band's smallest size have enough
  filled ones but for six deviations, as unrelated sets would share the empty signatures.

Equal sets are one node, so copies cost one signature per task. A signature shared by
few nodes gives all their pairs. One shared by many gives a star, and once the stars'
true links have made components, only members of *different* components that share
it are compared, in blocks of bounded size spread over tasks, through a parity sketch
(which never rejects a link) and then exactly. Pairs inside a component need no test:
of a block with many such pairs first only the closest of any two components is tried,
in some rounds, as a link ends the matter for all their pairs; what is still apart is then
compared in full. Once no block has left out a pair, that is done. That suffices for components, but its links are only some of all: with
``all_links`` the members of large signatures are also compared inside components, in
the same blocks, and every pair that links is given, with the number of links of each
row. Their number grows with the square of a group's distinct texts, as the result does.
Signatures that are frequent within one run of texts are recognised there: their
members travel spread out, not to one task.

Candidate pairs that sizes and parity sketches let through are verified on the whole sets. Components come from ``components``.

Edge cases: null, empty and wordless texts have the empty set and link with nothing;
a text of fewer words than a shingle is one shingle of all its words; repeated rows are
one node; rows that share an id but not a text each keep their row, and a component's
id is the smallest id in it; a null id is never the smallest, and its rows take their
component's id (null if there is none); empty tables give no rows. Further columns of
the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tessera.llm import textscan
from tessera.llm.components import components, dealt_anew
from tessera.llm.store import drop, stored

#: Ratio of a band's largest to its smallest size.
BAND = 1.45
#: From this bound on, partitions hold enough features and n2 = 1, k2 = 0.
WIDE = 48
#: Up to so many nodes a signature gives all pairs (at most 3.5 for each row).
FEW = 8
#: Nodes of one signature in one run of texts from which its members travel spread out.
FREQUENT = 12
#: Nodes in a block of the comparison across components.
BLOCK_NODES = 2048
#: Words of a set's parity sketch: one bit for each feature, in powers of two between these. Smaller ones fill up
#: and let through what is far apart. For the pairs that pass, all sets have a sketch of the largest.
SKETCH_WORDS, WIDE_WORDS = 8, 64
#: Sets whose widest sketches are made at once: 2 MB of counters.
SKETCHED_AT_ONCE = 64
#: Pairs of a block that are compared at once, and those of them whose sketches are laid side by side.
PAIRS_AT_ONCE, SKETCHES_AT_ONCE = 1 << 16, 1 << 12
#: Rounds in which only the closest pairs of components are tried, before all that are left.
ROUNDS = 3
#: Largest bitmap of the filter for needed ids, in bits.
MAX_BITS = 1 << 27

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


@dataclass(frozen=True)
class Band:
    low: int
    high: int  # sizes low .. high, and up to ``reach`` from the next band
    reach: int
    k: int
    k2: int
    n2: int
    n1: int

    @property
    def bad(self) -> int:
        """Partitions that can have more than k2 differences."""
        return self.k // (self.k2 + 1)


@lru_cache(maxsize=64)
def bands(percent: int, largest: int) -> tuple[Band, ...]:
    """The bands of sizes 1 .. largest at least, by rule; a band reaches into the next one only."""
    out, low = [], 1
    while not out or out[-1].high < largest:
        high = max(low, int(low * BAND), 100 * low // percent)
        reach = 100 * high // percent
        k = (high + reach) * (100 - percent) // (100 + percent)
        k2, n2 = (0, 1) if k == 0 or k >= WIDE else (1, 3)
        bad = k // (k2 + 1)
        spare = 0 if k == 0 else 2 if n2 > 1 else 4 + bad * 3 // 100
        n1 = bad + 1 + spare
        if k and n2 == 1:  # at low thresholds sets may be too small for any number
            n1 = next((n for n in range(n1, 2 * n1) if _filled(n, low, bad)), n1)
        out.append(Band(low, high, reach, k, k2, n2, n1))
        low = high + 1
    return tuple(out)


def _filled(n1: int, size: int, bad: int) -> bool:
    """Whether sets of a size fill more than ``bad`` of ``n1`` partitions, but for six deviations."""
    empty = math.exp(-size / n1)
    return n1 * (1 - empty) >= bad + 6 * math.sqrt(0.6 * n1 * empty * (1 - empty))


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows' distinct shingle hashes in row order, the row of each, and the size of each set."""
    w = textscan.words(data, offs, textscan.without_blanks())
    rows = len(offs) - 1
    h, at = textscan.window_hashes(w, n)
    row = w.row[at]
    short = np.flatnonzero((w.per_row > 0) & (w.per_row < n))
    if len(short):
        whole = np.concatenate([textscan.mix(_fold(w.hash[w.first[r] : w.first[r + 1]])) for r in short])
        h, row = np.concatenate((h, whole)), np.concatenate((row, short))
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    ends = np.searchsorted(row, np.arange(rows + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, row, np.bincount(row, minlength=rows)[:rows] if rows else np.zeros(0, np.int64)


def _fold(hashes: np.ndarray) -> np.ndarray:
    acc = np.full(1, np.uint64(len(hashes)))
    for x in hashes:
        acc = acc * textscan._STEP + x
    return acc


def set_keys(h: np.ndarray, row: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row's set."""
    sums = np.zeros(len(sizes), np.uint64)
    np.add.at(sums, row, textscan.mix(h ^ _C[1]))
    return textscan.mix(sums + sizes.astype(np.uint64) * _C[0])


def signatures(h: np.ndarray, row: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all rows' sets, and the row of each."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    all_bands = bands(percent, 1 << max(10, int(sizes.max()).bit_length()))
    lows = np.array([b.low for b in all_bands])
    own = np.searchsorted(lows, sizes, side="right") - 1
    reach = np.array([b.reach for b in all_bands])
    below = np.where((own > 0) & (sizes <= reach[np.maximum(own - 1, 0)]), own - 1, -1)
    spread, value = textscan.mix(h ^ _C[2]), textscan.mix(h ^ _C[3])
    sigs, rows = [], []
    for band_of in (np.where(sizes > 0, own, -1), below):
        for n2 in (1, 3):
            table = np.array([b.n1 if b.n2 == n2 else 0 for b in all_bands])
            n1 = np.where(band_of >= 0, table[np.maximum(band_of, 0)], 0)
            members = np.flatnonzero(n1)
            if not len(members):
                continue
            mine = n1[row] > 0
            r, v, s = row[mine], value[mine], spread[mine]
            base = np.zeros(len(sizes), np.int64)
            base[members] = np.concatenate(([0], np.cumsum(n1[members])[:-1])) * n2
            total = int(n1.sum()) * n2
            at = base[r] + (s % (n1[r] * n2).astype(np.uint64)).astype(np.int64)
            sums = np.zeros(total, np.uint64)
            np.add.at(sums, at, v)
            full = (np.bincount(at, minlength=total) > 0).reshape(-1, n2)
            sums = sums.reshape(-1, n2)
            of = np.repeat(members, n1[members])
            part = np.arange(len(of)) - np.repeat(base[members] // n2, n1[members])
            bad = np.array([b.bad for b in all_bands])[band_of]
            k2 = 0 if n2 == 1 else 1
            strong = np.bincount(of, weights=full.sum(1) > k2, minlength=len(sizes))
            weak = strong <= bad
            for t, subset in enumerate(combinations(range(n2), n2 - k2)):
                acc = (band_of[of].astype(np.uint64) * _C[0] + part.astype(np.uint64)) * _C[1] + np.uint64(t)
                for c in subset:
                    acc = textscan.mix(acc + sums[:, c])
                out = full[:, list(subset)].any(1) | weak[of]
                sigs.append(acc[out])
                rows.append(of[out])
    return np.concatenate(sigs), np.concatenate(rows)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _scan_sets(n: int, carried: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textscan.text_bytes(_column(batch, "text"))
            for a, b in textscan.runs(offs):
                h, row, sizes = shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], n)
                yield pa.RecordBatch.from_pydict({
                    **{c: _column(batch, c).slice(a, b - a) for c in carried}, "n_shingles": pa.array(sizes, pa.int64()),
                    "node": _signed(set_keys(h, row, sizes))})
    return scan


# What travels to the signature's task: a member of the signature, the first of a run's
# frequent one, another member of that (spread out), or a pair (spread out).
MEMBER, FIRST, SPREAD, PAIR = 0, 1, 2, 3


def _scan_signatures(n: int, percent: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textscan.text_bytes(_column(batch, "text"))
            for a, b in textscan.runs(offs):
                h, row, sizes = shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], n)
                keys = set_keys(h, row, sizes)
                first = np.zeros(len(keys), bool)
                first[np.unique(keys, return_index=True)[1]] = True
                mine = first[row]
                sig, of = signatures(h[mine], row[mine], np.where(first, sizes, 0), percent)
                sig, node = sig.view(np.int64), keys[of].view(np.int64)
                order = np.lexsort((node, sig))
                sig, node = sig[order], node[order]
                begin = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else order
                size = np.diff(np.concatenate((begin, [len(sig)])))
                kind = np.zeros(len(sig), np.int8)
                hot = np.repeat(size > FREQUENT, size)
                kind[hot] = SPREAD
                kind[begin[size > FREQUENT]] = FIRST
                spread = np.flatnonzero(kind == SPREAD)
                head = np.repeat(node[begin], size) if len(sig) else node
                yield pa.RecordBatch.from_pydict({
                    "sig": pa.array(np.concatenate((sig, head[spread]))),
                    "node": pa.array(np.concatenate((node, node[spread]))),
                    "kind": pa.array(np.concatenate((kind, np.full(len(spread), PAIR, np.int8))))})
    return scan


class _Found:
    """Pairs and memberships of a partition, repeats dropped before they are handed on."""

    LIMIT = 1 << 18

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, kind: int, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append(np.stack((np.full(len(a), kind, np.int64), a, b), 1))
            self.size += len(a)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            rows = np.concatenate(self.parts)
            rows = rows[np.lexsort(rows.T[::-1])]
            rows = rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))]
            yield pa.RecordBatch.from_pydict({c: pa.array(rows[:, i]) for i, c in enumerate(("kind", "a", "b"))})
            self.parts, self.size = [], 0


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (sig, node) to candidate pairs (kind 0) and members of large signatures (kind 1)."""
    found, empty = _Found(), np.zeros(0, np.int64)
    held = (empty, empty, empty)  # the last signature's rows, which may go on
    large: tuple[int, int] | None = None  # a signature that is being handed on, and its first node

    def whole(sig, node, kind):
        """Complete signatures only."""
        keep = np.ones(len(sig), bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        first = np.zeros(len(sig), bool)
        first[kind == FIRST] = True
        begin = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        flagged = np.add.reduceat(first.astype(np.int64), begin) > 0
        flagged = np.repeat(flagged, np.diff(np.concatenate((begin, [len(sig)]))))[keep]
        sig, node = sig[keep], node[keep]
        begin = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.concatenate((begin, [len(sig)])))
        many = np.repeat(size > FEW, size) | flagged
        head = np.repeat(node[begin], size)
        found.add(0, head[many], node[many])
        found.add(1, sig[many], node[many])
        left = np.repeat(size, size) - (np.arange(len(sig)) - np.repeat(begin, size))  # nodes from here on
        for d in range(1, FEW):
            i = np.flatnonzero(~many & (left > d))
            found.add(0, node[i], node[i + d])

    for batch in batches:
        sig, node, kind = (_column(batch, c).to_numpy() for c in ("sig", "node", "kind"))
        found.add(0, sig[kind == PAIR], node[kind == PAIR])
        found.add(1, sig[kind == SPREAD], node[kind == SPREAD])
        own = kind < SPREAD
        sig, node, kind = sig[own], node[own], kind[own]
        if large is not None and len(sig):
            n = int(np.searchsorted(sig, large[0], side="right"))
            found.add(0, np.full(n, large[1]), node[:n])
            found.add(1, sig[:n], node[:n])
            sig, node, kind = sig[n:], node[n:], kind[n:]
            if len(sig):
                large = None
        if len(sig):
            sig, node, kind = (np.concatenate(x) for x in zip(held, (sig, node, kind)))
            cut = int(np.searchsorted(sig, sig[-1], side="left"))
            if cut:
                whole(sig[:cut], node[:cut], kind[:cut])
            held = (sig[cut:], node[cut:], kind[cut:])
            if len(held[0]) > 4096:
                large = (int(held[0][0]), int(held[1][0]))
                found.add(0, np.full(len(held[0]), large[1]), held[1])
                found.add(1, held[0], held[1])
                held = (empty, empty, empty)
        if found.size > _Found.LIMIT:
            yield from found.flush()
    if len(held[0]):
        whole(*held)
    yield from found.flush()


def _scan_needed(n: int, bits):
    """Sets of the rows whose id passes the bitmap."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            ok = known.passes(_column(batch, "slot").to_numpy())
            rows = batch.filter(pa.array(ok))
            data, offs = textscan.text_bytes(_column(rows, "text"))
            for a, b in textscan.runs(offs):
                h, row, sizes = shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], n)
                keys = set_keys(h, row, sizes)
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "node": _signed(keys), "shingles": pa.ListArray.from_arrays(pa.array(ends), _signed(h))})
    return scan


class Bitmap:
    """One bit for each hash slot that occurs; its size is bounded by ``MAX_BITS``."""

    def __init__(self, n_bits: int, words: list[tuple[int, int]]):
        self.words = np.zeros(n_bits // 64, np.uint64)
        for at, bits in words:
            self.words[at] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)

    def passes(self, slot: np.ndarray) -> np.ndarray:
        slot = slot.astype(np.uint64)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _bitmap(ids: DataFrame, n: int) -> tuple[int, Bitmap]:
    """A bitmap over ``ids (id)``: at most MAX_BITS / 64 words reach the driver."""
    n_bits = min(MAX_BITS, max(1 << 12, 1 << (16 * max(1, n)).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(n_bits))
    words = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("slot"), F.lit(64)).cast("int")))
        .alias("bits"))
    return n_bits, Bitmap(n_bits, [(r["w"], r["bits"]) for r in words.collect()])


_SETS = StructType([StructField("node", LongType()), StructField("shingles", ArrayType(LongType()))])
_SKETCHES = StructType([StructField("node", LongType()), StructField("size", LongType()),
                        StructField("sketch", BinaryType()), StructField("wide", BinaryType())])


def _needed(rows: DataFrame, nodes: DataFrame, classes: DataFrame, shingle: int,
            sketched: bool) -> DataFrame:
    """The sets or sketches of the rows with the ids by which ``nodes`` are read again. One worker makes both of a
    row: a second Python step would double an executor's workers, which stay with their memory."""
    n_bits, bits = _bitmap(classes.join(nodes, "node").select(F.col("any_id").alias("id")), nodes.count())
    slot = F.pmod(F.xxhash64("id"), F.lit(n_bits)).alias("slot")
    scan = _scan_needed(shingle, rows.sparkSession.sparkContext.broadcast(bits))
    return rows.select(slot, "text").mapInArrow(
        (lambda batches: _sketches(scan(batches))) if sketched else scan, _SKETCHES if sketched else _SETS)


def _one_each(found: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """One row for each needed node: its copies have equal sets, any one of them will do."""
    return stored(found.join(nodes, "node", "left_semi").groupBy("node").agg(*(
        F.any_value(c).alias(c) for c in found.columns if c != "node")), name)


def sets_of(rows: DataFrame, nodes: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """``node, shingles`` for every node of ``nodes``: one text of each class is read again."""
    return _one_each(_needed(rows, nodes, classes, shingle, False), nodes, "sets")


def sketches_of(rows: DataFrame, nodes: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """``node, size, sketch, wide`` for every node of ``nodes``: whole sets do not travel for that."""
    return _one_each(_needed(rows, nodes, classes, shingle, True), nodes, "sketches")


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets link."""
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    n = F.size("x") + F.size("y")
    both = F.size(F.array_intersect("x", "y"))
    close = F.least(F.size("x"), F.size("y")) * 100 >= F.greatest(F.size("x"), F.size("y")) * percent
    joined = pairs.join(second, "b").join(first, "a")
    return joined.filter(close).withColumn("both", both).filter(
        F.col("both") * 100 >= (n - F.col("both")) * percent).select("a", "b")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and parity sketches of each set: a feature flips one bit, so sketches differ in no more bits than sets."""
    for whole in batches:
        for at in range(0, len(whole), 512):
            batch = whole.slice(at, 512)
            lists = _column(batch, "shingles")
            ends = lists.offsets.to_numpy()
            h = lists.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
            sizes = np.diff(ends)
            ends = ends - ends[0]
            wide = np.concatenate([_parity(h[ends[a] : ends[min(a + SKETCHED_AT_ONCE, len(sizes))]],
                                           sizes[a : a + SKETCHED_AT_ONCE])
                                   for a in range(0, len(sizes), SKETCHED_AT_ONCE)])
            yield pa.RecordBatch.from_pydict({
                "node": _column(batch, "node"), "size": pa.array(sizes, pa.int64()),
                "sketch": pa.array([folded(r, n).tobytes() for r, n in zip(wide, sketch_words(sizes).tolist())], pa.binary()),
                "wide": pa.array([r.tobytes() for r in wide], pa.binary())})


def _parity(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The widest sketches of some sets: one counter for each bit while they are made."""
    n_bits = 64 * WIDE_WORDS
    row = np.repeat(np.arange(len(sizes)), sizes)
    bit = (textscan.mix(h ^ _C[0]) % np.uint64(n_bits)).astype(np.int64)
    flips = (np.bincount(row * n_bits + bit, minlength=len(sizes) * n_bits) & 1).astype(np.uint8)
    return np.packbits(flips.reshape(len(sizes), -1), axis=1).view(np.uint64)


def sketch_words(sizes: np.ndarray) -> np.ndarray:
    """The least power of two words that have a bit for each feature, within the limits."""
    words = np.full(len(sizes), SKETCH_WORDS)
    while (more := (words * 64 < sizes) & (words < WIDE_WORDS)).any():
        words[more] *= 2
    return words


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of fewer words, a power of two: those of the same sets at that length."""
    parts = sketches.reshape(*sketches.shape[:-1], -1, words)
    return np.bitwise_xor.reduce(parts, axis=-2)


class _Sketched:
    """Sketches of different lengths, which are compared at the length of the shorter one."""

    def __init__(self, sketches: list[bytes]):
        self.words = np.array([len(x) // 8 for x in sketches], np.int64)
        self.at = np.zeros(len(sketches), np.int64)
        self.rows = {}
        for n in np.unique(self.words).tolist():
            mine = np.flatnonzero(self.words == n)
            self.at[mine] = np.arange(len(mine))
            self.rows[n, n] = np.frombuffer(b"".join(sketches[i] for i in mine.tolist()), np.uint64).reshape(-1, n)

    def of(self, n: int, words: int) -> np.ndarray:
        if (n, words) not in self.rows:
            self.rows[n, words] = folded(self.rows[n, n], words)
        return self.rows[n, words]

    def apart(self, i: np.ndarray, other: _Sketched, j: np.ndarray) -> np.ndarray:
        """Bits in which the sketches of the pairs differ."""
        x, y = self.words[i], other.words[j]
        out = np.zeros(len(i), np.int64)
        kinds, kind = np.unique(x * (WIDE_WORDS + 1) + y, return_inverse=True)
        for k, (n, m) in enumerate(divmod(v, WIDE_WORDS + 1) for v in kinds.tolist()):
            every = np.flatnonzero(kind == k)
            p, q = self.of(n, min(n, m)), other.of(m, min(n, m))
            for a in range(0, len(every), SKETCHES_AT_ONCE):
                mine = every[a : a + SKETCHES_AT_ONCE]
                out[mine] = np.bitwise_count(p[self.at[i[mine]]] ^ q[other.at[j[mine]]]).sum(1)
        return out


def _closest(a: np.ndarray, b: np.ndarray, root_a: np.ndarray, root_b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the pairs that are closest of those between the same two components."""
    lo, hi = np.minimum(root_a, root_b), np.maximum(root_a, root_b)
    order = np.lexsort((b, a, apart, hi, lo))
    new = np.ones(len(order), bool)
    new[1:] = (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])
    return order[new]


def _compare(percent: int, closest: bool):
    """Blocks in order of (sig, i, j) to pairs of different components that the sketch lets through: all of them
    (kind 0), or of a block that has more of them than rows the closest of any two components (kind 1)."""
    def close(rows: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        size, root, node = rows["size"], rows["root"], rows["node"]
        p, q = np.flatnonzero(rows["block"] == rows["i"]), np.flatnonzero(rows["block"] == rows["j"])
        one = rows["i"][0] == rows["j"][0]
        sketch = _Sketched(rows["sketch"].tolist())
        held, n_held, kind = [], 0, 0  # rows of the pairs and how far they are apart
        step = max(1, PAIRS_AT_ONCE // max(1, len(q)))
        for at in range(0, len(p), step):
            x, y = p[at : at + step, None], q[None, :]
            fits = (root[x] != root[y]) & (np.minimum(size[x], size[y]) * 100 >= np.maximum(size[x], size[y]) * percent)
            if one:  # each pair once
                fits &= x < y
            a, b = np.nonzero(fits)
            a, b = p[at + a], q[b]
            differ, both = sketch.apart(a, sketch, b), size[a] + size[b]
            passes = differ * (100 + percent) <= both * (100 - percent)
            held.append((a[passes], b[passes], differ[passes] / both[passes]))
            n_held += len(held[-1][0])
            if n_held < _Found.LIMIT and at + step < len(p):
                continue
            a, b, apart = (np.concatenate(c) for c in zip(*held))
            if closest and (kind or len(a) > len(node)):
                best = _closest(a, b, root[a], root[b], apart)
                a, b, apart, kind = a[best], b[best], apart[best], 1
            if closest and at + step < len(p):  # a later pair may be closer still
                held, n_held = [(a, b, apart)], 0
                continue
            held, n_held = [], 0
            yield kind, np.minimum(node[a], node[b]), np.maximum(node[a], node[b])

    names = ("sig", "i", "j", "block", "node", "root", "size", "sketch")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = _Found(), None

        def compared(rows: dict) -> Iterator[pa.RecordBatch]:
            for pairs in close(rows):
                found.add(*pairs)
                if found.size > _Found.LIMIT:
                    yield from found.flush()

        for batch in batches:
            rows = {c: np.array(_column(batch, c).to_pylist(), object) if c == "sketch" else
                    _column(batch, c).to_numpy() for c in names}
            if held is not None:
                rows = {c: np.concatenate((held[c], rows[c])) for c in names}
            change = np.flatnonzero((rows["sig"][1:] != rows["sig"][:-1]) | (rows["i"][1:] != rows["i"][:-1])
                                    | (rows["j"][1:] != rows["j"][:-1])) + 1
            a = 0
            for b in change.tolist():
                yield from compared({c: v[a:b] for c, v in rows.items()})
                a = b
            held = {c: v[a:] for c, v in rows.items()}
        if held is not None and len(held["sig"]):
            yield from compared(held)
        yield from found.flush()
    return scan


def _likely(percent: int):
    """The pairs that sizes and sketches let through."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_column(batch, c).to_numpy() for c in ("size_a", "size_b"))
            p, q = (_Sketched(_column(batch, c).to_pylist()) for c in ("sketch_a", "sketch_b"))
            every = np.arange(len(x))
            passes = (np.minimum(x, y) * 100 >= np.maximum(x, y) * percent) & (
                p.apart(every, q, every) * (100 + percent) <= (x + y) * (100 - percent))
            yield batch.select(["a", "b"]).filter(pa.array(passes))
    return scan


def likely(pairs: DataFrame, sketched: DataFrame, percent: int, sketch: str = "sketch") -> DataFrame:
    """``pairs`` without those that sizes and parity sketches rule out: their whole sets need not travel."""
    side = lambda c: sketched.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"),
                                     F.col(sketch).alias(f"sketch_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.mapInArrow(_likely(percent), StructType([StructField(c, LongType()) for c in ("a", "b")]))


def across(members: DataFrame, roots: DataFrame | None, sketched: DataFrame, percent: int, closest: bool) -> DataFrame:
    """Candidate pairs ``a, b`` of different components among the members of large signatures (without roots: all
    pairs); ``kind`` is 1 where a block has left out others."""
    if roots is None:
        placed = members.select("sig", "node", F.col("node").alias("root"))
    else:
        placed = members.join(roots, "node", "left").select(
            "sig", "node", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "placed")
    open_ = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                      F.count(F.lit(1)).alias("n")).filter("lo <> hi")
    open_ = open_.select(dealt_anew("sig"), F.ceil(F.col("n") / BLOCK_NODES).cast("int").alias("blocks"))
    rows = placed.join(open_, "sig").join(sketched.select("node", "size", "sketch"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                       "block", "node", "root", "size", "sketch")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    out = StructType([StructField(c, LongType()) for c in ("kind", "a", "b")])
    return dealt.mapInArrow(_compare(percent, closest), out).filter("a <> b").groupBy("a", "b").agg(
        F.max("kind").alias("kind"))


def link_counts(keys: DataFrame, links: DataFrame) -> DataFrame:
    """``id, n_shingles, n_links`` of every row: how many other rows its set links with, its copies among them."""
    sizes = stored(keys.filter("n_shingles > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies")), "copies")
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    others = both.join(sizes.withColumnRenamed("node", "other"), "other").groupBy("node").agg(
        F.sum("copies").alias("others"))
    per = sizes.join(others, "node", "left").select(
        "node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return keys.join(stored(per, "link-counts"), "node", "left").select(
        "id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@dataclass
class Join:
    """``rows``: id, n_shingles, component_id of every row; ``links``: verified pairs of set
    keys, each once: with ``all_links`` every pair that links, else enough to connect every
    component; ``keys``: id, n_shingles and set key of every row; ``counts``: with
    ``all_links`` the id, n_shingles and n_links (other rows it links with) of every row;
    ``roots``: set key (node) and its component's (root) of every set but the empty one."""

    rows: DataFrame
    links: DataFrame
    keys: DataFrame
    counts: DataFrame | None = None
    roots: DataFrame | None = None


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4,
                       percent: int = 85, all_links: bool = False, row: str | None = None) -> Join:
    """Components of the texts whose shingle sets have a Jaccard similarity of ``percent`` / 100 or
    more, and all links between different sets if asked (copies have one set).

    ``row`` is a long column that ``keys`` have as ``row`` (what tells rows of one id apart).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"),
                       *([F.col(row).alias("row")] if row else []))
    carried = ["id", "row"] if row else ["id"]
    longs = lambda *names: StructType([StructField(c, LongType()) for c in names])
    keys = stored(rows.mapInArrow(_scan_sets(shingle, carried), longs(*carried, "n_shingles", "node")), "keys")
    full = keys.filter("n_shingles > 0")
    classes = stored(full.groupBy("node").agg(
        F.min("id").alias("least_id"), F.any_value("id").alias("any_id")), "classes")

    travel = rows.select("id", "text").mapInArrow(
        _scan_signatures(shingle, percent), longs("sig", "node").add("kind", "byte"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.when(F.col("kind") < SPREAD, F.col("sig")).otherwise(F.xxhash64("sig", "node"))
    grouped = travel.repartition(n, place).sortWithinPartitions("sig", "node").mapInArrow(
        _group, longs("kind", "a", "b"))
    grouped = stored(grouped, "candidates")
    pairs = stored(grouped.filter("kind = 0 AND a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    members = grouped.filter("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("node")).distinct()

    # Sketches first: only the sets of pairs that pass them are read and travel.
    sketched = sketches_of(rows, nodes_of(pairs), classes, shingle)
    # The members hung on one node each; what of them are still apart is compared below.
    members = stored(members, "members")
    drop(grouped)

    def tested(pairs: DataFrame, name: str) -> DataFrame:
        near = stored(likely(pairs, sketched, percent, "wide"), "likelier-pairs")
        sets = sets_of(rows, nodes_of(near), classes, shingle)
        out = stored(verified(near, sets, percent), name)
        drop(near, sets)
        return out

    likelier = stored(likely(pairs, sketched, percent), "likely-pairs")
    drop(pairs)
    links = tested(likelier, "links")
    drop(likelier)
    roots = components(links)
    if not members.isEmpty():
        new = None
        for closest in [True] * ROUNDS + [False]:
            if closest and new is not None and new.isEmpty():
                continue  # the closest pairs are no links: on to all that are left
            more = stored(across(members, roots, sketched, percent, closest), "apart")
            if more.isEmpty():
                drop(more)
                break  # nothing that is still apart is close enough
            whole = more.filter("kind = 1").isEmpty()
            new = tested(more.select("a", "b"), "more-links")
            drop(more)
            if not new.isEmpty():
                links = links.union(new)
                roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new))
            if whole:
                break  # every pair that was still apart is tested
        if all_links:
            inside = stored(across(members, None, sketched, percent, False), "inside")
            links = stored(links.union(tested(inside.select("a", "b"), "inside-links")).distinct(), "all-links")
            drop(inside)
    drop(members, sketched)

    placed = classes.join(roots, "node", "left").select(
        "node", "least_id", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "class-roots")
    smallest = placed.groupBy("root").agg(F.min("least_id").alias("component_id")).select(
        dealt_anew("root"), "component_id")
    by_node = placed.join(smallest, "root").select("node", "component_id")
    linked = full.join(by_node, "node").select("id", "n_shingles", "component_id")
    alone = keys.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return Join(linked.union(alone), links, keys, link_counts(keys, links) if all_links else None,
                placed.select("node", "root"))
