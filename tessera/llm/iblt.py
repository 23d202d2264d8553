"""Document fingerprints by invertible Bloom lookup sketches.

A text is the multiset of its passages: lines, cut further after a sentence's end
(``.``, ``!`` or ``?`` and a blank) and every 4,096 bytes. A passage's digest enters
three cells of the sketch; a cell keeps a count, the sum of its digests and the sum
of their checks. Two versions' sketches are subtracted, which cancels what they share,
and peeling recovers the differing digests: a cell with one digest left gives it, and
taking it out of its other cells frees more. If cells remain, both sketches are made
anew with four times the cells, until the peeling ends. Likeness is the shared
passages as a part of all passages of both (a Jaccard similarity of multisets).

The fingerprint is the smallest sketch (``CELLS`` cells) in base64, with the number of
passages: equal texts have equal fingerprints, and fingerprints of close versions
subtract to few cells.

Work is done in runs of rows by numpy, for any number of rows at once. The next
document in key order is found without a global sort in one task: a narrow range
partitioning of the keys gives the first key of every range, rows are dealt by those
fixed cuts, and the first row of each range is also sent to the range before.

Edge cases: null and empty texts have no passages; two texts without any are alike
(1.0), one without is unlike any other (0.0); rows with a null key come first, equal
keys are ordered by the text's hash; equal rows follow each other in any order;
a single document is its own next; an empty table gives no rows. Other columns of
the input are not carried.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import keyranges, textscan

CELLS = 24
GROWTH = 4
LONGEST = 4096
RUN = 2 << 20
_SEEDS = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0x139408DCBBF7A44D)]
_CHECK = np.uint64(0x5851F42D4C957F2D)
_COPY = np.uint64(0xDA942042E4DD58B5)


class Passages:
    """Digests of all passages of a run of texts, the row of each, and how many each row has."""

    def __init__(self, texts: list[str]):
        data, offs = textscan.text_bytes(pa.array(texts, pa.large_string()))
        self.rows = len(texts)
        begin = passage_begins(data, offs)
        end = np.append(begin[1:], len(data))
        row = np.searchsorted(offs, begin, side="right") - 1
        digest = span_hashes(data, begin, end)
        # The second of equal passages of a text is another digest than the first, and so on.
        order = np.lexsort((digest, row))
        d, r = digest[order], row[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1])
        nth = np.arange(len(d)) - np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
        self.digest = textscan.mix(d + nth.astype(np.uint64) * _COPY)
        self.row = r
        self.count = np.bincount(r, minlength=self.rows) if len(r) else np.zeros(self.rows, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the given rows, and for each its place in ``rows``."""
        n = self.count[rows]
        place = np.repeat(np.arange(len(rows)), n)
        at = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[rows], n)
        return self.digest[at], place


def passage_begins(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where passages begin: at texts, after line ends, after sentences, and every LONGEST bytes."""
    if not len(data):
        return np.zeros(0, np.int64)
    begins = np.zeros(len(data) + 1, bool)
    begins[1:] = data == 10
    stop = (data == 46) | (data == 33) | (data == 63)
    begins[2:] |= stop[:-1] & (data[1:] == 32)
    begins[offs] = True
    at = np.flatnonzero(begins[:-1])
    size = np.diff(np.append(at, len(data)))
    long = np.flatnonzero(size > LONGEST)
    if len(long):
        more = [np.arange(at[i] + LONGEST, at[i] + size[i], LONGEST) for i in long]
        at = np.sort(np.concatenate([at, *more]))
    return at


_VALUES = textscan.lexicon(np.ones(256, bool))._replace(value=textscan._byte_values())


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each of the consecutive spans, in blocks of bounded size."""
    out = np.zeros(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + textscan.BLOCK, side="right")) - 1)
        a, b = int(begin[i]), int(end[j - 1])
        up, down = textscan._POWERS.get(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_VALUES.value[data[a:b]] * up[: b - a], out=sums[1:])
        out[i:j] = (sums[end[i:j] - a] - sums[begin[i:j] - a]) * down[begin[i:j] - a]
        i = j
    return textscan.mix(out + (end - begin).astype(np.uint64) * _COPY)


def _cells(digest: np.ndarray, cells: int) -> list[np.ndarray]:
    third = np.uint64(cells // 3)
    return [(textscan.mix(digest ^ (s + np.uint64(cells))) % third + np.uint64(i) * third).astype(np.int64)
            for i, s in enumerate(_SEEDS)]


class Sketches:
    """Count, digest sum and check sum (modulo 2^64) of every cell of several rows' sketches."""

    def __init__(self, rows: int, cells: int):
        self.cells = cells
        self.count = np.zeros(rows * cells, np.int64)
        self.key = np.zeros(rows * cells, np.uint64)
        self.check = np.zeros(rows * cells, np.uint64)

    def add(self, digest: np.ndarray, row: np.ndarray, sign: np.ndarray) -> None:
        check = textscan.mix(digest ^ _CHECK)
        minus = sign < 0
        digest_, check = np.where(minus, -digest, digest), np.where(minus, -check, check)
        for cell in _cells(digest, self.cells):
            at = row * self.cells + cell
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, digest_)
            np.add.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered digests, the row of each, its sign, and of each row whether nothing is left."""
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        at = np.flatnonzero(np.abs(self.count) == 1)
        while len(at):
            sign = self.count[at]
            key = np.where(sign < 0, -self.key[at], self.key[at])
            check = textscan.mix(key ^ _CHECK)
            pure = np.where(sign < 0, -check, check) == self.check[at]
            key, row, sign = key[pure], at[pure] // self.cells, sign[pure]
            if not len(key):
                break
            order = np.lexsort((key, row))
            key, row, sign = key[order], row[order], sign[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            key, row, sign = key[new], row[new], sign[new]
            found.append((key, row, sign))
            self.add(key, row, -sign)
            touched = np.unique(np.concatenate([row * self.cells + c for c in _cells(key, self.cells)]))
            at = touched[np.abs(self.count[touched]) == 1]
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        done = ~left.reshape(-1, self.cells).any(1)
        return *(np.concatenate(x) for x in zip(*found)), done


def differences(a: Passages, rows_a: np.ndarray, b: Passages, rows_b: np.ndarray):
    """For pairs of rows: digests only in one, the pair of each, and +1 (only in a) or -1 (only in b)."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    open_, cells = np.arange(len(rows_a)), CELLS
    while len(open_):
        sketches = Sketches(len(open_), cells)
        for side, rows, sign in ((a, rows_a, 1), (b, rows_b, -1)):
            digest, place = side.of(rows[open_])
            sketches.add(digest, place, np.full(len(digest), sign, np.int64))
        key, pair, sign, done = sketches.peel()
        ended = done[pair]
        out.append((key[ended], open_[pair[ended]], sign[ended]))
        open_, cells = open_[~done], cells * GROWTH
    return tuple(np.concatenate(x) for x in zip(*out))


def likeness(a: Passages, rows_a: np.ndarray, b: Passages, rows_b: np.ndarray) -> np.ndarray:
    """Shared passages as a part of all, for pairs of rows."""
    _, pair, sign = differences(a, rows_a, b, rows_b)
    only_a = np.bincount(pair[sign > 0], minlength=len(rows_a))[: len(rows_a)]
    only_b = np.bincount(pair[sign < 0], minlength=len(rows_a))[: len(rows_a)]
    whole = a.count[rows_a] + only_b
    return np.where(whole > 0, (a.count[rows_a] - only_a) / np.maximum(whole, 1), 1.0)


def fingerprints(p: Passages) -> list[str]:
    """The smallest sketch of each row in base64: number of passages, then counts, sums and checks by cell."""
    s = Sketches(p.rows, CELLS)
    s.add(p.digest, p.row, np.ones(len(p.row), np.int64))
    shape = (p.rows, CELLS)
    packed = np.concatenate([
        p.count.astype("<u4").reshape(-1, 1).view(np.uint8),
        s.count.reshape(shape).astype("<u4").view(np.uint8),
        s.key.reshape(shape).astype("<u8").view(np.uint8),
        (s.check.reshape(shape) >> np.uint64(32)).astype("<u4").view(np.uint8)], axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in packed]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def compare_versions(df: DataFrame, old: str, new: str, carry: list[str]) -> DataFrame:
    """``carry`` with ``old_fingerprint, new_fingerprint, likeness, removed, added`` for two text columns.

    ``removed`` and ``added`` are the recovered digests of the passages in only one version.
    """
    names = ("old_fingerprint", "new_fingerprint", "likeness", "removed", "added")
    carried = [c for c in carry if c not in names]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [len(x.as_py() or "") + len(y.as_py() or "") for x, y in zip(_column(batch, "_old"),
                                                                               _column(batch, "_new"))]
            for i, j in textscan.runs(np.concatenate(([0], np.cumsum(size))), RUN):
                rows = batch.slice(i, j - i)
                a, b = (Passages([t or "" for t in _column(rows, c).to_pylist()]) for c in ("_old", "_new"))
                all_rows = np.arange(j - i)
                key, pair, sign = differences(a, all_rows, b, all_rows)
                lists = {s: [[] for _ in all_rows] for s in (1, -1)}
                for k, p, s in zip(key.view(np.int64).tolist(), pair.tolist(), sign.tolist()):
                    lists[s][p].append(k)
                out = {c: _column(rows, c) for c in carried}
                out |= {"old_fingerprint": fingerprints(a), "new_fingerprint": fingerprints(b),
                        "likeness": pa.array(likeness(a, all_rows, b, all_rows)),
                        "removed": pa.array([sorted(x) for x in lists[1]], pa.list_(pa.int64())),
                        "added": pa.array([sorted(x) for x in lists[-1]], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict(out)

    kept = df.select(*carried, F.col(old).alias("_old"), F.col(new).alias("_new"))
    types = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in carried)
    return kept.mapInArrow(scan, f"{types}{', ' if types else ''}old_fingerprint string, new_fingerprint string, "
                                 "likeness double, removed array<bigint>, added array<bigint>")


def _edit_run(rows: list[tuple], following: str):
    """Results for consecutive rows ``(doc_id, text)``, the last followed by ``following``."""
    texts = [t for _, t in rows]
    nexts = [*texts[1:], following]
    edited = []
    for t, u in zip(texts, nexts):
        k = len(t) // 2
        edited.append(t[: len(t) - k] + u[:k])
    a, e = Passages([*texts, following]), Passages(edited)
    i = np.arange(len(texts))
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([d for d, _ in rows], pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        "fingerprint": pa.array(fingerprints(a)[: len(texts)], pa.string()),
        "edited_fingerprint": pa.array(fingerprints(e), pa.string()),
        "near_edited": pa.array(likeness(a, i, e, i), pa.float64()),
        "near_next": pa.array(likeness(a, i, a, i + 1), pa.float64()),
    })


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges one after another: their rows in key order, then the rows that follow them."""
    held: list[tuple] = []  # rows that wait for the next
    size, range_no, done = 0, None, False
    for batch in batches:
        cols = [_column(batch, c) for c in ("range_no", "follows", "doc_id", "text")]
        for a in range(0, len(cols[0]), 64):
            for no, follows, doc_id, text in zip(*(c.slice(a, 64).to_pylist() for c in cols)):
                if no != range_no:
                    range_no, done = no, False
                    assert not held, "a range without the row that follows it"
                if follows:
                    if not done:  # of several equal first keys the first is next
                        if held:
                            yield _edit_run(held, text)
                        held, size, done = [], 0, True
                    continue
                if size > RUN:
                    yield _edit_run(held, text)
                    held, size = [], 0
                held.append((doc_id, text))
                size += len(text)
    assert not held, "a range without the row that follows it"


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Every text against itself edited with, and against, the next document in key order.

    Edited: the last half of the code points (rounded down) replaced by the first as
    many of the next text. ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.
    """
    spark = docs.sparkSession
    n = int(ranges or spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("text"),
                       keyranges.key_of(F.col(id_col)).alias("key"), F.xxhash64(body).alias("tie"))
    firsts = keyranges.range_firsts(rows, n)
    if not len(firsts):
        return rows.filter(F.lit(False)).mapInArrow(_walk, _EDITS)
    placed = rows.withColumn("p", keyranges.placing(spark, firsts)("key", "tie"))
    no, first = F.shiftright("p", 1).cast("int"), F.col("p") % 2 == 1
    here = F.struct(no.alias("range_no"), F.lit(False).alias("follows"))
    before = F.struct(F.pmod(no - 1, F.lit(len(firsts))).cast("int").alias("range_no"), F.lit(True).alias("follows"))
    dealt = placed.select("doc_id", "text", "key", "tie", F.explode(
        F.when(first, F.array(here, before)).otherwise(F.array(here))).alias("r"))
    dealt = dealt.select("r.range_no", "r.follows", "doc_id", "text", "key", "tie")
    dealt = dealt.repartitionById(len(firsts), "range_no").sortWithinPartitions("range_no", "follows", "key", "tie")
    return dealt.select("range_no", "follows", "doc_id", "text").mapInArrow(_walk, _EDITS)


_EDITS = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
