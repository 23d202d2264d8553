"""Words of whole Arrow text columns as numpy arrays, with a 64-bit hash of each.

Helpers for the tasks of the text operators. A batch's UTF-8 bytes are scanned in
pieces of about ``PIECE`` bytes, cut only at separators, so memory does not grow
with the length of a text; nothing is looped over row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
#: Bytes whose words are found at once: about 40 bytes of numbers for each.
PIECE = 1 << 17
#: A batch is worked on in runs of rows of about so many bytes (one text may be longer).
RUN = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)


class Lexicon(NamedTuple):
    """Which bytes belong to words, and the value of each (of A-Z: that of a-z)."""

    inside: np.ndarray
    value: np.ndarray


def lexicon(inside: np.ndarray) -> Lexicon:
    value = _byte_values()
    value[65:91] = value[97:123]
    return Lexicon(inside, np.where(inside, value, np.uint64(0)))


def letters_and_digits() -> Lexicon:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case."""
    b = np.arange(256)
    return lexicon((b >= 128) | ((b >= 48) & (b <= 57)) | ((b >= 97) & (b <= 122)) | ((b >= 65) & (b <= 90)))


def without_blanks() -> Lexicon:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case."""
    b = np.arange(256)
    return lexicon(~((b == 32) | ((b >= 9) & (b <= 13))))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            ones = np.ones(max(n, PIECE + 1), np.uint64)
            up, down = ones.copy(), ones.copy()
            up[1:], down[1:] = _BASE, inverse
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


_POWERS = _Powers()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and where each row begins (one more: the end). Null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def runs(offs: np.ndarray, size: int = RUN) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words(NamedTuple):
    """Of every word: its hash, the row it is in, its first byte and the byte after it.
    ``per_row``: the number of words of each row; ``first``: where a row's words begin."""

    hash: np.ndarray
    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    per_row: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, offs: np.ndarray, lex: Lexicon) -> Words:
    """All words of the rows; a word never reaches over a row's end."""
    rows, hashes, begins, ends = len(offs) - 1, [], [], []
    a = 0
    while a < len(data):
        b = min(a + PIECE, len(data))
        while b < len(data):  # move the cut back to a separator or a row's begin, else on
            near = data[max(a + 1, b - 4096) : b]
            gap = np.flatnonzero(~lex.inside[near])
            if len(gap):
                b -= len(near) - int(gap[-1]) - 1
                break
            row = offs[int(np.searchsorted(offs, b, side="right")) - 1]
            if row > a:
                b = int(row)
                break
            b = min(b + PIECE, len(data))
        part = data[a:b]
        lo, hi = np.searchsorted(offs, (a, b), side="left")
        cuts = offs[lo:hi] - a  # row begins inside this block
        inside = lex.inside[part]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        start[cuts] |= inside[cuts]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        before = cuts[cuts > 0] - 1
        stop[before] |= inside[before]
        begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        up, down = _POWERS.get(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(lex.value[part] * up[: len(part)], out=sums[1:])
        h = (sums[end] - sums[begin]) * down[begin]
        hashes.append(mix(h + (end - begin).astype(np.uint64) * _BASE))
        begins.append(begin + a)
        ends.append(end + a)
        a = b
    none = np.zeros(0, np.int64)
    begin = np.concatenate(begins) if begins else none
    row = np.searchsorted(offs, begin, side="right") - 1
    per_row = np.bincount(row, minlength=rows)[:rows] if rows else none
    first = np.concatenate(([0], np.cumsum(per_row)))
    return Words(np.concatenate(hashes) if hashes else none.astype(np.uint64), row, begin,
                 np.concatenate(ends) if ends else none, per_row, first)


_STEP = np.uint64(0xD1342543DE82EF95)


def window_hashes(w: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``length`` consecutive words inside one row, and the first word's index."""
    n = len(w.hash) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.row[:n] == w.row[length - 1 :])
    acc = np.full(len(at), np.uint64(length))
    for i in range(length):
        acc = acc * _STEP + w.hash[at + i]
    return mix(acc), at
