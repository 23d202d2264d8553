"""Token counts by a whole-token shortcut.

The vocabulary is proved once, offline: a vocabulary string that the pre-tokenizer
keeps in one piece and the library encodes as exactly one token is a *whole token*.
In the texts every pre-token that is one of them counts 1 straight away; only the
rest go through the merges, each distinct one once per task as long as the cache of
bounded size holds it. Special strings inside a text are cut out first, as the
library does by default, and count one token each.

The counts equal the library's on the whole text: byte-level BPE never merges over
a pre-token's end, and the proof and the merges are the library's own. Pre-tokens
are found for a run of texts at once from the classes of their characters, by the
rules of the byte-level pattern, and told apart by 64-bit hashes.

Edge cases: null and empty texts have 0 tokens; very long texts are worked on in parts
cut at a blank between two words, where a pre-token begins in any case; a text of one
enormous pre-token is merged as it is and not cached; repeated rows are counted each;
an empty table gives no rows. Added columns are ``n_bytes, n_tokens``; input columns of
those names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import textscan

#: The pre-tokenizer's pattern (fixed value of the byte-level vocabulary).
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters that are worked on at once.
RUN = 1 << 20
CACHE = 200_000
CACHED_CHARS = 64
_LETTER, _NUMBER, _BLANK, _OTHER = 1, 2, 3, 4


def _load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The pattern's class of every code point."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, _OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\p{White_Space}", _BLANK)):
        out[np.array([ord(c) for c in regex.findall(pattern, every)])] = kind
    return out


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return textscan.mix((np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * textscan._BASE)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, and where each text begins (one more: the end)."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return chars, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def pre_token_begins(chars: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin, in all texts.

    A match is a run of one class with the blank U+0020 before it; of other white space
    before a word the last character is by itself; an apostrophe that begins a match
    takes the letters of an English ending.
    """
    n = len(chars)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[chars]
    head = np.zeros(n + 1, bool)  # first characters of texts
    head[offs] = True
    head = head[:n]
    before = np.concatenate(([0], kind[:-1])).astype(np.uint8)
    before[head] = 0
    space = kind == _BLANK
    word_next = np.zeros(n, bool)  # white space that a word follows
    word_next[:-1] = space[:-1] & ~space[1:] & ~head[1:]
    joins = np.zeros(n, bool)  # characters whose match began at the blank before
    joins[1:] = (word_next & (chars == 32))[:-1]
    begins = head | (kind != before) & ~joins | word_next & (before == _BLANK)
    quote = np.flatnonzero(begins & (chars == 39))
    if len(quote):
        end = offs[np.searchsorted(offs, quote, side="right")]  # of the text it is in
        c1 = np.where(quote + 1 < end, chars[np.minimum(quote + 1, n - 1)], 0)
        c2 = np.where(quote + 2 < end, chars[np.minimum(quote + 2, n - 1)], 0)
        size = np.where(np.isin(c1, [ord(c) for c in "stmd"]), 2, 0)
        for x, y in ("re", "ve", "ll"):
            size = np.where((c1 == ord(x)) & (c2 == ord(y)), 3, size)
        quote, size, end = quote[size > 0], size[size > 0], end[size > 0]
        begins[quote + 1] = False
        after = quote + size
        begins[after[after < end]] = True
    return np.flatnonzero(begins)


def _hashes(chars: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = textscan._POWERS.get(len(chars) + 1)
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(_values()[chars] * up[: len(chars)], out=sums[1:])
    return textscan.mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * textscan._STEP)


def parts_of(text: str, size: int = RUN) -> Iterator[str]:
    """A long text in parts of about ``size`` characters, cut at a blank between two words."""
    a = 0
    while len(text) - a > size:
        b = text.find(" ", a + size)
        while b >= 0 and (text[b - 1].isspace() or b + 1 < len(text) and text[b + 1].isspace()):
            b = text.find(" ", b + 1)
        if b < 0:
            break
        yield text[a:b]
        a = b
    yield text[a:] if a else text


def whole_tokens(path: str) -> np.ndarray:
    """Sorted hashes of the vocabulary strings that are proved to encode alone as one token.

    For each string: the pattern keeps it whole, and the library gives it exactly
    its own id. At most one entry for each vocabulary id, so the array is bounded.
    """
    import regex

    t, whole = _load(path), regex.compile(PATTERN)
    special = {a.content for a in t.get_added_tokens_decoder().values()}
    texts, ids = [], []
    for i in range(t.get_vocab_size()):
        s = t.decode([i], skip_special_tokens=False)
        m = whole.match(s) if s and s not in special and "\ufffd" not in s else None
        if m and m.end() == len(s):
            texts.append(s)
            ids.append(i)
    encoded = t.encode_batch(texts, add_special_tokens=False)
    proved = [s for s, i, e in zip(texts, ids, encoded) if e.ids == [i]]
    chars, offs = code_points(proved)
    return np.sort(_hashes(chars, offs[:-1], offs[1:]))


class Counting:
    """Counts tokens of texts in a task: the proved set, and a bounded cache of the rest."""

    def __init__(self, path: str, whole: np.ndarray):
        import regex

        self.tokenizer, self.whole = _load(path), whole
        # Whether a hash may be a whole token, by its upper bits.
        self.bits = 64 - max(10, (16 * max(1, len(whole))).bit_length())
        self.maybe = np.zeros(1 << (64 - self.bits), bool)
        self.maybe[whole >> np.uint64(self.bits)] = True
        special = sorted((a.content for a in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.tokenizer.encode_special_tokens = True  # pieces between them hold none
        self.cache: dict[int, int] = {}

    def is_whole(self, hashes: np.ndarray) -> np.ndarray:
        out = self.maybe[hashes >> np.uint64(self.bits)]
        at = np.flatnonzero(out)
        slot = np.minimum(np.searchsorted(self.whole, hashes[at]), max(0, len(self.whole) - 1))
        out[at] = self.whole[slot] == hashes[at]
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        parts, rows, size = [], [], 0
        for r, text in enumerate(texts):
            between = [text]
            if self.special is not None and self.special.search(text):
                between = self.special.split(text)
                out[r] += len(between) - 1
            for part in (p for b in between if b for p in parts_of(b)):
                if size + len(part) > RUN and parts:
                    self._add(parts, rows, out)
                    parts, rows, size = [], [], 0
                parts.append(part)
                rows.append(r)
                size += len(part)
        if parts:
            self._add(parts, rows, out)
        return out

    def _add(self, parts: list[str], rows: list[int], out: np.ndarray) -> None:
        chars, offs = code_points(parts)
        begin = pre_token_begins(chars, offs)
        end = np.append(begin[1:], len(chars))
        hashes = _hashes(chars, begin, end)
        tokens = np.ones(len(begin), np.int64)
        rest = np.flatnonzero(~self.is_whole(hashes))
        if len(rest):
            distinct, first, which = np.unique(hashes[rest], return_index=True, return_inverse=True)
            known = [self.cache.get(h) for h in distinct.tolist()]
            new = [i for i, k in enumerate(known) if k is None]
            if new:
                where = np.array([rest[first[i]] for i in new])
                words = [chars[a:b].tobytes().decode("utf-32-le")
                         for a, b in zip(begin[where].tolist(), end[where].tolist())]
                if len(self.cache) + len(new) > CACHE:
                    self.cache.clear()
                for i, word, e in zip(new, words, self.tokenizer.encode_batch(words, add_special_tokens=False)):
                    known[i] = len(e.ids)
                    if len(word) <= CACHED_CHARS:
                        self.cache[int(distinct[i])] = known[i]
            tokens[rest] = np.array(known, np.int64)[which]
        part = np.searchsorted(offs, begin, side="right") - 1
        np.add.at(out, np.array(rows), np.bincount(part, weights=tokens, minlength=len(parts)).astype(np.int64))


_COUNTING: dict[str, Counting] = {}


def _scan(column: str, path: str, whole, carried: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTING:
            _COUNTING[path] = Counting(path, whole.value)
        counting = _COUNTING[path]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            _, offs = textscan.text_bytes(texts)
            for a, b in textscan.runs(offs):
                rows = batch.slice(a, b - a)
                out = {c: rows.column(rows.schema.get_field_index(c)) for c in carried}
                out["n_bytes"] = pa.array(offs[a + 1 : b + 1] - offs[a:b], pa.int64())
                out["n_tokens"] = pa.array(counting.count([x or "" for x in texts.slice(a, b - a).to_pylist()]))
                yield pa.RecordBatch.from_pydict(out)
    return scan


def count_tokens(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (default: all) with ``n_bytes`` and ``n_tokens``.

    ``path`` is a byte-level BPE ``tokenizers`` file that every executor can read.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    carried = [c for c in (docs.columns if carry is None else carry) if c not in ("n_bytes", "n_tokens")]
    kept = docs.select(*dict.fromkeys([*carried, text]))
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    schema = T.StructType([kept.schema[c] for c in carried]
                          + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return kept.mapInArrow(_scan(text, path, whole, carried), schema)
