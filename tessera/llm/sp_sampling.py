"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

For every text the ``k`` segmentations with the largest Gumbel-perturbed
log-probabilities: an exact sample of k distinct segmentations without replacement from
the model's distribution over all of them. They are found without listing any by an
A-star search over the lattice from the whole set of segmentations down. A node is the
set of those that share a prefix and avoid some next edges; its perturbed value is
the largest of its members', a Gumbel number at the log of the node's probability,
truncated at its parent's. The best node is popped and split: the branch that holds
its maximum is drawn by the edges' probabilities and keeps the value, what is left
at every step is a new node with a truncated value. As the value is exact at every
node, each pop walks straight to one segmentation, and all nodes off its way are
made at once by numpy. The k-th pop ends the search; the best node left then gives the
threshold for the inclusion scores (log of the probability that a segmentation exceeds
it), so ``exp(log_prob - log_inclusion)`` is the importance weight of a sample.

Random numbers are a hash of the row's key, the seed, the sample and the place in the
text: they do not depend on how Spark deals the rows.

The normaliser is that of the vocabulary files used here: no change to the text but a
blank before it; U+2581 is the blank's own sign and is decoded as a blank. Characters
without a piece are their bytes (or the unknown piece where a model has no bytes).

Edge cases: null and empty texts have one segmentation, without pieces, of probability
1; a text with fewer than k segmentations gives them all, with inclusion 1 (log 0); a
null key is a key; rows with equal key and text give equal samples; an empty table
gives no rows. Memory in a task is in proportion to the longest text (about 100 bytes a
character). Output columns that clash with carried ones replace them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tessera.llm import textscan
from tessera.llm.lattice import BLANK, Lattice, Pieces
from tessera.llm.shield import inner, restored, shielded

RUN = 1 << 19
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_REST, _SPLIT, _ROOT = (np.uint64(i) for i in range(1, 4))

SAMPLES = StructType([
    StructField("sample", IntegerType()), StructField("ids", ArrayType(IntegerType())),
    StructField("log_prob", DoubleType()), StructField("perturbed", DoubleType()),
    StructField("log_inclusion", DoubleType()),
])


def uniform(seed: np.ndarray, use: np.uint64, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) by hash."""
    x = textscan.mix(np.asarray(seed) + np.array([use]) * _A)
    x = textscan.mix(x ^ (i.astype(np.uint64) * _B + j.astype(np.uint64) * _C + _A))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def truncated_gumbel(at: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers at ``at``, given that they are below ``most``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        out = at - np.log(np.exp(np.minimum(at - most, 700.0)) - np.log(u))
    return np.where(np.isneginf(at), -np.inf, np.minimum(out, most))


def log_inclusion(log_prob: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """Log of the probability that a Gumbel number at ``log_prob`` exceeds the threshold."""
    x = np.minimum(log_prob - np.where(np.isneginf(threshold), 0.0, threshold), 700.0)
    with np.errstate(over="ignore", divide="ignore"):
        near = np.log(-np.expm1(-np.exp(np.maximum(x, -30.0))))
    return np.where(np.isneginf(threshold), 0.0, np.where(x < -30, x, near))


def _walk(lat: Lattice, start: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of one segmentation of each word from its start state, in order, and the word of each edge."""
    state, live = start.copy(), np.flatnonzero(~lat.is_end[start])
    steps, count = [], np.zeros(len(start), np.int64)
    salt = textscan.mix(seed + _A) ^ (place.astype(np.uint64) * _B)
    j = 0
    while len(live):
        u = textscan.mix(salt[live] + np.array([j], np.uint64) * _C)
        edge = lat.choose(state[live], u >> np.uint64(11))
        steps.append((live, edge))
        count[live] += 1
        state[live] = lat.target[edge]
        live = live[~lat.is_end[state[live]]]
        j += 1
    first = np.concatenate(([0], np.cumsum(count)))
    edges = np.zeros(int(first[-1]), np.int64)
    for j, (words, edge) in enumerate(steps):
        edges[first[words] + j] = edge
    return edges, np.repeat(np.arange(len(start)), count)


class Round:
    """The n-th samples of some rows: edges of all of them, the word of each edge, and by row the
    cuts between them, log-probabilities and perturbed values."""

    def __init__(self, lat: Lattice, rows: np.ndarray, edges: np.ndarray, words: np.ndarray, cuts: np.ndarray,
                 value: np.ndarray):
        self.rows, self.edges, self.words, self.cuts, self.value = rows, edges, words, cuts, value
        self.size = np.diff(cuts)
        p = lat.p[edges]
        sums = np.concatenate(([0.0], np.cumsum(np.log(p))))
        self.before = sums[:-1] - np.repeat(sums[cuts[:-1]], self.size)
        self.log_prob = sums[cuts[1:]] - sums[cuts[:-1]]
        only = lat.count[lat.source[edges]] == 1
        with np.errstate(divide="ignore"):
            #: Log-probability of what the text has beside the path at each step.
            self.off = np.where(only, -np.inf, self.before + np.log1p(-np.minimum(p, 1.0)))

    def best_off(self, seeds: np.ndarray, sample: int, from_: np.ndarray, keep: int):
        """The nodes off the paths from the steps ``from_`` on, the ``keep`` best of each row: place
        among ``rows``, step, perturbed value."""
        n = self.size
        step = np.arange(len(self.edges)) - np.repeat(self.cuts[:-1], n)
        at = np.where(step >= np.repeat(from_, n), self.off, -np.inf)
        live = np.flatnonzero(at > -np.inf)  # all others have nothing beside them
        place = np.repeat(np.arange(len(n)), n)[live]
        step = step[live]
        u = uniform(seeds[self.rows][place], _REST, step, np.full(len(step), sample))
        value = truncated_gumbel(at[live], self.value[place], u)
        out = []
        for _ in range(keep):
            if not len(value):
                break
            begin = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            top = np.maximum.reduceat(value, begin)
            i = np.flatnonzero(value == np.repeat(top, np.diff(np.append(begin, len(value)))))
            i = i[np.concatenate(([True], place[i][1:] != place[i][:-1]))]
            out.append((place[i], step[i], value[i]))
            rest = np.ones(len(value), bool)
            rest[i] = False
            place, step, value = place[rest], step[rest], value[rest]
        return out


def top_k(data: np.ndarray, offs: np.ndarray, seeds: np.ndarray, pieces: Pieces, k: int):
    """The lattice, the rounds of samples on it, best first, and for every row the threshold."""
    lat = Lattice(data, offs, pieces)
    word_row, word_start = lat.row, lat.start
    rows = len(offs) - 1
    word0 = np.searchsorted(word_row, np.arange(rows + 1))
    in_text = np.arange(len(word_row)) - word0[word_row]
    one = np.zeros(rows, np.int64)
    root = -np.log(-np.log(uniform(seeds, _ROOT, one, one)))
    queues: list[list] = [[] for _ in range(rows)]  # (-value, sample, place among its rows, step, edges out)

    def offer(made: Round, sample: int, from_: np.ndarray) -> None:
        for place, step, value in made.best_off(seeds, sample, from_, k - sample + 1):
            edge = made.edges[made.cuts[:-1][place] + step]
            for r, n, i, v, e in zip(made.rows[place].tolist(), place.tolist(), step.tolist(), value.tolist(),
                                     edge.tolist()):
                heappush(queues[r], (-v, sample, n, i, (e,)))

    salted = textscan.mix(seeds ^ _A)
    edges, word = _walk(lat, word_start, salted[word_row], in_text)
    first = Round(lat, np.arange(rows), edges, in_text[word], np.searchsorted(word, word0), root)
    rounds = [first]
    offer(first, 1, one)
    for sample in range(2, k + 1):
        open_ = np.array([r for r in rounds[-1].rows.tolist() if queues[r]], np.int64)
        if not len(open_):
            break
        popped = [heappop(queues[r]) for r in open_.tolist()]
        steps = np.array([x[3] for x in popped])
        which = uniform(seeds[open_], _SPLIT, steps, np.full(len(open_), sample)).tolist()
        beside = uniform(seeds[open_], _REST, steps, np.full(len(open_), -sample))
        heads, words, drawn, starts, places, left = [], [], [], [], [], []
        for n, (r, (_, parent, at, step, without)) in enumerate(zip(open_.tolist(), popped)):
            made = rounds[parent - 1]
            base = int(made.cuts[at])
            state = int(lat.source[without[0]])
            a = int(lat.first[state])
            b = a + int(lat.count[state])
            p = lat.p[a:b].tolist()
            for e in without:
                p[e - a] = 0.0
            u, i = which[n] * sum(p), -1
            for j, x in enumerate(p):  # the last with a share takes what rounding leaves
                if x:
                    i, u = j, u - x
                    if u < 0:
                        break
            p[i] = 0.0
            left.append((sum(p), made.before[base + step], (*without, a + i)))
            w = int(made.words[base + step])
            heads.append(made.edges[base : base + step])
            words.append(made.words[base : base + step + 1])
            drawn.append(a + i)
            starts.append(np.append(lat.target[a + i], word_start[word0[r] + w + 1 : word0[r + 1]]))
            places.append(w)
        drawn, places = np.array(drawn), np.array(places)
        size = np.array([len(x) for x in starts])
        owner = np.repeat(np.arange(len(open_)), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + places[owner]
        seed = textscan.mix(seeds[open_] ^ (np.array([sample], np.uint64) * _A))
        tails, tail_word = _walk(lat, np.concatenate(starts), seed[owner], place)
        cut = np.searchsorted(owner[tail_word], np.arange(len(open_) + 1))
        tail_place = place[tail_word]
        all_edges, all_words, sizes = [], [], []
        for n, (head, head_words) in enumerate(zip(heads, words)):
            tail = slice(cut[n], cut[n + 1])
            all_edges += [head, drawn[n : n + 1], tails[tail]]
            all_words += [head_words, tail_place[tail]]
            sizes.append(len(head) + 1 + cut[n + 1] - cut[n])
        value = -np.array([x[0] for x in popped])
        made = Round(lat, open_, np.concatenate(all_edges), np.concatenate(all_words),
                     np.concatenate(([0], np.cumsum(sizes))), value)
        rounds.append(made)
        offer(made, sample, steps + 1)
        # What each split step still has beside the drawn edge.
        with np.errstate(divide="ignore"):
            at = np.array([x[1] for x in left]) + np.log(np.array([x[0] for x in left]))
        for n, g in enumerate(truncated_gumbel(at, value, beside).tolist()):
            if g > -np.inf:
                heappush(queues[open_[n]], (-g, sample, n, int(steps[n]), left[n][2]))
    thresholds = np.array([-q[0][0] if q else -np.inf for q in queues])
    return lat, rounds, thresholds


def round_ids(lat: Lattice, made: Round) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of a round's samples, and the cuts between them; an edge without a piece is its bytes' ids."""
    ids, pieces = lat.piece[made.edges], lat.pieces
    lone = np.flatnonzero(ids < 0)
    if not len(lone):
        return ids, made.cuts
    if not pieces.byte_fallback:
        ids[lone] = pieces.unknown
        return ids, made.cuts
    n = np.ones(len(ids), np.int64)
    begin = lat.byte_at[lat.source[made.edges]]
    n[lone] = lat.n_bytes(made.edges[lone])
    out = np.repeat(ids, n)
    byte = np.flatnonzero(out < 0)
    upto = np.cumsum(n)
    at = byte - np.repeat(upto - n, n)[byte] + np.repeat(begin, n)[byte]
    out[byte] = pieces.byte_ids[lat.own[at]]
    return out, np.concatenate(([0], upto))[made.cuts]


def decoded_bytes(ids: np.ndarray, cuts: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """UTF-8 bytes of the texts of several lists of ids one after another, and where each text is in them."""
    first = pieces.surface_first[ids]
    n = pieces.surface_first[ids + 1] - first
    upto = np.concatenate(([0], np.cumsum(n)))
    data = pieces.surface[np.arange(int(upto[-1])) + np.repeat(first - upto[:-1], n)]
    begin, end = upto[cuts[:-1]], upto[cuts[1:]]
    full = np.flatnonzero(end > begin)
    begin[full] += data[begin[full]] == 32  # the blank that encoding puts before a text
    return data, list(zip(begin.tolist(), end.tolist()))


def decode_ids(ids: np.ndarray, pieces: Pieces) -> bytes:
    """UTF-8 bytes of the text that the ids stand for."""
    data, ((a, b),) = decoded_bytes(ids, np.array([0, len(ids)]), pieces)
    return data[a:b].tobytes()


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def key_seeds(keys: list, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(repr(k), seed) for k in keys], np.uint64)


def run_samples(texts: list[str | None], keys: list, pieces: Pieces, k: int, seed: int):
    """For all samples of the texts, round after round: row, sample, log_prob, perturbed, log_inclusion,
    and their ids with the cuts between them."""
    marked = [" " + t.replace(BLANK, " ") if t else "" for t in texts]
    data, offs = textscan.text_bytes(pa.array(marked, pa.large_string()))
    lat, rounds, thresholds = top_k(data, offs, key_seeds(keys, seed), pieces, k)
    ids = [round_ids(lat, made) for made in rounds]
    rows = np.concatenate([made.rows for made in rounds])
    sample = np.repeat(np.arange(1, len(rounds) + 1), [len(made.rows) for made in rounds])
    log_prob = np.concatenate([made.log_prob for made in rounds])
    value = np.concatenate([made.value for made in rounds])
    inclusion = log_inclusion(log_prob, thresholds[rows])
    size = np.concatenate([np.diff(cuts) for _, cuts in ids])
    return rows, sample, log_prob, value, inclusion, np.concatenate([x for x, _ in ids]), np.concatenate(
        ([0], np.cumsum(size)))


def sampled(texts: list[str | None], keys: list, pieces: Pieces, k: int, seed: int) -> list[list[tuple]]:
    """For each text its samples, best first: (ids, log_prob, perturbed, log_inclusion)."""
    out: list[list[tuple]] = [[] for _ in texts]
    rows, _, log_prob, value, inclusion, ids, cuts = run_samples(texts, keys, pieces, k, seed)
    for n, r in enumerate(rows.tolist()):
        out[r].append((ids[cuts[n] : cuts[n + 1]], float(log_prob[n]), float(value[n]), float(inclusion[n])))
    return out


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _runs(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    _, offs = textscan.text_bytes(_column(batch, text))
    for a, b in textscan.runs(offs, RUN):
        for i in range(a, b, 2000):
            yield batch.slice(i, min(2000, b - i))


def _samples(batch: pa.RecordBatch, pieces: Pieces, k: int, seed: int) -> Iterator[tuple]:
    """Of the runs of a batch: its rows, and for its samples (in order of row and sample) their row and columns."""
    for rows in _runs(batch, "_text"):
        row, sample, log_prob, value, inclusion, ids, cuts = run_samples(
            _column(rows, "_text").to_pylist(), _column(rows, "_key").to_pylist(), pieces, k, seed)
        order = pa.array(np.lexsort((sample, row)))
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
        columns = {"sample": pa.array(sample, pa.int32()), "ids": lists, "log_prob": pa.array(log_prob),
                   "perturbed": pa.array(value), "log_inclusion": pa.array(inclusion)}
        yield rows, pa.array(row).take(order), {n: c.take(order) for n, c in columns.items()}


def _source(docs: DataFrame, carried: list[str], key: str, text: str) -> DataFrame:
    return docs.select(*shielded(carried), F.col(key).alias("_key"), F.col(text).alias("_text"))


def encode(docs: DataFrame, path: str, k: int = 3, seed: int = 0, key: str = "doc_id", text: str = "text",
           carry: list[str] | None = None) -> DataFrame:
    """``carry`` (default: the key) with one row for each sample of each text:
    ``sample`` (from 1, best first), ``ids, log_prob, perturbed, log_inclusion``."""
    names = [f.name for f in SAMPLES]
    handed = [c for c in (carry or [key]) if c not in names]
    carried = [inner(i) for i in range(len(handed))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            for rows, row, columns in _samples(batch, pieces, k, seed):
                yield pa.RecordBatch.from_pydict({c: _column(rows, c).take(row) for c in carried} | columns)

    source = _source(docs, handed, key, text)
    out = source.mapInArrow(scan, StructType([source.schema[c] for c in carried] + SAMPLES.fields))
    return out.select(*restored(handed), *names)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its piece ids (null ids: null)."""
    carried = [c for c in encoded.columns if c != out]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = batch.slice(a, 256)
                lists = _column(rows, ids)
                cuts = lists.offsets.to_numpy()
                data, at = decoded_bytes(lists.values.to_numpy()[cuts[0] : cuts[-1]], cuts - cuts[0], pieces)
                texts = [data[a:b].tobytes().decode("utf-8", "replace") if ok else None
                         for (a, b), ok in zip(at, lists.is_valid().to_pylist())]
                cols = {c: _column(rows, c) for c in carried} | {out: pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_pydict(cols)

    return encoded.mapInArrow(scan, StructType([encoded.schema[c] for c in carried]).add(out, "string"))


def encode_digests(docs: DataFrame, path: str, k: int = 3, seed: int = 0, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """The samples of ``encode``, decoded in the same task, as digests: ``key, sample, n_pieces, ids_sha256``
    (of the ids as 32-bit little-endian numbers), ``decoded_sha256, log_prob, log_inclusion``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            for rows, row, columns in _samples(batch, pieces, k, seed):
                lists = columns.pop("ids")
                cuts = lists.offsets.to_numpy()
                ids = lists.values.to_numpy()
                cuts, ids = cuts - cuts[0], ids[cuts[0] : cuts[-1]]
                raw = memoryview(np.ascontiguousarray(ids, "<i4").view(np.uint8))
                bytes_, at = decoded_bytes(ids, cuts, pieces)
                texts = memoryview(bytes_)
                yield pa.RecordBatch.from_pydict({
                    key: _column(rows, "_key").take(row), "sample": columns["sample"],
                    "n_pieces": pa.array(np.diff(cuts), pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest()
                                            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(texts[a:b]).hexdigest() for a, b in at], pa.string()),
                    "log_prob": columns["log_prob"], "log_inclusion": columns["log_inclusion"]})

    kind = docs.schema[key].dataType.simpleString()
    return _source(docs, [], key, text).mapInArrow(
        scan, f"`{key}` {kind}, sample int, n_pieces bigint, ids_sha256 string, decoded_sha256 string, "
              "log_prob double, log_inclusion double")
