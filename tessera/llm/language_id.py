"""Language ID by Bayesian fusion of the text with what is declared about it and its host.

Text: a byte 4-gram model for each language, trained on a bounded sample of labelled
rows (``sample_rows``; chosen by hash, whole texts, copies once), gives every text its mean
log-likelihood per gram for each language. A gram's probability follows from the number of
training texts that have it, so a text that repeats itself, or is no language at all, has
little weight. Declared markup language, address suffix
and host are further evidence. Their weights are learned from the whole table by
grouped aggregation of what the text alone says: how often each declaration goes with
each language, and how a host's texts are distributed over the languages, smoothed
towards its suffix's distribution and that towards the whole table's. The posterior
is the normalised product of the likelihoods and the host's prior.

A row is accepted if it has text, its likeliest language is at least ``least``
probable, and the text is like that language at all: its mean log-likelihood per gram lies
above the middle between what 99 of 100 training texts of the language reach and what a
text of grams never seen in it has (texts of under 100 grams are spared this).

Texts are scored twice, once for the counts and once for the result; between the two
only the counts by host, suffix and declaration are kept. A host with a third of all
rows is one row per task before the shuffle.

Edge cases: a null or blank text has no evidence of its own; its posterior comes from
the priors alone and it is not accepted. A null declaration, suffix or host is a
value of its own (nothing declared). Texts shorter than a gram count as one gram. Ties
between languages go to the first in ``languages``. A language without training rows
cannot be found. Repeated rows are each judged, an empty table gives no rows. Added
columns are ``language, probability, accepted, log_likelihood``; columns of those names
in the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tessera.functions.columns import named
from tessera.llm import textscan
from tessera.llm.shield import inner, restored, shielded
from tessera.llm.store import stored

GRAM = 4
BUCKETS = 1 << 16
SAMPLE_ROWS = 20_000
#: The text's evidence counts as that of at most so many independent grams.
EVIDENCE = 40.0
NEVER = -100.0
#: From so many training texts on, grams that only one of them has are left out.
FEW_TEXTS = 20
STRENGTH = 10.0
_UP = np.uint64(0x9E3779B97F4A7C15)


def gram_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash bucket of every byte GRAM-gram (A-Z as a-z, digits alike) and where each row's begin.

    A row shorter than a gram has one bucket, of all its bytes; an empty row none.
    """
    low = _FOLD[data]
    size = np.diff(offs)
    n = np.where(size == 0, 0, np.maximum(size - GRAM + 1, 1))
    first = np.concatenate(([0], np.cumsum(n)))
    if not first[-1]:
        return np.zeros(0, np.int32), first
    padded = np.concatenate((low, np.zeros(GRAM, np.uint8))).astype(np.uint32)
    gram = padded[: -GRAM]
    for i in range(1, GRAM):
        gram = gram | (padded[i : len(padded) - GRAM + i] << np.uint32(8 * i))
    at = np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(offs[:-1], n)
    gram = gram[at]
    short = np.flatnonzero((size > 0) & (size < GRAM))
    if len(short):  # without the next row's bytes
        keep = (np.uint64(1) << (8 * size[short]).astype(np.uint64)) - np.uint64(1)
        gram[first[short]] &= keep.astype(np.uint32)
    return ((gram.astype(np.uint64) * _UP) >> np.uint64(48)).astype(np.int32), first


def _fold_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[48:58] = 48
    t[[9, 10, 11, 12, 13]] = 32
    return t


_FOLD = _fold_table()


@dataclass
class TextModel:
    """Log-probability of every bucket for each language, and the least mean of a training text."""

    languages: tuple[str, ...]
    table: np.ndarray  # (languages, BUCKETS), float32
    floor: np.ndarray

    def means(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood per gram of each row for each language, and the number of grams."""
        bucket, first = gram_buckets(data, offs)
        n = np.diff(first)
        out = np.zeros((len(n), len(self.languages)))
        full = np.flatnonzero(n)
        if len(full):
            for i in range(len(self.languages)):
                sums = np.add.reduceat(self.table[i][bucket], first[full], dtype=np.float64)
                out[full, i] = sums / n[full]
        return out, n


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _count_grams(languages: Sequence[str]):
    """Texts of each language that have each bucket."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            data, offs = textscan.text_bytes(_column(batch, "text"))
            label = _column(batch, "language").to_numpy()
            for a, b in textscan.runs(offs):
                bucket, first = gram_buckets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                row = np.repeat(np.arange(b - a), np.diff(first))
                once = np.unique(row * BUCKETS + bucket)  # each text counts once for a bucket
                which = label[a:b].astype(np.int64)[once // BUCKETS] * BUCKETS + once % BUCKETS
                counts += np.bincount(which, minlength=len(languages) * BUCKETS).reshape(len(languages), BUCKETS)
        language, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"language": pa.array(language, pa.int32()),
                                          "bucket": pa.array(bucket, pa.int32()),
                                          "n": pa.array(counts[language, bucket], pa.int64())})
    return scan


def train(labelled: DataFrame, languages: Sequence[str], text: str = "text", label: str = "lang",
          sample_rows: int = SAMPLE_ROWS, strangeness: float = 0.5) -> TextModel:
    """The text model from a bounded sample of rows labelled with one of ``languages``.

    Distinct texts are chosen by their hash, ``sample_rows`` of them on average and at
    most; at most ``languages * BUCKETS`` counts and one floor a language reach the driver.
    """
    spark = labelled.sparkSession
    index = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col(label)) - 1
    known = labelled.select(F.col(text).alias("text"), index.cast("int").alias("language")).filter(
        (F.col("language") >= 0) & F.col("text").isNotNull())
    n = known.count()
    if n > sample_rows:
        share = max(1, int(sample_rows / n * 1_000_000))
        known = known.withColumn("h", F.xxhash64("text")).filter(F.pmod("h", F.lit(1_000_000)) < share)
        known = known.dropDuplicates(["h", "language"]).drop("h")  # copies of one text are one row
    known = stored(known, "language-sample")
    schema = StructType([StructField("language", IntegerType()), StructField("bucket", IntegerType()),
                         StructField("n", LongType())])
    counted = known.mapInArrow(_count_grams(languages), schema).groupBy("language", "bucket").agg(
        F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(languages)))
    counts[counted["bucket"].to_numpy(), counted["language"].to_numpy()] = counted["n"].to_numpy()
    texts = np.zeros(len(languages))
    for r in known.groupBy("language").count().collect():
        texts[r["language"]] = r["count"]
    counts[(counts == 1) & (texts >= FEW_TEXTS)] = 0  # grams of a single text are not the language's
    # A gram never seen is as likely in all languages, however many texts each has.
    sums = counts.sum(0)
    rest = 0.05 / max(1.0, sums.max())
    table = np.log((counts / np.maximum(sums, 1) + rest) / (1 + rest * BUCKETS))
    table = np.ascontiguousarray(table.T, np.float32)
    unseen = float(np.log(rest / (1 + rest * BUCKETS)))
    table[sums == 0] = NEVER  # a language without training rows is never the likeliest
    model = TextModel(tuple(languages), table, np.full(len(languages), -np.inf))
    scored = score(known.select("language", "text"), model)
    own = F.element_at("means", F.col("language") + 1)
    low = scored.filter("grams >= 100").groupBy("language").agg(F.percentile_approx(own, 0.01).alias("p")).collect()
    for r in low:
        model.floor[r["language"]] = (1 - strangeness) * r["p"] + strangeness * unseen
    return model


def score(docs: DataFrame, model: TextModel, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs``, without the text unless asked, with ``means`` and ``grams``."""
    carried = [c for c in docs.columns if (keep_text or c != text) and c not in ("means", "grams")]
    known = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            data, offs = textscan.text_bytes(_column(batch, text))
            for a, b in textscan.runs(offs):
                means, n = m.means(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                rows = batch.slice(a, b - a)
                ends = np.arange(len(n) + 1, dtype=np.int32) * len(m.languages)
                out = {c: _column(rows, c) for c in carried}
                out["means"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(means.ravel()))
                out["grams"] = pa.array(n, pa.int64())
                yield pa.RecordBatch.from_pydict(out)

    source = docs.select(*dict.fromkeys([*carried, text]))
    return source.mapInArrow(scan, StructType([source.schema[c] for c in carried] + [
        StructField("means", ArrayType(DoubleType())), StructField("grams", LongType())]))


def _argmax(values: Column) -> Column:
    """Place of the first of the largest in an array, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def _shares(counts: DataFrame, names: list[str], above: list[Column], strength: float) -> list[Column]:
    """Smoothed shares of the languages: counts and ``strength`` rows dealt as the level above."""
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return [(F.col(n) + strength * p) / (total + strength) for n, p in zip(names, above)]


@dataclass
class Evidence:
    """Log of a host's prior (by host), and of a declaration's likelihood (by declaration)."""

    hosts: DataFrame
    declared: DataFrame
    overall: list[float]


def learn(rows: DataFrame, model: TextModel, strength: float = STRENGTH) -> Evidence:
    """Priors and likelihoods from ``rows (text, declared, suffix, host)`` by grouped aggregation."""
    k = len(model.languages)
    names = [f"n{i}" for i in range(k)]
    scored = score(rows, model).filter("grams > 0")
    found = stored(scored.select("declared", "suffix", "host", _argmax(F.col("means")).alias("best")).groupBy(
        "declared", "suffix", "host", "best").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    per = [F.sum(F.when(F.col("best") == i, F.col("n")).otherwise(0)).cast("double").alias(names[i]) for i in range(k)]
    whole = found.agg(*per).first()
    sums = [whole[n] or 0.0 for n in names]
    overall = [(s + 1.0) / (sum(sums) + k) for s in sums]
    suffixes = found.groupBy("suffix").agg(*per)
    by_suffix = suffixes.select("suffix", *[c.alias(f"s{i}") for i, c in enumerate(
        _shares(suffixes, names, [F.lit(p) for p in overall], strength))])
    hosts = found.groupBy("suffix", "host").agg(*per).join(by_suffix, "suffix")
    by_host = hosts.select("suffix", "host", F.array(*[F.log(c) for c in _shares(
        hosts, names, [F.col(f"s{i}") for i in range(k)], strength)]).alias("host_log"))
    declared = found.groupBy("declared").agg(*per)
    # P(declaration | language), smoothed towards the declaration's share of all rows.
    total = sum(sums) or 1.0
    share = sum((F.col(n) for n in names[1:]), F.col(names[0])) / total
    by_declared = declared.select("declared", F.array(*[
        F.log((F.col(n) + strength * share) / (sums[i] + strength)) for i, n in enumerate(names)]).alias("declared_log"))
    return Evidence(stored(by_host, "host-priors"), stored(by_declared, "declared-likelihoods"), overall)


def identify(docs: DataFrame, model: TextModel, text: str = "text", declared: Column | None = None,
             suffix: Column | None = None, host: Column | None = None, least: float = 0.5,
             carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``language, probability, accepted, log_likelihood`` (mean per gram in that language).

    ``declared``, ``suffix`` and ``host`` are columns of ``docs``; what is not given is
    the same for all rows.
    """
    k = len(model.languages)
    added = ("language", "probability", "accepted", "log_likelihood")
    carried = [c for c in (docs.columns if carry is None else carry) if c not in added]
    value = lambda c: F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")
    keys = [value(declared).alias("declared"), value(suffix).alias("suffix"), value(host).alias("host")]
    evidence = learn(docs.select(named(text).alias("text"), *keys), model)
    if text in carried:  # the text travels once
        rows, column = docs.select(*shielded(carried), *keys), inner(carried.index(text))
    else:
        rows, column = docs.select(*shielded(carried), *keys, named(text).alias("text")), "text"
    scored = score(rows, model, column, column != "text")
    joined = scored.join(evidence.hosts, ["suffix", "host"], "left").join(evidence.declared, "declared", "left")
    # The text's likelihood counts as that of at most EVIDENCE independent grams.
    weight = F.least(F.col("grams").cast("double"), F.lit(EVIDENCE))
    unseen_host = F.array(*[F.lit(float(np.log(p))) for p in evidence.overall])
    unseen_declared = F.array(*[F.lit(0.0)] * k)
    add = lambda x, y: x + y
    logs = F.zip_with(F.transform("means", lambda m: m * weight), F.coalesce("host_log", unseen_host), add)
    logs = F.zip_with(logs, F.coalesce("declared_log", unseen_declared), add)
    joined = joined.withColumn("_logs", logs)
    top = F.array_max("_logs")
    whole = F.aggregate("_logs", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    joined = joined.withColumns({"_best": _argmax(F.col("_logs")), "_p": 1 / whole})
    likely = F.element_at("means", F.col("_best") + 1)
    floor = F.element_at(F.array(*[F.lit(float(x)) for x in model.floor]), F.col("_best") + 1)
    accepted = (F.col("grams") > 0) & (F.col("_p") >= least) & ((likely >= floor) | (F.col("grams") < 100))
    return joined.select(
        *restored(carried), F.element_at(F.array(*[F.lit(x) for x in model.languages]), F.col("_best") + 1).alias("language"),
        F.col("_p").alias("probability"), accepted.alias("accepted"),
        F.when(F.col("grams") > 0, likely).alias("log_likelihood"))


def accepted_rows(docs: DataFrame, model: TextModel, text: str = "text", declared: str | None = None,
                  suffix: str | None = None, host: str | None = None, least: float = 0.5) -> DataFrame:
    """The accepted rows of ``docs``, all columns as they were."""
    names = docs.columns
    at = lambda c: F.col(inner(names.index(c))) if c else None
    judged = identify(docs.select(*shielded(names)), model, inner(names.index(text)), at(declared), at(suffix), at(host),
                      least)
    return judged.filter("accepted").select(*restored(names))
