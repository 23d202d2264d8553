"""A training corpus from raw documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents the stage before it
kept, and returns a DataFrame that is written as Parquet and read again as the next
stage's input. All but the last return the columns of ``documents`` unchanged, without
the rows they drop:

1. language ID: documents that are in none of the languages go;
2. n-gram Jaccard join, of 5-word shingles with a Jaccard similarity of 0.8 or more (the
   query ``op4_partenum_jaccard`` has its own 4 words and 0.85): of each group of
   near-duplicates one row stays, that with the smallest id (a null id is the largest; of
   rows that share the id, the one with the smallest hash of all columns; of equal rows
   one). Rows without words are in no group and stay;
3. benchmark decontamination: contaminated documents go;
4. SentencePiece encoding: the sampled segmentations of what is left, with the pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import named
from tessera.llm import decontaminate, language_id, partenum, queries, sp_sampling
from tessera.llm.shield import restored, shielded
from tessera.llm.store import stored

#: Words of a shingle, and the least Jaccard similarity of near-duplicates in percent.
SHINGLE, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.small_batches(spark)
    model = language_id.train(docs, queries.LANGUAGES)
    return language_id.accepted_rows(docs, model, declared="lang", host="source")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.small_batches(spark)
    told = [x for c in docs.columns for x in (named(c), named(c).isNull())]
    rows = docs.select(*shielded(docs.columns), named("doc_id").cast("long").alias("id"), named("text").alias("text"),
                       F.xxhash64(*told).alias("row"))
    joined = partenum.jaccard_components(rows, "id", "text", SHINGLE, PERCENT, row="row")
    # Only what goes is looked up: the other rows of each component.
    lost, again = _not_first(joined)
    same = lambda t: F.col("r.id").eqNullSafe(t["id"]) & (F.col("r.row") == t["row"])
    told = _marked(rows.drop("text"), lost.union(again))
    sure = told.filter("NOT maybe").drop("maybe")
    kept = told.filter("maybe").drop("maybe").alias("r").join(lost, same(lost), "left_anti")
    if not again.isEmpty():  # equal rows, of which one stays
        once, many = (kept.join(again, same(again), how) for how in ("left_anti", "left_semi"))
        kept = once.unionByName(many.dropDuplicates(["id", "row"]))
    return sure.unionByName(kept).select(*restored(docs.columns))


def _marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with a column ``maybe``: false only for rows whose ``id, row`` are none of ``keys``. They are told
    by a bitmap of bounded size, so that only the others travel to be looked up."""
    n_bits = min(partenum.MAX_BITS, max(1 << 12, 1 << (8 * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64("id", "row"), F.lit(n_bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("slot"), F.lit(64)).cast("int"))
    words = stored(keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(bit).alias("bits")), "lost-bitmap")
    at = rows.withColumn("slot", slot).withColumn("word", F.shiftright("slot", 6)).join(F.broadcast(words), "word", "left")
    return at.withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))).drop("slot", "word", "bits")


def _not_first(joined: partenum.Join) -> tuple[DataFrame, DataFrame]:
    """``id, row`` of the rows that are not their component's first, and of the first ones that occur again."""
    found = joined.keys.filter("n_shingles > 0").groupBy("node", "id", "row").agg(F.count(F.lit(1)).alias("n"))
    found = stored(found.join(joined.roots, "node").select("root", "id", "row", "n"), "near-duplicate-rows")
    # First the least id, then the least row of those with it.
    ids = found.groupBy("root").agg(F.min("id").alias("first_id"), F.sum("n").alias("n_rows")).filter("n_rows > 1")
    mine = stored(found.join(stored(ids.select("root", "first_id"), "first-ids"), "root"), "near-duplicate-groups")
    first = mine.filter("id <=> first_id").groupBy("root").agg(F.min("row").alias("first_row"))
    placed = mine.join(stored(first, "first-rows"), "root")
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("row") == F.col("first_row"))
    lost = placed.filter(~is_first).select("id", "row").distinct()
    again = placed.filter(is_first & (F.col("n") > 1)).select("id", "row")
    return stored(lost, "near-duplicates"), stored(again, "equal-rows")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.small_batches(spark)
    return decontaminate.remove_documents(docs, queries.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    queries.small_batches(spark)
    return sp_sampling.encode(docs, queries.tokenizer_path("piece_bpe_32k.model"), queries.SAMPLES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]

#: Language ID and sampling cannot be said in SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written to the shared folder and read again."""
    out = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stored(stage(spark, out, sf_dir), f"pipeline-{name}")
    return out
