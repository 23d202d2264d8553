"""Filter interaction audit as an incremental stream with retraction.

Five filters judge a text: A under 100 words; B ``100 * distinct words < 80 * words``; C
``100 * [A-Z] characters > 10 * code points``; D any of ``#$%&*|``; E equal to the text of a
smaller id. The failed ones make a mask. A to D follow from the text, E depends on rows that may
come later, so the files are read as micro-batches (available now: all that there are, then it
ends): keyed state has each text's smallest id and the rows that have it. Every row that has an
id is counted under its mask with E; the state's rows are counted again without it (+n) and
retracted with it (-n). When a smaller id arrives, that of the rows held before is taken back.
Each batch adds its changes to the part counters, one row for each (part, mask); the counters'
sums then give every order of the filters at once.

The keyed state is a table under the folder in ``spark.checkpoint.dir``: a batch adds the rows
of its smallest ids that are no larger than those held, and a text's state is its rows of the
smallest id. Batches meet the state in joins and aggregates, so it may exceed memory, and
nothing is rewritten. Only rows of smallest ids meet by their text: a text's other rows are
dealt by text and id, and its smallest id is found in each task first. A batch that fails is
taken again from the stream's checkpoint; its state and its counters are folders of its own that
a repeated batch overwrites, and it reads the state of earlier batches only. A call has
``MAX_BATCHES`` batches at most, as each reads the state once. With the same ``folder`` a later
call reads only files that have come since.

Edge cases: a null text is empty (A fails, B to D do not), a null part is the empty string; a
null id has no smaller one and is smaller than none, so it neither fails E nor makes others fail;
rows with the same id and text all have the smallest id, so repeats of one row do not fail E;
repeated label rows count if any says 1; null labels are no 1; an empty table has no parts. Texts
are keyed by SHA-256. Further columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.columns import named
from tessera.llm.store import drop, stored
from tessera.session import scratch_path

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
#: Files of a micro-batch for each core of the cluster, and the most batches of a call.
FILES_PER_CORE, MAX_BATCHES = 16, 8


def text_masks(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``mask`` of filters A to D of their ``text`` in place of it."""
    text = F.col("text")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("words", words).withColumn("n_words", F.size("words")).withColumn(
        "n_distinct", F.size(F.array_distinct("words"))).withColumn("chars", F.char_length(text))
    n, distinct, chars = F.col("n_words"), F.col("n_distinct"), F.col("chars")
    capitals = chars - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * chars,
             "D": text.rlike(r"[#$%&*|]")}
    mask = sum((F.when(c, BIT[f]).otherwise(0) for f, c in fails.items()), F.lit(0))
    return rows.withColumn("mask", mask).drop("text", "words", "n_words", "n_distinct", "chars")


def label_flags(labels: DataFrame) -> DataFrame:
    """``id, good, toxic``, one row for each labelled id."""
    return labels.select(named("doc_id").cast("long").alias("id"), named("quality").alias("q"), named("toxic").alias("t")).filter(
        "id IS NOT NULL").groupBy("id").agg(F.coalesce(F.max(F.col("q") == 1), F.lit(False)).alias("good"),
                                            F.coalesce(F.max(F.col("t") == 1), F.lit(False)).alias("toxic"))


_KIND = ["part", "mask", "good", "toxic"]
_HELD = "key binary, id long, part string, mask int, good boolean, toxic boolean, n long"
_DELTA = "part string, mask int, good boolean, toxic boolean, n long"


def _changes(told: DataFrame, held: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Changes of the counters by a batch's rows ``told``, and the rows that it adds to the state ``held``."""
    least = told.filter("id IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"))
    # By text and id: rows of a text that occurs very often are spread.
    placed = told.join(least, ["key", "id"], "left_semi").withColumn("was", F.lit(False))
    if held is not None:
        placed = placed.unionByName(held.join(least.select("key"), "key", "left_semi").withColumn("was", F.lit(True)))
    text = Window.partitionBy("key")
    placed = placed.withColumn("now", F.min("id").over(text)).withColumn(
        "before", F.min(F.when(F.col("was"), F.col("id"))).over(text))
    placed = stored(placed.filter("id = now OR was AND id = before").withColumn(
        "n", F.col("n") * (F.when(F.col("id") == F.col("now"), 1).otherwise(0)
                           - F.when(F.col("was") & (F.col("id") == F.col("before")), 1).otherwise(0))).filter(
        "n <> 0").drop("now", "before"), "audit-placed")
    fails = F.col("mask").bitwiseOR(BIT["E"])
    every = told.withColumn("mask", F.when(F.col("id").isNull(), F.col("mask")).otherwise(fails))
    retracted = placed.withColumn("mask", fails).withColumn("n", -F.col("n"))
    changes = every.select(*_KIND, "n").union(placed.select(*_KIND, "n")).union(retracted.select(*_KIND, "n"))
    return changes.groupBy(*_KIND).agg(F.sum("n").alias("n")), placed


def part_counters(spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None,
                  files_per_batch: int | None = None) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part by failed filters, and how many of them have
    quality 1 or toxic 1. Reads the Parquet files at ``path`` that ``folder`` has not counted yet."""
    folder = folder or scratch_path(spark, "filter-audit")
    if files_per_batch is None:
        n_files = len(spark.read.parquet(path).inputFiles())
        files_per_batch = max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, -(-n_files // MAX_BATCHES))
    flags = stored(label_flags(labels), "label-flags")
    docs = spark.readStream.schema(_columns(spark, path)).option("maxFilesPerTrigger", files_per_batch).parquet(_as_source(spark, path))
    rows = docs.select(named("doc_id").cast("long").alias("id"), F.coalesce(named("lang"), F.lit("")).alias("part"),
                       F.coalesce(named("text"), F.lit("")).alias("text"))
    rows = text_masks(rows.withColumn("key", F.unhex(F.sha2("text", 256))))
    told = rows.join(flags, "id", "left").select("key", "id", "part", "mask", *(
        F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))

    def add(batch: DataFrame, number: int) -> None:
        mine = stored(batch.groupBy("key", "id", *_KIND).agg(F.count(F.lit(1)).alias("n")), "audit-rows")
        held = batch.sparkSession.read.schema(f"{_HELD}, batch long").parquet(f"{folder}/held").filter(
            F.col("batch") < number).drop("batch") if number else None
        changes, placed = _changes(mine, held)
        placed.filter("NOT was").drop("was").write.mode("overwrite").parquet(f"{folder}/held/batch={number}")
        changes.write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")
        drop(mine, placed)

    run = told.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True).foreachBatch(add).start()
    run.awaitTermination()
    counted = spark.read.schema(f"{_DELTA}, batch long").parquet(f"{folder}/counters")
    return counted.groupBy("part", "mask").agg(*(
        F.sum(F.when(F.lit(True) if c is None else F.col(c), F.col("n")).otherwise(0)).alias(name)
        for name, c in (("documents", None), ("good_documents", "good"), ("toxic_documents", "toxic")))).filter("documents > 0").select(
            "part", "mask", F.col("documents").alias("n"), F.col("good_documents").alias("good"),
            F.col("toxic_documents").alias("toxic"))


def _columns(spark: SparkSession, path: str) -> StructType:
    return spark.read.parquet(path).schema


def _as_source(spark: SparkSession, path: str) -> str:
    """A streaming source takes a folder or a pattern: a single file becomes a pattern that only it fits."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    one = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    return f"{path[:-1]}[{path[-1]}]" if one else path


def interactions(counters: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from ``part, mask, n, good, toxic``."""
    orders = F.split(F.lit(" ".join("".join(o) for o in permutations(FILTERS))), " ")
    # At most 32 rows a part, each meets every order and step.
    at = counters.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda fits: sum((F.when(fits(F.instr("filter_order", f), F.col("step")), b).otherwise(0)
                             for f, b in BIT.items()), F.lit(0))
    at = at.withColumn("bit", bits(lambda p, s: p == s)).withColumn("prior", bits(lambda p, s: p < s))
    m, bit, prior = F.col("mask"), F.col("bit"), F.col("prior")
    fails, passed = m.bitwiseAND(bit) != 0, m.bitwiseAND(prior) == 0
    total = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0)).cast("long")
    # Over all orders a mask of k failed filters is removed by each of them equally often.
    shapley = F.sum(F.when(fails, F.col("n") * (F.lit(120) / F.bit_count(m)).cast("long")).otherwise(0)).cast("long")
    return at.groupBy("part", "filter_order", "step").agg(
        total(m.bitwiseAND(bit.bitwiseOR(prior)) == 0, "n").alias("kept"), total(fails & passed, "n").alias("removed"),
        total(fails & ~passed, "n").alias("redundant"), total(m == bit, "n").alias("unique_fails"),
        total(fails & passed, "good").alias("good_lost"), total(fails & passed, "toxic").alias("toxic_lost"),
        shapley.alias("shapley"))


def audit(spark: SparkSession, path: str, labels: DataFrame, folder: str | None = None,
          files_per_batch: int | None = None) -> DataFrame:
    """``interactions`` of all files at ``path``."""
    return interactions(part_counters(spark, path, labels, folder, files_per_batch))
