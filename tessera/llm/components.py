"""Connected components of a graph given as an edge table, by alternating stars.

Each round replaces the edges by stars: every node's larger neighbours are hung on
the smallest node it knows, then every node hangs its smaller neighbours there. The
number of rounds grows with the logarithm of the longest path. A round is one table
written: the smallest neighbours are joined back by ``dealt_anew`` keys, so both sides
of the join are plain exchanges that Spark splits where one node has very many edges.
The rounds end when the edges are stars, not when a further round has changed nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import stored


def dealt_anew(key: str) -> Column:
    """The values of a long column of an aggregate as another key: a join by it does not take over the aggregate's
    partitions, of which Spark splits none."""
    return F.col(key).bitwiseXOR(F.lit(0)).alias(key)


def _hang(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over ``edges (u, v)``, u > v."""
    if larger:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(dealt_anew("u"), F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if larger:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of ``edges (u, v)``, u > v, hangs on one node at most, and that one on none."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("on")).union(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("on")))
    per = ends.groupBy("node").agg(F.min("on").alias("lo"), F.max("on").alias("hi"),
                                   F.bool_or(F.col("on").isNull()).alias("holds"))
    return not per.filter("lo IS NOT NULL AND (holds OR lo <> hi)").count()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)`` but the roots, as a stored table; a root is its component's
    least node."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if _are_stars(e):
        e = stored(e.distinct(), "edges")
    else:
        e = stored(_hang(_hang(e, True), False), "edges")
        while not _are_stars(e):
            e = stored(_hang(_hang(e, True), False), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
