"""Connected components of an edge table, for graphs that are mostly small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrove.llm.common import materialise


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least node it sees."""
    both = _both_ways(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (
        both.where("v > u").join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of these. Edges point downwards."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): the root is the least node reachable.

    Alternates the two star operations until only stars are left, a number of rounds that grows with the
    logarithm of the longest path. Every round is written to the scratch folder; nothing but the answer
    whether it was the last reaches the driver. Self-loops and repeated edges do no harm, no edges give no
    rows.
    """
    now = edges.where("u <> v")
    while True:
        now = materialise(_small_star(_large_star(now)), "components")
        parts = now.select(F.explode(F.array(
            F.struct(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")),
            F.struct(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")),
        )).alias("p")).select("p.*")
        counts = parts.groupBy("x").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
        # a leaf hangs on one node, and a node that others hang on hangs on none
        if counts.where((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0))).isEmpty():
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
