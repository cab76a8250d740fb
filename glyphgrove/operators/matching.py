"""Feature matches between consecutive frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrove.functions.metrics import Metric, hamming, l2, percent_equal, resolve
from glyphgrove.functions.paths import ancestor, prefixes
from glyphgrove.runtime import lookup_join, shuffled

#: Previous features packed in one block of the brute-force comparison.
BLOCK_ROWS = 256


def compare(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Add the comparisons of two vectors in a row: equality, percent equal, Hamming, L2."""
    left, right = F.col(a), F.col(b)
    return pairs.select(
        "*",
        (left == right).alias("exact"),
        percent_equal(left, right).alias("percent"),
        hamming(left, right).alias("hamming"),
        l2(left, right).alias("l2"),
    )


def brute_force(
    features: DataFrame, frame_pairs: DataFrame, metric: str | Metric = "hamming",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Compare every feature of a frame with every feature of its partner frame.

    ``features`` are ``(frame_id, pos, vector)``, ``frame_pairs`` ``(frame_id, prev_frame_id)``
    with one partner per frame. The result has one row per feature: how many partners were
    compared, how many are equal, and the nearest one (lowest ``prev_pos`` on ties) with its
    comparisons. Partners are packed in blocks and a feature emits one row per block, so the
    pairs themselves never leave a task.
    """
    metric = resolve(metric)
    current = lookup_join(
        features.select("frame_id", "pos", "vector"), frame_pairs, ["frame_id"], hot=True
    )
    blocks = F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")
    sized = features.groupBy(F.col("frame_id").alias("prev_frame_id")).agg(blocks)
    packed = (
        lookup_join(
            features.select(F.col("frame_id").alias("prev_frame_id"), "pos", "vector"),
            sized, ["prev_frame_id"], hot=True,
        )
        .withColumn("block", F.pmod(F.xxhash64("pos"), F.col("blocks")).cast("int"))
        .groupBy("prev_frame_id", "block")
        .agg(F.collect_list(F.struct("pos", "vector")).alias("others"))
    )
    asked = lookup_join(current, sized, ["prev_frame_id"], hot=True).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    met = lookup_join(asked.drop("blocks"), packed, ["prev_frame_id", "block"])
    distances = F.transform(
        "others",
        lambda o: F.struct(
            metric.point(F.col("vector"), o["vector"]).alias("dist"),
            o["pos"].alias("prev_pos"), o["vector"].alias("prev_vector"),
        ),
    )
    per_block = met.select(
        "frame_id", "prev_frame_id", "pos", "vector",
        F.size("others").alias("compared"),
        F.size(F.filter("others", lambda o: o["vector"] == F.col("vector"))).alias("equal"),
        F.array_min(distances).alias("best"),
    )
    best = per_block.groupBy("frame_id", "prev_frame_id", "pos").agg(
        F.sum("compared").alias("compared"),
        F.sum("equal").alias("equal"),
        F.min(F.struct("best", "vector")).alias("_b"),
    )
    chosen = best.select(
        "frame_id", "prev_frame_id", "pos", "compared", "equal",
        F.col("_b.best.prev_pos").alias("prev_pos"),
        F.col("_b.vector").alias("vector"), F.col("_b.best.prev_vector").alias("prev_vector"),
    )
    return compare(chosen, "vector", "prev_vector").drop("vector", "prev_vector", "exact")


def candidate_matches(
    quantised: DataFrame, frame_pairs: DataFrame, distance: int = 1
) -> DataFrame:
    """``(frame_id, pos, prev_frame_id, prev_pos)``: features whose words are neighbours.

    A feature of the current frame meets each word of the previous frame below its own ancestor,
    at the first position where that word occurs. The join key is the ancestor itself, so no list
    of neighbouring words is built.
    """
    firsts = quantised.groupBy("frame_id", "word_id").agg(F.min("pos").alias("prev_pos"))
    earlier = firsts.select(
        F.col("frame_id").alias("prev_frame_id"),
        F.explode(prefixes(F.col("word_id"))).alias("ancestor_id"),
        "prev_pos",
    )
    current = lookup_join(
        quantised.select("frame_id", "pos", "word_id"), frame_pairs, ["frame_id"], hot=True
    )
    current = current.withColumn("ancestor_id", ancestor(F.col("word_id"), distance))
    return shuffled(current).join(earlier, ["prev_frame_id", "ancestor_id"]).select(
        "frame_id", "pos", "prev_frame_id", "prev_pos"
    )


def neighbour_map(quantised: DataFrame, words: DataFrame, distance: int = 1) -> DataFrame:
    """``(frame_id, neighbour_id, word_id)``: each word near a word of the frame.

    Where several words of the frame claim a neighbour, the one with the largest index stays.
    """
    used = quantised.select("frame_id", "word_id").distinct()
    used = lookup_join(used, words.select("word_id", "word_index"), ["word_id"])
    claims = (
        used.withColumn("ancestor_id", ancestor(F.col("word_id"), distance))
        .groupBy("frame_id", "ancestor_id")
        .agg(F.max(F.struct("word_index", "word_id")).alias("claim"))
    )
    below = words.select(
        F.explode(prefixes(F.col("word_id"))).alias("ancestor_id"),
        F.col("word_id").alias("neighbour_id"),
    )
    return (
        shuffled(claims).join(below, "ancestor_id")
        .groupBy("frame_id", "neighbour_id")
        .agg(F.max("claim").alias("claim"))
        .select("frame_id", "neighbour_id", F.col("claim.word_id").alias("word_id"))
    )


def uncovered_words(
    pairs: DataFrame, quantised: DataFrame, distance: int = 1
) -> DataFrame:
    """``(query_id, frame_id, total, uncovered)``: words of the query not near any word of the frame.

    ``pairs`` are ``(query_id, frame_id)`` with one partner per query. A word is covered when one
    of its ancestors is the ancestor of a word of the frame.
    """
    used = quantised.select("frame_id", "word_id").distinct()
    asked = lookup_join(
        used.withColumnRenamed("frame_id", "query_id"),
        pairs.select("query_id", "frame_id"), ["query_id"],
    ).withColumn("ancestor_id", F.explode(prefixes(F.col("word_id"))))
    near = used.select("frame_id", ancestor(F.col("word_id"), distance).alias("ancestor_id"))
    near = near.distinct().withColumn("hit", F.lit(1))
    per_word = (
        lookup_join(asked, near, ["frame_id", "ancestor_id"], "left")
        .groupBy("query_id", "frame_id", "word_id")
        .agg(F.max("hit").alias("hit"))
    )
    return per_word.groupBy("query_id", "frame_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("uncovered"),
    )
