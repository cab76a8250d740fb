"""Inverted index of frames in blocks with upper bounds, kept incrementally, and searches that skip blocks.

A word's postings are cut by frame number into blocks of consecutive frames; each block knows the
largest weight in it. For a query, the sum over its words of the lesser of its own weight and the block's
largest bounds the score of every frame of the block, since the score is the sum of lesser weights. Blocks
whose bound cannot matter are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgrove.operators.similarity import SLACK
from glyphgrove.runtime import materialise, shuffled
from glyphgrove.sources.segments import FANOUT, SegmentLog

#: Consecutive frames in a block.
BLOCK_FRAMES = 64

#: Distinct blocks that are named to the scan, which then skips the rest of the files.
NAMED_BLOCKS = 1000

POSTINGS = T.StructType([
    T.StructField("stream_id", T.LongType()), T.StructField("block", T.LongType()),
    T.StructField("word_index", T.LongType()), T.StructField("most", T.DoubleType()),
    T.StructField("frames", T.LongType()),
    T.StructField("entries", T.ArrayType(T.StructType([
        T.StructField("seq", T.LongType()), T.StructField("frame_id", T.LongType()),
        T.StructField("time_us", T.LongType()), T.StructField("weight", T.DoubleType()),
    ]))),
])

_KEY = ["stream_id", "block", "word_index"]


def _block(seq: Column) -> Column:
    return F.floor(seq / BLOCK_FRAMES).cast("long")


def to_blocks(bags: DataFrame) -> DataFrame:
    """Postings blocks of bags ``(stream_id, frame_id, seq, time_us, word_index, weight)``, weights above 0."""
    entry = F.struct(
        F.col("seq").cast("long").alias("seq"), F.col("frame_id").cast("long").alias("frame_id"),
        F.col("time_us").cast("long").alias("time_us"), "weight",
    )
    return bags.filter("weight > 0").groupBy(
        F.col("stream_id").cast("long").alias("stream_id"), _block(F.col("seq")).alias("block"),
        F.col("word_index").cast("long").alias("word_index"),
    ).agg(
        F.max("weight").alias("most"), F.count(F.lit(1)).alias("frames"),
        # at most BLOCK_FRAMES entries
        F.sort_array(F.collect_list(entry)).alias("entries"),
    )


def merge_blocks(rows: DataFrame) -> DataFrame:
    """Join the parts of blocks that were written by different batches."""
    return rows.groupBy(*_KEY).agg(
        F.max("most").alias("most"), F.sum("frames").alias("frames"),
        F.sort_array(F.flatten(F.collect_list("entries"))).alias("entries"),
    )


def open_index(spark: SparkSession, folder: str, fanout: int = FANOUT) -> SegmentLog:
    """The index kept under ``folder``; ``append(batch, to_blocks(bags))`` adds the frames of a batch."""
    return SegmentLog(spark, folder, POSTINGS, _KEY, merge_blocks, fanout)


def word_frequencies(index: DataFrame) -> DataFrame:
    """``(stream_id, word_index, frames)``: in how many frames of a stream each word occurs."""
    return index.groupBy("stream_id", "word_index").agg(F.sum("frames").alias("frames"))


def block_bounds(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``(stream_id, query_id, block, bound, until)`` of all blocks a query may look into.

    ``queries`` are ``(stream_id, query_id, until, word_index, weight)``: frames numbered up to ``until`` may be
    found. Only the largest weights are read, not the entries.
    """
    known = index.groupBy(*_KEY).agg(F.max("most").alias("most"))
    met = shuffled(queries).join(known, ["stream_id", "word_index"]).filter(
        F.col("block") * BLOCK_FRAMES <= F.col("until"))
    return met.groupBy("stream_id", "query_id", "block", "until").agg(
        F.sum(F.least("weight", "most")).alias("bound"))


def block_scores(index: DataFrame, queries: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(stream_id, query_id, frame_id, seq, time_us, score)`` of all frames in the blocks ``wanted`` names.

    ``wanted`` are ``(stream_id, query_id, block)``. Up to NAMED_BLOCKS distinct blocks are pushed down to the scan.
    """
    named = wanted.select("block").distinct().limit(NAMED_BLOCKS + 1).collect()
    if len(named) <= NAMED_BLOCKS:
        index = index.filter(F.col("block").isin([r["block"] for r in named]))
    asked = wanted.select("stream_id", "query_id", "block")
    asked = shuffled(asked).join(queries, ["stream_id", "query_id"])
    met = shuffled(asked).join(index.select(*_KEY, "entries"), _KEY)
    rows = met.select(
        "stream_id", "query_id", "until", F.col("weight").alias("own"), F.inline("entries")
    ).filter(F.col("seq") <= F.col("until"))
    return rows.groupBy("stream_id", "query_id", "frame_id", "seq", "time_us").agg(
        F.sum(F.least("own", "weight")).alias("score"))


def frames_above(index: DataFrame, queries: DataFrame, bars: DataFrame) -> DataFrame:
    """All frames that score above their query's ``threshold`` in ``bars (stream_id, query_id, threshold)``."""
    keys = ["stream_id", "query_id"]
    wanted = materialise(
        shuffled(block_bounds(index, queries)).join(bars, keys).filter(F.col("bound") > F.col("threshold") - SLACK)
        .select(*keys, "block"),
        "blocks",
    )
    found = shuffled(block_scores(index, queries, wanted)).join(bars, keys)
    return found.filter(F.col("score") > F.col("threshold")).drop("threshold")


def best_past(index: DataFrame, queries: DataFrame) -> DataFrame:
    """The best frame of each query that shares a word with any: ``(stream_id, query_id, best_seq, score)``.

    The block with the highest bound is scored first (one that is wholly allowed, if there is one); then
    only blocks whose bound reaches the score found there. Equal scores (12 digits) go to the lowest number.
    """
    keys = ["stream_id", "query_id"]
    bounds = materialise(block_bounds(index, queries), "bounds")
    whole = (F.col("block") + 1) * BLOCK_FRAMES - 1 <= F.col("until")
    first = materialise(
        bounds.groupBy(*keys).agg(F.max(F.struct(
            whole.alias("whole"), F.col("bound"), (-F.col("block")).alias("neg"))).alias("_f"))
        .select(*keys, (-F.col("_f.neg")).alias("block")),
        "first",
    )
    best = F.max(F.struct(F.round("score", 12).alias("score"), (-F.col("seq")).alias("neg"))).alias("_b")
    opened = materialise(block_scores(index, queries, first).groupBy(*keys).agg(best), "opened")
    rest = materialise(blocks_left(bounds, first, opened), "rest")
    more = block_scores(index, queries, rest).groupBy(*keys).agg(best)
    return opened.unionByName(more).groupBy(*keys).agg(F.max("_b").alias("_b")).select(
        *keys, (-F.col("_b.neg")).alias("best_seq"), F.col("_b.score").alias("score"))


def blocks_left(bounds: DataFrame, first: DataFrame, opened: DataFrame) -> DataFrame:
    """The blocks that may still hold a frame as good as the one found in the ``first`` block."""
    keys = ["stream_id", "query_id"]
    open_ = shuffled(shuffled(bounds).join(first, [*keys, "block"], "left_anti")).join(opened, keys, "left")
    return open_.filter(
        F.col("_b").isNull() | (F.col("bound") >= F.col("_b.score") - SLACK)).select(*keys, "block")
