"""Words of frames: weights, sparse bags of words, postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgrove.functions import vectors
from glyphgrove.runtime import lookup_join, shuffled

#: Frames in one block of a postings list.
POSTINGS_BLOCK = 4096

#: Bytes of one-hot vectors that a task holds at once; a longer vector is held alone.
HOT_BYTES = 1 << 20


def present(features: DataFrame) -> DataFrame:
    """Drop features without a descriptor, and with them frames without any."""
    return features.filter(F.col("vector").isNotNull() & (F.size("vector") > 0))


def word_weights(quantised: DataFrame) -> DataFrame:
    """``(word_id, weight)``: share of all rows that fall on the word."""
    counts = quantised.groupBy("word_id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("word_id", (F.col("n") / total).alias("weight"))


def bag_of_words(
    quantised: DataFrame, words: DataFrame, weights: DataFrame | None = None
) -> DataFrame:
    """``(frame_id, word_index, weight)``, weights adding up to 1 in every frame.

    Rows are counted per (frame, word) before any lookup, so a crowded frame shrinks to its
    distinct words first. A word without a weight weighs 1.
    """
    counted = quantised.groupBy("frame_id", "word_id").agg(F.count(F.lit(1)).alias("n"))
    dictionary = words.select("word_id", "word_index")
    if weights is None:
        dictionary = dictionary.withColumn("weight", F.lit(1.0))
    else:
        # both sides have one row per word; joined first, the counts are shuffled once
        dictionary = shuffled(dictionary).join(weights.select("word_id", "weight"), "word_id", "left")
    indexed = lookup_join(counted, dictionary, ["word_id"], hot=True)
    raw = F.col("n") * F.coalesce("weight", F.lit(1.0))
    # at most one row per distinct word in a frame by now, so the window is bounded
    total = F.sum("raw").over(W.partitionBy("frame_id"))
    return indexed.select("frame_id", "word_index", raw.alias("raw")).select(
        "frame_id", "word_index", (F.col("raw") / total).alias("weight")
    )


def one_hot_words(weighted: DataFrame, size: int, block_bytes: int = HOT_BYTES) -> DataFrame:
    """``(frame_id, pos, word_index, nonzero, weight)`` from rows with ``word_index`` and ``weight``.

    Each row's dense one-hot vector over the ``size`` words is built, its elements other than zero are counted, and
    the one at ``word_index`` is read. That is rows times words elements, so they are numpy blocks of a few vectors,
    which stay in the task. A word without a weight weighs 1.
    """
    kept = ["frame_id", "pos", "word_index"]
    rows = weighted.select(*kept, F.coalesce("weight", F.lit(1.0)).cast("double").alias("weight"))
    schema = T.StructType([
        *(rows.schema[c] for c in kept), T.StructField("nonzero", T.IntegerType()),
        T.StructField("weight", T.DoubleType()),
    ])
    step = max(1, block_bytes // (8 * max(1, size)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            without = np.asarray(batch.column("word_index").is_null())
            index = batch.column("word_index").fill_null(-1).to_numpy()
            weight = batch.column("weight").to_numpy()
            nonzero, read = np.zeros(len(index), np.int32), np.zeros(len(index))
            for a in range(0, len(index), step):
                at = index[a : a + step]
                hot = vectors.one_hot(at, weight[a : a + step], size)
                nonzero[a : a + step] = vectors.count_nonzero(hot)
                read[a : a + step] = hot[np.arange(len(at)), at]
            columns = [*(batch.column(c) for c in kept), pa.array(nonzero), pa.array(read, mask=without)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return rows.mapInArrow(work, schema)


def missing_words(quantised: DataFrame, words: DataFrame) -> DataFrame:
    """Words of the data that the dictionary lacks; a strict caller expects none."""
    return quantised.select("word_id").distinct().join(words, "word_id", "left_anti")


def nonzero_words(bow: DataFrame) -> DataFrame:
    """``(frame_id, nonzero)``."""
    return bow.filter("weight <> 0").groupBy("frame_id").agg(F.count(F.lit(1)).alias("nonzero"))


def postings(bow: DataFrame, block: int = POSTINGS_BLOCK) -> DataFrame:
    """``(word_index, block, frames MAP<frame_id, weight>)``.

    A word's list is cut by frame number, so the list of a word found in every frame is spread over
    many rows of at most ``block`` entries.
    """
    return (
        bow.filter("weight > 0")
        .withColumn("block", F.floor(F.col("frame_id") / block).cast("bigint"))
        .groupBy("word_index", "block")
        .agg(F.sort_array(F.collect_list(F.struct("frame_id", "weight"))).alias("_f"))
        .select("word_index", "block", F.map_from_entries("_f").alias("frames"))
    )
