"""Frame streams: key frames and Kalman tracks with keyed state, matching and retrieval per batch.

Micro-batches must arrive in frame order; within a batch rows may come in any order.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphgrove.operators import postings
from glyphgrove.operators.frames import KEYFRAME_GAP, KEYFRAME_POINTS
from glyphgrove.operators.kalman import OUTPUTS, Model, gain_table, track
from glyphgrove.operators.matching import candidate_matches
from glyphgrove.runtime import lookup_join, materialise, release, shuffled


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def state_provider(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which typed state needs, whatever the session says."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def read_frames(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stream of frame or feature rows from a folder of parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def run_available(writer, checkpoint: str) -> None:
    """Process everything that has arrived, then stop."""
    started: StreamingQuery = (
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    started.awaitTermination()


def sink_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    run_available(stream.writeStream.format("parquet").option("path", path).outputMode("append"),
                  checkpoint)


def _batch(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(order, ignore_index=True)


def pick_key_frames(points: np.ndarray, count: int, inserted: int, gap: int, min_points: int) -> np.ndarray:
    """Which of the frames numbered from ``count`` + 1 are key frames; one step per key frame, not per frame."""
    out = np.zeros(len(points), bool)
    eligible = np.flatnonzero(points > min_points) + count + 1
    at = np.searchsorted(eligible, inserted + gap + 1, "right")
    while at < len(eligible):
        inserted = int(eligible[at])
        out[inserted - count - 1] = True
        at = np.searchsorted(eligible, inserted + gap + 1, "right")
    return out


def keyframe_stream(
    frames: DataFrame,
    key: str,
    order: list[str],
    points: str,
    gap: int = KEYFRAME_GAP,
    min_points: int = KEYFRAME_POINTS,
) -> DataFrame:
    """Frames the insertion rule selects, with their counter ``seq``.

    State per stream: frames seen and the counter at the last insertion.
    """
    schema = T.StructType([*frames.schema.fields, T.StructField("seq", T.LongType())])

    def advance(
        _key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, 0)
        rows = _batch(batches, order)
        picked = np.flatnonzero(pick_key_frames(rows[points].to_numpy(), count, last, gap, min_points))
        out = rows.iloc[picked].assign(seq=picked + count + 1)
        state.update((count + len(rows), int(out["seq"].iloc[-1]) if len(out) else last))
        yield out[schema.fieldNames()]

    return frames.groupBy(key).applyInPandasWithState(
        advance, schema, "count bigint, last bigint", "append", GroupStateTimeout.NoTimeout
    )


def kalman_stream(
    measurements: DataFrame, key: str, order: list[str], value: str, model: Model = Model()
) -> DataFrame:
    """Tracks as in batch. State per key: steps done, angle, rate; the covariance follows the steps."""
    table = gain_table(model)
    schema = T.StructType(
        [
            *measurements.schema.fields,
            T.StructField("step", T.LongType()),
            *[T.StructField(c, T.DoubleType()) for c in OUTPUTS],
        ]
    )

    def advance(
        _key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        done, angle, rate = state.get if state.exists else (0, 0.0, 0.0)
        rows = _batch(batches, order)
        rows[OUTPUTS], (angle, rate) = track(rows[value].to_numpy(float), done, (angle, rate), table)
        rows["step"] = np.arange(done + 1, done + len(rows) + 1)
        state.update((done + len(rows), angle, rate))
        yield rows[schema.fieldNames()]

    return measurements.groupBy(key).applyInPandasWithState(
        advance, schema, "done bigint, angle double, rate double", "append",
        GroupStateTimeout.NoTimeout,
    )


def _store(batch: DataFrame, path: str, batch_id: int) -> None:
    # a replayed batch overwrites its own folder, so each batch counts once
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def prev_match_stream(
    features: DataFrame, quantise: Callable[[DataFrame], DataFrame], tails_path: str,
    matches_path: str,
):
    """Writer that matches the features of each frame with those of the frame before.

    ``features`` carry ``stream_id``, ``seq``, ``frame_id``, ``prev_frame_id`` and ``pos``;
    ``quantise`` adds ``word_id``. After each batch only the words of the last frame of every
    stream are stored: the first frame of the next batch needs no more.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = ["stream_id", "seq", "frame_id", "prev_frame_id", "pos", "word_id"]
        fresh = materialise(quantise(batch).select(*kept), "batch-words")
        known = fresh
        if batch_id:
            before = spark.read.schema(fresh.schema).parquet(f"{tails_path}/batch={batch_id - 1}")
            known = fresh.unionByName(before)
        pairs = fresh.filter("prev_frame_id is not null").select("frame_id", "prev_frame_id").distinct()
        _store(candidate_matches(known, pairs), matches_path, batch_id)
        newest = known.groupBy("stream_id").agg(F.max("seq").alias("seq"))
        tail = lookup_join(known, newest, ["stream_id", "seq"], "left_semi")
        _store(tail.select(*kept), tails_path, batch_id)

    return features.writeStream.foreachBatch(handle)


def retrieve_stream(
    features: DataFrame, to_bags: Callable[[DataFrame], DataFrame], index_path: str,
    found_path: str, exclude_recent: int = 100,
):
    """Writer that indexes the bags of new frames and looks up their best earlier frame.

    ``features`` carry ``stream_id``, ``frame_id`` and ``seq``; ``to_bags`` gives ``(frame_id, word_index,
    weight)``. The index under ``index_path`` grows by a segment per batch; a search reads the bounds of the
    blocks that hold the words of new frames, and the entries of the blocks that may hold their best frame.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        numbers = materialise(
            batch.groupBy("stream_id", "frame_id", "seq").agg(F.count(F.lit(1)).alias("n")).drop("n"), "numbers")
        bags = materialise(
            lookup_join(to_bags(batch), numbers, ["frame_id"]).withColumn("time_us", F.lit(None).cast("long")),
            "batch-bags")
        index = postings.open_index(batch.sparkSession, index_path)
        index.append(batch_id, postings.to_blocks(bags))
        queries = bags.select(
            "stream_id", F.col("frame_id").alias("query_id"), (F.col("seq") - exclude_recent).alias("until"),
            "word_index", "weight")
        best = postings.best_past(index.read(), queries).withColumnRenamed("query_id", "frame_id")
        _store(
            shuffled(numbers).join(best, ["stream_id", "frame_id"], "left").select(
                "stream_id", "frame_id", "seq", "best_seq", F.coalesce("score", F.lit(0.0)).alias("score")),
            found_path, batch_id)
        for table in (numbers, bags):
            release(table)

    return features.writeStream.foreachBatch(handle)
