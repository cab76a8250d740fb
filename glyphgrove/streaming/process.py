"""The frame process as one stream: key-frame rule, matching, insertion, loop search.

Words of features go to keyed state, which numbers the frames of a stream, decides on key frames, compares each
frame with the one before and matches those that are no key frames. What a micro-batch yields goes to a
writer that inserts key frames into the incremental index and searches the earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glyphgrove.operators import loop_closure, postings
from glyphgrove.operators.frames import KEYFRAME_GAP, KEYFRAME_POINTS, POOL_MICROS
from glyphgrove.runtime import materialise, release, shuffled
from glyphgrove.sources.segments import SegmentLog
from glyphgrove.streaming.frames import _store, pick_key_frames

#: One row per frame, per word of a key frame, and per match of another frame, told apart by ``kind``.
EVENTS = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("stream_id", T.LongType()),
    T.StructField("frame_id", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("time_us", T.LongType()), T.StructField("n_points", T.LongType()),
    T.StructField("is_key", T.BooleanType()), T.StructField("prev_frame_id", T.LongType()),
    T.StructField("expected", T.DoubleType()), T.StructField("pos", T.LongType()),
    T.StructField("prev_pos", T.LongType()), T.StructField("word_index", T.LongType()),
    T.StructField("weight", T.DoubleType()), T.StructField("low", T.LongType()),
    T.StructField("high", T.LongType()),
])

KEYFRAMES = T.StructType([
    T.StructField("stream_id", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("frame_id", T.LongType()), T.StructField("time_us", T.LongType()),
    T.StructField("words", T.ArrayType(T.LongType())),
    T.StructField("near", T.ArrayType(T.StructType([
        T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))),
])

#: Key frames that are named to the scan of the key-frame table.
NAMED_FRAMES = 1000


class FrameProcessor(StatefulProcessor):
    """State of a stream: frames seen, number of the last key frame, and the bag of the last frame.

    Rows are ``(stream_id, time_us, frame_id, pos, word_index, low, high, weight)``, one per feature: the range of words
    below the feature's ancestor, and the weight of its word. Frames without rows do not exist here. A
    micro-batch holds whole frames, and no frame older than those before; inside it rows come in any order.
    """

    def __init__(self, gap: int, min_points: int):
        self.gap, self.min_points = gap, min_points

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "count bigint, inserted bigint, frame_id bigint")
        self.last = handle.getListState("last", "word bigint, pos bigint, weight double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, inserted, before = self.progress.get() if self.progress.exists() else (0, 0, None)
        last = list(self.last.get()) if before is not None else []
        batch = pd.concat(list(rows), ignore_index=True).sort_values(
            ["time_us", "frame_id", "pos"], ignore_index=True)
        frame = batch["frame_id"].to_numpy()
        head = np.flatnonzero(np.diff(frame, prepend=frame[0] - 1) != 0)
        number = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(frame))))
        points = np.bincount(number)
        is_key = pick_key_frames(points, count, inserted, self.gap, self.min_points)
        seq = count + 1 + np.arange(len(head))
        ids, times = frame[head], batch["time_us"].to_numpy()[head]
        previous = np.append([-1 if before is None else before], ids[:-1])
        known = np.ones(len(head), bool)
        known[0] = before is not None

        # bags of all frames of the batch behind the last one of the batch before, which is number 0
        word = batch["word_index"].to_numpy()
        span = int(max(batch["high"].max(), word.max() + 1, max((r[0] for r in last), default=0) + 1))
        keys, first, times_met = np.unique((number + 1) * span + word, return_index=True, return_counts=True)
        raw = batch["weight"].to_numpy()[first] * times_met
        owner = keys // span
        weight = raw / np.bincount(owner, raw)[owner]
        pos = batch["pos"].to_numpy()[first]
        old = np.array([r[0] for r in last], np.int64)
        order = np.argsort(old)
        all_keys = np.concatenate([old[order], keys])
        all_pos = np.concatenate([np.array([r[1] for r in last], np.int64)[order], pos])
        all_weight = np.concatenate([np.array([r[2] for r in last], float)[order], weight])

        # similarity to the frame before: the lesser weights of shared words
        met = np.searchsorted(all_keys, keys - span)
        met[met == len(all_keys)] = 0
        shared = all_keys[met] == keys - span
        expected = np.bincount(owner[shared] - 1, np.minimum(weight, all_weight[met])[shared], len(head))

        # matches of the other frames: words of the frame before in the range below the own ancestor
        asks = np.flatnonzero(~is_key[number] & known[number])
        base = number[asks] * span
        a = np.searchsorted(all_keys, base + batch["low"].to_numpy()[asks], "left")
        b = np.searchsorted(all_keys, base + batch["high"].to_numpy()[asks], "left")
        n = b - a
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        partner = np.repeat(a, n) + inside
        asking = np.repeat(asks, n)

        frames = pd.DataFrame({
            "kind": "frame", "frame_id": ids, "seq": seq, "time_us": times, "n_points": points, "is_key": is_key,
            "prev_frame_id": pd.array(np.where(known, previous, 0), "Int64").copy(),
            "expected": np.where(known, expected, np.nan),
        })
        frames.loc[~known, "prev_frame_id"] = pd.NA
        matches = pd.DataFrame({
            "kind": "match", "frame_id": frame[asking], "seq": seq[number[asking]],
            "prev_frame_id": previous[number[asking]], "pos": batch["pos"].to_numpy()[asking],
            "prev_pos": all_pos[partner],
        })
        mine = is_key[owner - 1]
        words = pd.DataFrame({
            "kind": "word", "frame_id": ids[owner - 1][mine], "seq": seq[owner - 1][mine],
            "time_us": times[owner - 1][mine], "expected": np.where(known, expected, np.nan)[owner - 1][mine],
            "word_index": (keys % span)[mine], "weight": weight[mine],
            "low": batch["low"].to_numpy()[first][mine], "high": batch["high"].to_numpy()[first][mine],
        })
        newest = owner == len(head)
        if is_key.any():
            inserted = int(seq[np.flatnonzero(is_key)[-1]])
        self.progress.update((int(seq[-1]), inserted, int(ids[-1])))
        self.last.put([
            (int(w), int(p), float(v)) for w, p, v in zip((keys % span)[newest], pos[newest], weight[newest], strict=True)
        ])
        for part in (frames, matches, words):
            if len(part):
                yield _shaped(part, int(key[0]))


def _shaped(part: pd.DataFrame, stream: int) -> pd.DataFrame:
    """``part`` with all columns of EVENTS, those it lacks null."""
    kinds = {T.StringType: "object", T.LongType: "Int64", T.BooleanType: "boolean", T.DoubleType: "Float64"}
    part = part.assign(stream_id=stream)
    return pd.DataFrame({
        f.name: pd.array(part[f.name], kinds[type(f.dataType)]) if f.name in part
        else pd.array([None] * len(part), kinds[type(f.dataType)]) for f in EVENTS.fields
    })


def open_key_frames(spark: SparkSession, folder: str) -> SegmentLog:
    """Key frames with their words and the word ranges near them, one row each."""
    return SegmentLog(spark, folder, KEYFRAMES, ["stream_id", "seq"])


def closures(
    index: DataFrame, key_frames: DataFrame, fresh: DataFrame, pool: int = POOL_MICROS,
    min_expected: float = loop_closure.MIN_EXPECTED, min_normalised: float = loop_closure.MIN_NORMALISED,
) -> DataFrame:
    """Best earlier match of each key frame in ``fresh`` that has one, and whether it closes a loop.

    ``fresh`` are the ``word`` rows of new key frames, which ``index`` and ``key_frames`` hold as well.
    """
    keys = ["stream_id", "query_id"]
    asked = fresh.filter(F.col("expected") >= min_expected).withColumn("query_id", F.col("frame_id"))
    queries = asked.select(*keys, (F.col("seq") - 1).alias("until"), "word_index", "weight")
    expected = asked.groupBy(*keys).agg(F.first("expected").alias("expected"))
    bars = expected.select(*keys, (F.col("expected") * min_normalised).alias("threshold"))
    hits = shuffled(postings.frames_above(index, queries, bars)).join(expected, keys)
    scored = hits.select(*keys, "frame_id", "time_us", (F.col("score") / F.col("expected")).alias("score"))
    rows = loop_closure.best_islands(materialise(scored, "scored"), pool, keys=keys)
    chosen = materialise(loop_closure.best_frames(rows, keys=keys), "chosen")
    named = chosen.select("frame_id").distinct().limit(NAMED_FRAMES + 1).collect()
    found = key_frames.select("stream_id", "frame_id", "near")
    if len(named) <= NAMED_FRAMES:
        found = found.filter(F.col("frame_id").isin([r["frame_id"] for r in named]))
    words = asked.groupBy(*keys).agg(F.collect_list("word_index").alias("words"))
    both = shuffled(shuffled(chosen).join(words, keys)).join(found, ["stream_id", "frame_id"])
    lost = F.filter("words", lambda w: ~F.exists("near", lambda r: (r["low"] <= w) & (w < r["high"])))
    return both.select(
        *chosen.columns, F.size("words").alias("total"), F.size(lost).alias("uncovered"),
        (F.size(lost) == 0).alias("closed"),
    )


def process_stream(
    words: DataFrame, folder: str, gap: int = KEYFRAME_GAP, min_points: int = KEYFRAME_POINTS,
    pool: int = POOL_MICROS,
):
    """Writer that runs the frame process over a stream of words (rows as ``FrameProcessor`` takes them).

    Under ``folder``: ``frames``, ``matches`` and ``closures`` by batch, the index (``postings``) and the table of
    key frames (``key_frames``). A batch that is replayed overwrites its own results and counts once.
    """
    events = words.groupBy("stream_id").transformWithStateInPandas(
        FrameProcessor(gap, min_points), EVENTS, "append", "none")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = materialise(batch, "events")
        _store(rows.filter("kind = 'frame'").select(
            "stream_id", "frame_id", "seq", "time_us", "n_points", "is_key", "prev_frame_id", "expected"),
            f"{folder}/frames", batch_id)
        _store(rows.filter("kind = 'match'").select(
            "stream_id", "frame_id", "pos", "prev_frame_id", "prev_pos"), f"{folder}/matches", batch_id)
        fresh = rows.filter("kind = 'word'")
        index = postings.open_index(spark, f"{folder}/postings")
        index.append(batch_id, postings.to_blocks(fresh))
        table = open_key_frames(spark, f"{folder}/key_frames")
        table.append(batch_id, fresh.groupBy("stream_id", "seq", "frame_id", "time_us").agg(
            F.sort_array(F.collect_list("word_index")).alias("words"),
            F.sort_array(F.collect_set(F.struct("low", "high"))).alias("near")))
        _store(closures(index.read(), table.read(), fresh, pool), f"{folder}/closures", batch_id)
        release(rows)

    return events.writeStream.foreachBatch(handle)
