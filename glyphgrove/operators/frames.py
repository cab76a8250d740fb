"""Frame streams in batch: counters, previous frames, key frames, motion, islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrove.operators.ordered import finish, number, order_rows, previous, running
from glyphgrove.operators.spacing import spaced_picks

#: A key frame needs more frames than this since the last one, and more key points than the other.
KEYFRAME_GAP = 20
KEYFRAME_POINTS = 50

#: Islands group the scored key frames within this time of the first of them.
POOL_MICROS = 5_000_000


def with_counter(frames: DataFrame, keys: list[str], order: list[str], **options) -> DataFrame:
    """Add ``seq``, the frame counter of each stream, from 1."""
    return finish(number(order_rows(frames, keys, order, **options), "seq"))


def with_previous(
    frames: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], **options
) -> DataFrame:
    """Add the counter and the previous frame's values, null on the first frame."""
    ordered = order_rows(frames, keys, order, **options)
    return finish(previous(number(ordered, "seq"), columns))


def cumulative_motion(
    frames: DataFrame, keys: list[str], order: list[str], moves: dict[str, str], **options
) -> DataFrame:
    """Running sums of per-frame translations: ``{move column: total column}``."""
    ordered = order_rows(frames, keys, order, **options)
    return finish(running(ordered, {total: F.col(c) for c, total in moves.items()}))


def key_frames(
    frames: DataFrame,
    keys: list[str],
    points: str = "n_points",
    seq: str = "seq",
    gap: int = KEYFRAME_GAP,
    min_points: int = KEYFRAME_POINTS,
    **options,
) -> DataFrame:
    """Frames the insertion rule selects, from frames numbered by ``with_counter``.

    The rule compares the number of frames seen before this one with the counter at the last
    insertion, which was taken after counting; so the next insertion is more than ``gap`` + 1
    numbers on, and the first one is after frame ``gap`` + 1.
    """
    eligible = frames.filter(F.col(points) > min_points)
    marked = spaced_picks(eligible, keys, seq, gap + 1, start=0, **options)
    return marked.filter(F.col("anchor") == F.col(seq)).drop("anchor")


def islands(
    scored: DataFrame, keys: list[str], at: str, pool: int = POOL_MICROS, **options
) -> DataFrame:
    """Add ``island_id``: the time of the first row of the island, islands lasting ``pool``."""
    marked = spaced_picks(scored, keys, at, pool, **options)
    return marked.withColumnRenamed("anchor", "island_id")


def session_islands(
    scored: DataFrame, keys: list[str], ts: str, pool: str = "5 seconds"
) -> DataFrame:
    """Gap-based variant: an island ends when nothing follows within ``pool``.

    A built-in session window, so it also runs on streams (with a watermark).
    """
    return (
        scored.groupBy(*keys, F.session_window(ts, pool).alias("island"))
        .agg(F.count(F.lit(1)).alias("frames"), F.sum("score").alias("score"))
        .select(
            *keys,
            F.col("island.start").alias("island_start"),
            F.col("island.end").alias("island_end"),
            "frames",
            "score",
        )
    )
