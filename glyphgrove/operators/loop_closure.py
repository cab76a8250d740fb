"""Loop closure of key frames: expected score, scored islands, best frame, containment test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrove.operators.frames import POOL_MICROS, islands
from glyphgrove.operators.matching import uncovered_words
from glyphgrove.operators.similarity import score_pairs, similar_frames
from glyphgrove.runtime import lookup_join, materialise

#: Below this similarity to the previous frame a query is skipped: the camera moved too much.
MIN_EXPECTED = 0.1

#: Share of the expected score that a key frame must exceed.
MIN_NORMALISED = 0.3


def expected_scores(bow: DataFrame, frame_pairs: DataFrame) -> DataFrame:
    """``(frame_id, expected)``: similarity to the previous frame."""
    pairs = frame_pairs.select(
        F.col("frame_id").alias("query_id"), F.col("prev_frame_id").alias("frame_id")
    )
    return score_pairs(pairs, bow, bow).select(
        F.col("query_id").alias("frame_id"), F.col("score").alias("expected")
    )


def scored_key_frames(
    bow: DataFrame,
    keyframes: DataFrame,
    frame_pairs: DataFrame,
    min_expected: float = MIN_EXPECTED,
    min_normalised: float = MIN_NORMALISED,
) -> DataFrame:
    """``(query_id, frame_id, time_us, score)``: earlier key frames scoring well against each key frame.

    ``keyframes`` are ``(frame_id, time_us)`` with ``time_us`` in microseconds. Scores are divided by the
    expected score, so the bar for the raw score is known per query before any search. If ``keyframes`` carry a
    ``stream_id`` too, a frame is only compared with frames of its own stream.
    """
    streams = ("stream_id",) if "stream_id" in keyframes.columns else ()
    # each of these feeds several branches below; written once, they are not computed again per branch
    keyframes = materialise(keyframes, "keyframes")
    queries = lookup_join(frame_pairs, keyframes, ["frame_id"])
    expected = materialise(
        expected_scores(bow, queries).filter(F.col("expected") >= min_expected), "expected"
    )
    bags = materialise(lookup_join(bow, keyframes, ["frame_id"]), "keyframe_bags")
    bars = expected.select("frame_id", (F.col("expected") * min_normalised).alias("threshold"))
    earlier = F.col("time_us") < F.col("query_time_us")
    for c in streams:
        earlier = earlier & F.col(f"query_{c}").eqNullSafe(F.col(c))
    hits = similar_frames(bags, bags, bars, carry=("time_us", *streams), admissible=earlier)
    normal = lookup_join(hits, expected.withColumnRenamed("frame_id", "query_id"), ["query_id"])
    return lookup_join(normal, keyframes, ["frame_id"]).select(
        "query_id", "frame_id", "time_us", (F.col("score") / F.col("expected")).alias("score")
    )


def best_islands(
    scored: DataFrame, pool: int = POOL_MICROS, keys: list[str] | None = None, **options
) -> DataFrame:
    """Scored key frames of each query with ``island_id``, ``island_score`` and ranks.

    ``keys`` name the query, ``query_id`` unless given.

    ``island_rank`` orders the islands of a query by score, then by start.
    """
    keys = keys or ["query_id"]
    grouped = materialise(islands(scored, keys, "time_us", pool, **options), "islands")
    totals = grouped.groupBy(*keys, "island_id").agg(
        # rounded, so that equal totals summed in another order stay equal
        F.round(F.sum("score"), 12).alias("island_score"),
        F.count(F.lit(1)).alias("island_frames"),
    )
    best = totals.groupBy(*keys).agg(
        F.max(F.struct("island_score", (-F.col("island_id")).alias("neg"))).alias("_b")
    )
    rows = lookup_join(grouped, totals, [*keys, "island_id"])
    return lookup_join(rows, best, keys).select(
        *rows.columns, (F.col("island_id") == -F.col("_b.neg")).alias("is_best")
    )


def best_frames(island_rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Best frame of the best island of each query, the earliest on ties."""
    keys = keys or ["query_id"]
    return (
        island_rows.filter("is_best")
        .groupBy(*keys, "island_id", "island_score", "island_frames")
        .agg(
            F.max(
                F.struct(
                    F.round("score", 12).alias("score"), (-F.col("time_us")).alias("neg"), "frame_id"
                )
            ).alias("_f")
        )
        .select(
            *keys, F.col("_f.frame_id").alias("frame_id"), "island_id", "island_score",
            "island_frames", F.col("_f.score").alias("score"),
        )
    )


def loop_closures(
    bow: DataFrame,
    quantised: DataFrame,
    keyframes: DataFrame,
    frame_pairs: DataFrame,
    pool: int = POOL_MICROS,
    min_expected: float = MIN_EXPECTED,
    min_normalised: float = MIN_NORMALISED,
) -> DataFrame:
    """Best match of every key frame that has one, and whether it closes a loop.

    A loop is closed when every word of the query lies in the word neighbourhood of the match.
    """
    scored = scored_key_frames(bow, keyframes, frame_pairs, min_expected, min_normalised)
    chosen = materialise(best_frames(best_islands(materialise(scored, "scored"), pool)), "chosen")
    checked = uncovered_words(chosen, quantised)
    return lookup_join(chosen, checked, ["query_id", "frame_id"]).select(
        *chosen.columns, "total", "uncovered", (F.col("uncovered") == 0).alias("closed")
    )
