"""Similarity of bags of words without comparing all pairs of frames.

For two bags that each add up to 1, ``1 - 0.5 * sum |a - b|`` equals ``sum min(a, b)`` over their
shared words. Walk the words of a frame from the rarest to the most frequent: if w is the first
word it shares with another frame, the score is at most the weight from w on. So only words whose
remaining weight exceeds the wanted score can start a match, and the heavy tail of frequent words
is joined only where a score above the threshold is still possible. Nothing is cut off: candidates
are then scored on all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphgrove.runtime import lookup_join, materialise, shuffled

#: Slack for sums of weights in floating point; candidates are scored exactly afterwards.
SLACK = 1e-9

#: Rows of one word on either side of a cell of the candidate join: a word found in many frames is
#: cut into a grid of cells, so that no task meets all of its pairs.
WORD_ROWS = 20_000


def score_pairs(pairs: DataFrame, queries: DataFrame, database: DataFrame) -> DataFrame:
    """Exact score of given ``(query_id, frame_id)`` pairs, 0 when no word is shared."""
    # a packed frame has one entry per distinct word, so at most the vocabulary
    packed = queries.groupBy(F.col("frame_id").alias("query_id")).agg(
        F.collect_list(F.struct("word_index", "weight")).alias("_words")
    )
    spread = lookup_join(pairs, packed, ["query_id"], "left").select(
        "query_id", "frame_id", F.inline_outer("_words")
    )
    other = database.select("frame_id", "word_index", F.col("weight").alias("other"))
    met = lookup_join(spread, other, ["frame_id", "word_index"], "left")
    shared = F.coalesce(F.least("weight", "other"), F.lit(0.0))
    # least() skips nulls, hence the test for a missing partner
    shared = F.when(F.col("other").isNull(), 0.0).otherwise(shared)
    return met.groupBy("query_id", "frame_id").agg(F.sum(shared).alias("score"))


#: Thresholds are grouped into powers of two, down to this one; smaller ones share the last band.
BANDS = 30


def _band(threshold: Column) -> Column:
    """Band b holds the thresholds above 2^-(b + 1), the last band also all smaller ones."""
    return F.when(threshold <= 2.0 ** -BANDS, BANDS).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(BANDS), F.floor(-F.log2(threshold))))).cast("int")


def _floor(band: int) -> float:
    return 0.0 if band >= BANDS else 2.0 ** -(band + 1)


def _openers(bags: DataFrame, frequency: DataFrame, bar: Column) -> DataFrame:
    """Words of each frame that can be the rarest shared word of a match above ``bar``."""
    known = lookup_join(bags, frequency, ["word_index"], hot=True)
    # at most one row per distinct word in a window
    rest = W.partitionBy("frame_id").orderBy(F.desc("frames"), F.desc("word_index")).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    return known.withColumn("_rest", F.sum("weight").over(rest)).filter(
        F.col("_rest") > bar - SLACK
    )


def candidates(
    queries: DataFrame,
    database: DataFrame,
    thresholds: DataFrame | float,
    carry: tuple[str, ...] = (),
    admissible: Column | None = None,
) -> DataFrame:
    """Distinct ``(query_id, frame_id)`` that may score above the query's threshold.

    ``carry`` names frame-level columns kept on both sides as ``query_<c>`` and ``<c>`` for the
    ``admissible`` condition.
    """
    cells = F.ceil(F.count(F.lit(1)) / WORD_ROWS).cast("int")
    asked = queries.groupBy("word_index").agg(cells.alias("query_parts"))
    frequency = database.groupBy("word_index").agg(
        F.count(F.lit(1)).alias("frames"), cells.alias("parts")
    )
    frequency = shuffled(frequency).join(asked, "word_index")
    if isinstance(thresholds, DataFrame):
        queries = lookup_join(queries, thresholds, ["frame_id"])
        query_bar, query_band = F.col("threshold"), _band(F.col("threshold"))
        # at most BANDS + 1 numbers
        bands = sorted(r[0] for r in thresholds.select(_band(F.col("threshold"))).distinct().collect())
        bars = {b: _floor(b) for b in bands}
    else:
        query_bar, query_band, bars = F.lit(float(thresholds)), F.lit(0), {0: float(thresholds)}
    if not bars:
        return queries.select(F.col("frame_id").alias("query_id"), "frame_id").limit(0)
    left = _openers(queries, frequency, query_bar).select(
        F.col("frame_id").alias("query_id"),
        "word_index",
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("frame_id"), F.col("query_parts")).cast("int").alias("query_part"),
        query_band.alias("band"),
        *[F.col(c).alias(f"query_{c}") for c in carry],
    )
    # a word of the database takes part in the bands whose least threshold it can reach, so that a query
    # with a low threshold does not open the frequent words of all frames to every other query
    reached = F.filter(F.array(*[
        F.when(F.col("_rest") > bar - SLACK, F.lit(band)) for band, bar in bars.items()
    ]), lambda b: b.isNotNull())
    right = _openers(database, frequency, F.lit(min(bars.values()))).withColumn(
        "band", F.explode(reached)
    ).select(
        "frame_id",
        "word_index",
        "band",
        F.pmod(F.xxhash64("frame_id"), F.col("parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("query_part"),
        *carry,
    )
    met = shuffled(left).join(right, ["word_index", "band", "part", "query_part"])
    if admissible is not None:
        met = met.filter(admissible)
    return met.select("query_id", "frame_id").distinct()


def similar_frames(
    queries: DataFrame, database: DataFrame, thresholds: DataFrame | float, **options
) -> DataFrame:
    """``(query_id, frame_id, score)`` for all pairs scoring above the threshold.

    ``thresholds`` is one number, or ``(frame_id, threshold)`` with one row per query.
    """
    pairs = candidates(queries, database, thresholds, **options)
    scored = score_pairs(pairs, queries, database)
    if isinstance(thresholds, DataFrame):
        bars = thresholds.withColumnRenamed("frame_id", "query_id")
        scored = lookup_join(scored, bars, ["query_id"])
        return scored.filter(F.col("score") > F.col("threshold")).drop("threshold")
    return scored.filter(F.col("score") > thresholds)


def retrieve_best(
    bow: DataFrame, sequence: DataFrame, exclude_recent: int = 100, asked: DataFrame | None = None
) -> DataFrame:
    """Best earlier frame of every frame: ``(frame_id, seq, best_seq, score)``.

    ``sequence`` is ``(frame_id, seq)``. Candidates are the frames with ``past_seq <= seq -
    exclude_recent``, the lowest one wins ties; without any overlap ``best_seq`` is null and the
    score 0. A first partner is scored per frame, and its score is the threshold for the search.
    ``asked`` limits the queries to its ``frame_id`` rows; the database stays whole.
    """
    bags = materialise(lookup_join(bow, sequence, ["frame_id"]), "bags")
    queries = bags if asked is None else lookup_join(
        bags, asked.select("frame_id").distinct(), ["frame_id"], "left_semi"
    )
    first = F.min(F.struct("seq", "frame_id")).alias("_f")
    champions = bags.groupBy("word_index").agg(first).select(
        "word_index", F.col("_f.seq").alias("first_seq"), F.col("_f.frame_id").alias("first_frame")
    )
    reach = F.col("seq") - exclude_recent
    # the earliest frame with the heaviest word that an admissible frame has at all
    probes = (
        lookup_join(queries, champions, ["word_index"], hot=True)
        .filter(F.col("first_seq") <= reach)
        .groupBy("frame_id")
        .agg(F.max(F.struct("weight", "first_frame")).alias("_p"))
        .select(F.col("frame_id").alias("query_id"), F.col("_p.first_frame").alias("frame_id"))
    )
    # every frame that has an admissible partner at all has a probe, with a score above 0
    floor = materialise(
        score_pairs(probes, bow, bow).select(
            F.col("query_id").alias("frame_id"), (F.col("score") - SLACK).alias("threshold")
        ),
        "floor",
    )
    scored = similar_frames(
        queries, bags, floor, carry=("seq",),
        admissible=F.col("seq") <= F.col("query_seq") - exclude_recent,
    )
    past = sequence.select("frame_id", F.col("seq").alias("past_seq"))
    best = (
        lookup_join(scored, past, ["frame_id"])
        .groupBy(F.col("query_id").alias("frame_id"))
        # rounded, so that equal scores summed in another order stay equal
        .agg(
            F.max(
                F.struct(F.round("score", 12).alias("score"), (-F.col("past_seq")).alias("neg"))
            ).alias("_b")
        )
    )
    listed = sequence if asked is None else lookup_join(
        sequence, asked.select("frame_id").distinct(), ["frame_id"], "left_semi"
    )
    return lookup_join(listed, best, ["frame_id"], "left").select(
        "frame_id",
        "seq",
        (-F.col("_b.neg")).alias("best_seq"),
        F.coalesce("_b.score", F.lit(0.0)).alias("score"),
    )
