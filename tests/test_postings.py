import random

import pytest
from pyspark.sql import functions as F

from glyphgrove.operators import postings
from glyphgrove.runtime import materialise
from glyphgrove.sources.segments import SegmentLog

BAGS = "stream_id long, frame_id long, seq long, time_us long, word_index long, weight double"


def bag_rows(seed, frames=300, vocabulary=40, streams=2):
    """Bags that change slowly along a stream, so that blocks of frames resemble each other."""
    rng = random.Random(seed)
    rows = []
    for s in range(streams):
        held = rng.sample(range(vocabulary), 8)
        for seq in range(1, frames + 1):
            if rng.random() < 0.3:
                held[rng.randrange(8)] = rng.randrange(vocabulary)
            words = sorted(set(held))
            raw = [rng.choice([1, 2, 3]) for _ in words]
            rows += [(s, 10_000 * s + seq, seq, seq * 10, w, r / sum(raw)) for w, r in zip(words, raw, strict=True)]
    return rows


def brute(rows, exclude):
    bags = {}
    for s, f, seq, _, w, v in rows:
        bags.setdefault((s, seq, f), {})[w] = v
    out = {}
    for (s, seq, f), bag in bags.items():
        best = (0.0, 0)
        for (s2, seq2, _), other in bags.items():
            if s2 == s and seq2 <= seq - exclude:
                score = round(sum(min(v, other[w]) for w, v in bag.items() if w in other), 12)
                if score > 0:
                    best = max(best, (score, -seq2))
        out[s, f] = (-best[1] or None, best[0])
    return out


def queries(bags, exclude):
    return bags.select(
        "stream_id", F.col("frame_id").alias("query_id"), (F.col("seq") - exclude).alias("until"), "word_index", "weight")


def filled(spark, folder, rows, batches, fanout):
    index = postings.open_index(spark, folder, fanout)
    for b in range(batches):
        part = [r for r in rows if r[2] * batches // 301 == b]
        index.append(b, postings.to_blocks(spark.createDataFrame(part, BAGS)))
    return index


def test_best_past_equals_brute_force_and_skips_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_FRAMES", 16)
    rows = bag_rows(1)
    bags = spark.createDataFrame(rows, BAGS)
    index = filled(spark, str(tmp_path), rows, 5, 3).read()
    asked = queries(bags, 20)
    found = {(r["stream_id"], r["query_id"]): (r["best_seq"], r["score"]) for r in postings.best_past(index, asked).collect()}
    want = {k: v for k, v in brute(rows, 20).items() if v[0]}
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in want.items()}
    assert all(found[k][1] == pytest.approx(v[1]) for k, v in want.items())
    # how many blocks the search reads, of all that share a word with a query
    bounds = postings.block_bounds(index, asked)
    first = bounds.groupBy("stream_id", "query_id").agg(F.max_by("block", "bound").alias("block"))
    opened = spark.createDataFrame(
        [(*k, {"score": v[1], "neg": -v[0]}) for k, v in found.items()],
        "stream_id long, query_id long, _b struct<score: double, neg: long>")
    left = postings.blocks_left(bounds, first, opened).count()
    assert left < 0.35 * bounds.count()


def test_bounds_hold(spark, tmp_path):
    rows = bag_rows(2, frames=150, streams=1)
    bags = spark.createDataFrame(rows, BAGS)
    index = postings.to_blocks(bags)
    asked = queries(bags, 1)
    bounds = postings.block_bounds(index, asked)
    scores = postings.block_scores(index, asked, bounds).withColumn("block", postings._block(F.col("seq")))
    met = scores.join(bounds, ["stream_id", "query_id", "block"])
    assert met.count() == scores.count() and met.filter("score > bound + 1e-12").isEmpty()


def test_frames_above_equal_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_FRAMES", 16)
    monkeypatch.setattr(postings, "NAMED_BLOCKS", 2)
    rows = bag_rows(3, frames=120)
    bags = spark.createDataFrame(rows, BAGS)
    asked = queries(bags, 1)
    bars = asked.select("stream_id", "query_id").distinct().withColumn("threshold", F.lit(0.61))
    got = {(r["stream_id"], r["query_id"], r["frame_id"]) for r in postings.frames_above(postings.to_blocks(bags), asked, bars).collect()}
    held = {}
    for s, f, seq, _, w, v in rows:
        held.setdefault((s, seq, f), {})[w] = v
    want = {
        (s, f, f2) for (s, seq, f), a in held.items() for (s2, seq2, f2), b in held.items()
        if s == s2 and seq2 < seq and sum(min(v, b.get(w, 0)) for w, v in a.items()) > 0.61
    }
    assert got == want


def test_bars_are_not_sent_to_all(spark):
    bags = spark.createDataFrame(bag_rows(4, frames=60), BAGS)
    asked = queries(bags, 1)
    bars = materialise(asked.select("stream_id", "query_id").distinct().withColumn("threshold", F.lit(0.61)), "bars")
    met = postings.frames_above(postings.to_blocks(bags), asked, bars)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_index_is_the_same_after_any_batches_and_replays(spark, tmp_path):
    rows = bag_rows(4, frames=300)
    whole = {tuple(r) for r in postings.to_blocks(spark.createDataFrame(rows, BAGS)).select("stream_id", "block", "word_index", "frames", "most").collect()}
    index = filled(spark, str(tmp_path / "a"), rows, 4, 2)
    before = index.manifest()
    # a replayed batch, after the manifest was written, changes nothing
    index.append(3, postings.to_blocks(spark.createDataFrame(rows, BAGS)))
    assert index.manifest() == before
    again = postings.merge_blocks(postings.open_index(spark, str(tmp_path / "a"), 2).read())
    assert {tuple(r) for r in again.select("stream_id", "block", "word_index", "frames", "most").collect()} == whole
    counts = {(r["stream_id"], r["word_index"]): r["frames"] for r in postings.word_frequencies(index.read()).collect()}
    want = {}
    for s, _, _, _, w, _ in rows:
        want[s, w] = want.get((s, w), 0) + 1
    assert counts == want


def test_a_batch_that_failed_midway_counts_once(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v long").schema
    log = SegmentLog(spark, str(tmp_path), schema, ["k"])
    log.append(0, spark.createDataFrame([(1, 1)], schema))
    # the segment is there, its manifest is not
    log._write(spark.createDataFrame([(2, 2), (3, 3)], schema), "segment-0-1")
    assert log.read().count() == 1
    log.append(1, spark.createDataFrame([(2, 2)], schema))
    assert sorted(map(tuple, SegmentLog(spark, str(tmp_path), schema, ["k"]).read().collect())) == [(1, 1), (2, 2)]


def test_rows_are_rewritten_once_per_level(spark, tmp_path):
    schema = spark.createDataFrame([], "k long").schema
    written = []

    class Counted(SegmentLog):
        def _write(self, rows, name):
            super()._write(rows, name)
            written.append(self._rows([name]).count())

    log = Counted(spark, str(tmp_path), schema, ["k"], fanout=2)
    for b in range(9):
        log.append(b, spark.range(b * 10, b * 10 + 10).toDF("k"))
        assert len(log.manifest().segments) <= 5
    assert log.read().count() == 90 and log.read().distinct().count() == 90
    # 90 rows through four levels at most
    assert sum(written) <= 4 * 90
    assert len(list(tmp_path.glob("segment-*"))) <= 6
    assert len(list((tmp_path / "manifest").glob("v=*"))) == 2
