import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrove.operators import frames, loop_closure, matching, postings
from glyphgrove.operators.tree import neighbourhood, word_ranges
from glyphgrove.streaming import frames as streams
from glyphgrove.streaming import process

GAP, POINTS, POOL = 2, 4, 40


def test_key_frames_of_a_batch_follow_the_rule():
    rng = random.Random(3)
    for _ in range(200):
        points = np.array([rng.randrange(10) for _ in range(rng.randrange(1, 60))])
        count, inserted = rng.randrange(5), 0
        want, c, last = [], count, inserted
        for p in points.tolist():
            pick = c - last > GAP and p > POINTS
            c += 1
            if pick:
                last = c
            want.append(pick)
        assert process.pick_key_frames(points, count, inserted, GAP, POINTS).tolist() == want


@pytest.fixture(scope="module")
def vocabulary(spark):
    names = [f"{a}-{b}" for a in range(4) for b in range(3)] + ["4"]
    return spark.createDataFrame([(w, i) for i, w in enumerate(names)], "word_id string, word_index long")


def test_word_ranges_are_the_neighbourhood(spark, vocabulary):
    for distance in (1, 2):
        ranges = word_ranges(vocabulary, distance)
        other = vocabulary.withColumnsRenamed({"word_id": "neighbour_id", "word_index": "n"})
        near = ranges.join(other, (F.col("low") <= F.col("n")) & (F.col("n") < F.col("high")))
        got = {(r["word_id"], r["neighbour_id"]) for r in near.collect()}
        assert got == {tuple(r) for r in neighbourhood(vocabulary, distance).collect()}


def feature_rows(seed):
    """Two streams whose frames wander through the words and come back."""
    rng = random.Random(seed)
    names = [f"{a}-{b}" for a in range(4) for b in range(3)] + ["4"]
    rows = []
    for s in (5, 6):
        for n in range(60):
            centre = abs(n % 30 - 15) // 2
            k = rng.choice([0, 3, 6, 9])
            rows += [(s, n * 7 + s, 1000 * s + n, p, names[min(12, max(0, centre + rng.randrange(-1, 3)))]) for p in range(k)]
    return rows


def test_stream_equals_the_batch_operators(spark, vocabulary, tmp_path):
    rows = spark.createDataFrame(feature_rows(1), "stream_id long, time_us long, frame_id long, pos long, word_id string")
    weights = vocabulary.select("word_id", (1.0 + F.col("word_index") % 3).alias("weight"))
    words = rows.join(word_ranges(vocabulary).join(weights, "word_id"), "word_id").drop("word_id")
    source, folder, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    last = -1
    with streams.state_provider(spark):
        for cut in (100, 101, 230, 1000):
            words.filter((F.col("time_us") > last) & (F.col("time_us") <= cut)).write.mode("append").parquet(source)
            last = cut
            stream = streams.read_frames(spark, source, words.schema)
            streams.run_available(process.process_stream(stream, folder, GAP, POINTS, POOL), checkpoint)

    counted = rows.groupBy("stream_id", "frame_id", "time_us").agg(F.count(F.lit(1)).alias("n_points"))
    numbered = frames.with_previous(counted, ["stream_id"], ["time_us"], {"frame_id": "prev_frame_id"}).persist()
    picked = frames.key_frames(numbered, ["stream_id"], gap=GAP, min_points=POINTS).persist()
    got = spark.read.parquet(f"{folder}/frames")
    assert {(r["stream_id"], r["frame_id"], r["seq"]) for r in got.collect()} == {
        (r["stream_id"], r["frame_id"], r["seq"]) for r in numbered.collect()}
    assert {r["frame_id"] for r in got.filter("is_key").collect()} == {r["frame_id"] for r in picked.collect()}

    pairs = numbered.filter("prev_frame_id is not null").select("frame_id", "prev_frame_id")
    plain = pairs.join(picked, "frame_id", "left_anti")
    columns = ["frame_id", "pos", "prev_frame_id", "prev_pos"]
    want = matching.candidate_matches(rows, plain).select(*columns)
    found = spark.read.parquet(f"{folder}/matches").select(*columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and not found.isEmpty()

    raw = words.groupBy("frame_id", "word_index").agg(F.sum("weight").alias("raw"))
    total = raw.groupBy("frame_id").agg(F.sum("raw").alias("total"))
    bow = raw.join(total, "frame_id").select("frame_id", "word_index", (F.col("raw") / F.col("total")).alias("weight"))
    keyframes = picked.select("stream_id", "frame_id", "time_us")
    batch = loop_closure.loop_closures(bow, rows, keyframes, pairs, POOL)
    facts = ["query_id", "frame_id", "island_id", "island_frames", "total", "uncovered", "closed"]
    closed = spark.read.parquet(f"{folder}/closures")
    assert sorted(map(tuple, closed.select(*facts).collect())) == sorted(map(tuple, batch.select(*facts).collect()))
    assert not closed.isEmpty() and closed.filter("query_id div 1000 <> frame_id div 1000").isEmpty()


def test_closures_send_no_table_to_all(spark):
    fresh = spark.createDataFrame(
        [(5, 100 + n, n, 10 * n, 0.9, w, 0.5, w, w + 1) for n in range(1, 9) for w in (n % 3, 7)],
        "stream_id long, frame_id long, seq long, time_us long, expected double, word_index long, weight double, low long, high long")
    near = F.sort_array(F.collect_set(F.struct("low", "high"))).alias("near")
    table = fresh.groupBy("stream_id", "seq", "frame_id", "time_us").agg(
        F.sort_array(F.collect_list("word_index")).alias("words"), near)
    found = process.closures(postings.to_blocks(fresh), table, fresh, POOL)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["query_id"], r["frame_id"]) for r in found.filter("closed").collect()} >= {(104, 101), (105, 102)}
