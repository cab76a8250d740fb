import pytest
from pyspark.sql import functions as F

from glyphgrove.operators import frames, kalman
from glyphgrove.streaming import frames as streams


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(240).selectExpr(
        "id % 3 as k", "id as t", "cast((id * 37) % 101 as double) as v"
    ).persist()


def feed(spark, rows, folder, cuts, build):
    """Let rows arrive in steps and run the stream after each, from one checkpoint."""
    source, out, checkpoint = (str(folder / n) for n in ("in", "out", "state"))
    last = -1
    for cut in cuts:
        rows.filter((F.col("t") > last) & (F.col("t") <= cut)).write.mode("append").parquet(source)
        last = cut
        stream = streams.read_frames(spark, source, rows.schema)
        streams.sink_parquet(build(stream), out, checkpoint)
    return spark.read.parquet(out)


def test_key_frames_equal_the_batch(spark, rows, tmp_path):
    got = feed(
        spark, rows, tmp_path, [50, 51, 239],
        lambda s: streams.keyframe_stream(s, "k", ["t"], "v", gap=3, min_points=40),
    )
    batch = frames.key_frames(
        frames.with_counter(rows, ["k"], ["t"]), ["k"], points="v", gap=3, min_points=40
    )
    columns = ["k", "t", "seq"]
    assert sorted(got.select(columns).collect()) == sorted(batch.select(columns).collect())


def test_kalman_equals_the_batch(spark, rows, tmp_path):
    got = feed(
        spark, rows, tmp_path, [100, 239], lambda s: streams.kalman_stream(s, "k", ["t"], "v")
    )
    batch = {(r.k, r.step): r for r in kalman.kalman_track(rows, ["k"], ["t"], "v").collect()}
    seen = got.collect()
    assert len(seen) == 240
    for r in seen:
        assert [r[c] for c in kalman.OUTPUTS] == pytest.approx(
            [batch[r.k, r.step][c] for c in kalman.OUTPUTS]
        )


def test_session_islands_run_on_streams(spark, tmp_path):
    times = [0, 3, 8, 30, 31, 60]
    rows = spark.createDataFrame([(1, t, 0.5) for t in times], "query_id int, t int, score double")
    rows = rows.withColumn("ts", F.timestamp_seconds("t"))
    batch = frames.session_islands(rows, ["query_id"], "ts").orderBy("island_start").collect()
    assert [(r.frames, r.score) for r in batch] == [(3, 1.5), (2, 1.0), (1, 0.5)]
    got = feed(
        spark, rows, tmp_path, [10, 60],
        lambda s: frames.session_islands(s.withWatermark("ts", "1 second"), ["query_id"], "ts"),
    )
    # the last session stays open until the watermark passes it
    assert sorted((r.frames, r.score) for r in got.collect()) == [(2, 1.0), (3, 1.5)]
