import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrove.operators import frames, kalman
from glyphgrove.operators.ordered import dense_ids, finish, number, order_rows, previous, running
from glyphgrove.operators.spacing import spaced_picks


@pytest.fixture(scope="module")
def stream(spark):
    """One key holds a third of all rows."""
    rng = np.random.default_rng(11)
    keys = np.where(rng.random(900) < 0.35, 0, rng.integers(1, 9, 900))
    rows = [(int(k), int(t), float(v)) for t, (k, v) in enumerate(zip(keys, rng.normal(60, 30, 900)))]
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "k bigint, t bigint, v double")
    return df.repartition(5).persist(), rows


def by_key(rows):
    out = {}
    for k, t, v in sorted(rows):
        out.setdefault(k, []).append((t, v))
    return out


@pytest.mark.parametrize("limit", [40, 10_000])
def test_chunked_order_equals_plain_order(spark, stream, limit):
    df, rows = stream
    ordered = order_rows(df, ["k"], ["t"], limit)
    assert ordered.chunked == (limit == 40)
    done = previous(number(running(ordered, {"total": F.col("v")}), "n"), {"v": "before", "t": "then"})
    got = {r.t: r for r in finish(done).collect()}
    assert len(got) == 900
    for items in by_key(rows).values():
        total, last = 0.0, (None, None)
        for n, (t, v) in enumerate(items, 1):
            total += v
            r = got[t]
            assert (r.n, r.then, r.before) == (n, *last)
            assert r.total == pytest.approx(total)
            last = (t, v)


def test_chunks_stay_small(spark, stream):
    df, _ = stream
    ordered = order_rows(df, ["k"], ["t"], 40)
    assert ordered.rows.groupBy(*ordered.scope).count().agg(F.max("count")).first()[0] <= 80


@pytest.mark.parametrize("limit", [40, 10_000])
def test_dense_ids(spark, stream, limit):
    df, rows = stream
    got = {r.t: r.id for r in dense_ids(df, ["k", "t"], max_group_rows=limit).collect()}
    want = {t: i for i, (_, t, _) in enumerate(sorted(rows))}
    assert got == want


def walk(positions, gap, last):
    picks = []
    for p in positions:
        if last is None or p > last + gap:
            picks.append(p)
            last = p
    return picks


@pytest.mark.parametrize("limit", [25, 10_000])
@pytest.mark.parametrize("gap", [0, 3, 50, 5000])
@pytest.mark.parametrize("start", [None, 0, 100])
def test_spaced_picks(spark, stream, limit, gap, start):
    df, rows = stream
    marked = spaced_picks(df.select("k", "t"), ["k"], "t", gap, start, limit).collect()
    got = {}
    for r in marked:
        got.setdefault(r.k, {})[r.t] = r.anchor
    for k, items in by_key(rows).items():
        positions = [t for t, _ in items]
        picks = walk(positions, gap, start)
        for t in positions:
            before = [p for p in picks if p <= t]
            assert got[k][t] == (before[-1] if before else None)


@pytest.mark.parametrize("limit", [40, 10_000])
def test_key_frames_follow_the_counter_rule(spark, stream, limit):
    df, rows = stream
    numbered = frames.with_counter(df, ["k"], ["t"])
    got = {
        (r.k, r.seq)
        for r in frames.key_frames(
            numbered, ["k"], points="v", gap=4, min_points=50, max_group_rows=limit
        ).collect()
    }
    want = set()
    for k, items in by_key(rows).items():
        count = last = 0
        for _, v in items:
            triggers = count - last > 4
            count += 1
            if triggers and v > 50:
                last = count
                want.add((k, count))
    assert got == want


@pytest.mark.parametrize("limit", [40, 10_000])
def test_kalman_equals_the_matrix_form(spark, stream, limit):
    df, rows = stream
    got = {
        r.t: r for r in kalman.kalman_track(df, ["k"], ["t"], "v", max_group_rows=limit).collect()
    }
    f, h = np.array([[1.0, 1.0], [0.0, 1.0]]), np.ones((1, 2))
    for items in by_key(rows).values():
        x, p = np.zeros((2, 1)), np.ones((2, 2))
        for t, z in items:
            x, p = f @ x, f @ p @ f.T + 1e-5 * np.eye(2)
            predicted = x[0, 0]
            gain = p @ h.T / (h @ p @ h.T + 0.1)
            x, p = x + gain * (z - h @ x), (np.eye(2) - gain @ h) @ p
            r = got[t]
            assert (r.predicted, r.angle, r.rate) == pytest.approx(
                (predicted, x[0, 0], x[1, 0]), rel=1e-9, abs=1e-9
            )
            assert (r.p00, r.p01, r.p11) == pytest.approx((p[0, 0], p[0, 1], p[1, 1]), rel=1e-6)


def test_gain_table_settles():
    table = kalman.gain_table(kalman.Model())
    assert len(table) < 10_000 and np.isfinite(table).all()


@pytest.mark.parametrize("limit", [40, 10_000])
def test_rules_carry_their_state_over_batches(spark, stream, limit):
    df, rows = stream
    wide = kalman.kalman_track(df, ["k"], ["t"], "v", max_group_rows=limit)
    want = sorted(map(tuple, wide.select("t", *kalman.OUTPUTS).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        narrow = kalman.kalman_track(df, ["k"], ["t"], "v", max_group_rows=limit)
        got = sorted(map(tuple, narrow.select("t", *kalman.OUTPUTS).collect()))
        marked = spaced_picks(df.select("k", "t"), ["k"], "t", 12, None, limit).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [pytest.approx(w) for w in want]
    picked = {}
    for r in marked:
        if r.anchor == r.t:
            picked.setdefault(r.k, set()).add(r.t)
    for k, items in by_key(rows).items():
        assert picked[k] == set(walk([t for t, _ in items], 12, None))
