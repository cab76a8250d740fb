import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrove.operators import bow, loop_closure, similarity

FRAMES, WORDS = 60, 25


@pytest.fixture(scope="module")
def bags(spark):
    """Word 0 occurs in most frames; some frames are copies, some consist of word 0 only."""
    rng = np.random.default_rng(8)
    dense = np.zeros((FRAMES, WORDS))
    for f in range(FRAMES):
        if f % 11 == 3:
            dense[f, 0] = 1
        elif f % 7 == 5:
            dense[f] = dense[f - 4]
        else:
            picks = rng.choice(np.arange(1, WORDS), rng.integers(1, 6), replace=False)
            dense[f, picks] = rng.random(len(picks))
            dense[f, 0] = rng.random() * (f % 3)
    dense /= dense.sum(1, keepdims=True)
    rows = [(f, w, float(dense[f, w])) for f, w in zip(*np.nonzero(dense))]
    rows = [(int(f), int(w), x) for f, w, x in rows]
    df = spark.createDataFrame(rows, "frame_id bigint, word_index bigint, weight double")
    return df.repartition(4).persist(), dense


def scores(dense):
    return 1 - 0.5 * np.abs(dense[:, None] - dense[None]).sum(2)


@pytest.mark.parametrize("bar", [0.05, 0.3, 0.8])
def test_similar_frames_finds_every_pair(bags, bar, monkeypatch):
    monkeypatch.setattr(similarity, "WORD_ROWS", 7)  # the frequent words are split
    df, dense = bags
    got = {(r.query_id, r.frame_id): r.score for r in similarity.similar_frames(df, df, bar).collect()}
    all_ = scores(dense)
    want = {(a, b) for a in range(FRAMES) for b in range(FRAMES) if all_[a, b] > bar}
    assert got.keys() == want
    assert all(got[p] == pytest.approx(all_[p]) for p in got)
    assert all(got[a, a] == pytest.approx(1) for a in range(FRAMES))
    assert all(got[a, b] == pytest.approx(got[b, a]) for a, b in got)


def test_candidates_are_fewer_than_sharing_pairs(bags):
    df, dense = bags
    sharing = int(((dense > 0).astype(int) @ (dense > 0).T.astype(int) > 0).sum())
    kept = similarity.candidates(df, df, 0.8).count()
    assert int((scores(dense) > 0.8).sum()) <= kept < sharing / 2


def test_own_threshold_per_query(spark, bags):
    df, dense = bags
    bars = np.linspace(0.1, 0.9, FRAMES)
    table = spark.createDataFrame(
        [(f, float(b)) for f, b in enumerate(bars)], "frame_id bigint, threshold double"
    )
    got = {(r.query_id, r.frame_id) for r in similarity.similar_frames(df, df, table).collect()}
    all_ = scores(dense)
    assert got == {(a, b) for a in range(FRAMES) for b in range(FRAMES) if all_[a, b] > bars[a]}


@pytest.mark.parametrize("recent", [1, 5, 40])
def test_retrieve_best(spark, bags, recent):
    df, dense = bags
    sequence = spark.createDataFrame([(f, f + 1) for f in range(FRAMES)], "frame_id bigint, seq bigint")
    got = {r.frame_id: r for r in similarity.retrieve_best(df, sequence, recent).collect()}
    all_ = scores(dense)
    assert len(got) == FRAMES
    for f in range(FRAMES):
        past = [(round(all_[f, p], 12), -(p + 1)) for p in range(f - recent + 1)]
        score, neg = max(past, default=(0, 0))
        if score <= 0:
            assert got[f].best_seq is None and got[f].score == 0
        else:
            assert got[f].best_seq == -neg and got[f].score == pytest.approx(score)
    some = spark.createDataFrame([(7,), (59,)], "frame_id bigint")
    asked = similarity.retrieve_best(df, sequence, recent, asked=some).collect()
    assert {r.frame_id: r.best_seq for r in asked} == {f: got[f].best_seq for f in (7, 59)}


def test_bags_add_up(spark):
    rows = [(0, "a"), (0, "a"), (0, "b"), (1, "c"), (2, "b")]
    quantised = spark.createDataFrame(rows, "frame_id bigint, word_id string")
    words = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "word_id string, word_index bigint")
    weights = spark.createDataFrame([("a", 0.2), ("b", 0.1)], "word_id string, weight double")
    bag = bow.bag_of_words(quantised, words, weights)
    got = {(r.frame_id, r.word_index): r.weight for r in bag.collect()}
    assert got == pytest.approx({(0, 0): 0.8, (0, 1): 0.2, (1, 2): 1.0, (2, 1): 1.0})
    assert {r.frame_id: r.nonzero for r in bow.nonzero_words(bag).collect()} == {0: 2, 1: 1, 2: 1}
    plain = {(r.frame_id, r.word_index): r.weight for r in bow.bag_of_words(quantised, words).collect()}
    assert plain[0, 0] == pytest.approx(2 / 3)
    assert bow.missing_words(quantised, words.filter("word_id <> 'c'")).collect()[0][0] == "c"
    blocks = bow.postings(bag, block=2).collect()
    assert {(r.word_index, r.block): r.frames for r in blocks} == {
        (0, 0): {0: pytest.approx(0.8)}, (1, 0): {0: pytest.approx(0.2)}, (1, 1): {2: 1.0},
        (2, 0): {1: 1.0},
    }


def test_frames_without_descriptors_are_skipped(spark):
    df = spark.createDataFrame([(0, [1]), (1, []), (2, None)], "frame_id bigint, vector array<int>")
    assert [r.frame_id for r in bow.present(df).collect()] == [0]


def test_islands_against_a_loop(spark, bags):
    df, dense = bags
    keyframes = spark.createDataFrame(
        [(f, f * 1_000_000) for f in range(0, FRAMES, 2)], "frame_id bigint, time_us bigint"
    )
    pairs = spark.createDataFrame(
        [(f, f - 1) for f in range(1, FRAMES)], "frame_id bigint, prev_frame_id bigint"
    )
    scored = loop_closure.scored_key_frames(df, keyframes, pairs)
    rows = loop_closure.best_islands(scored, 5_000_000)
    best = {r.query_id: r for r in loop_closure.best_frames(rows).collect()}
    all_ = scores(dense)
    for q in range(2, FRAMES, 2):
        expected = all_[q, q - 1]
        islands, start = {}, None
        for f in range(0, q, 2):
            if expected < 0.1 or all_[q, f] / expected <= 0.3:
                continue
            if start is None or f > start + 5:
                start = f
            islands.setdefault(start, {})[f] = all_[q, f] / expected
        if not islands:
            assert q not in best
            continue
        start = max(islands, key=lambda s: (round(sum(islands[s].values()), 12), -s))
        frame = max(islands[start], key=lambda f: (round(islands[start][f], 12), -f))
        assert (best[q].island_id, best[q].frame_id) == (start * 1_000_000, frame)
        assert best[q].island_frames == len(islands[start])
    assert best
