import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrove import runtime
from glyphgrove.operators import consensus, population
from glyphgrove.sources import clusters, vocabulary


def test_vocabulary_text(spark, tmp_path):
    lines = ["10 6 0 0", "0 1 5 7 9  0.5", "3 0 1 2 3  1.25", "0 1 5 7 9  0.75"]
    (tmp_path / "voc.txt").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "voc.txt")
    read = vocabulary.read_vocabulary(spark, path, dimension=3)
    assert sorted(r.vector for r in read.collect()) == [[1, 2, 3], [5, 7, 9], [5, 7, 9]]
    assert vocabulary.read_vocabulary(spark, path, dimension=3, dedup=True).count() == 2
    assert vocabulary.read_vocabulary(spark, path, dimension=None).count() == 3


def test_clusters_json(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"clusters": [[1, 2], [], [3]]}, indent=1))
    got = clusters.read_clusters_json(spark, str(tmp_path / "c.json"), multi_line=True)
    assert sorted(map(tuple, got.collect())) == [(0, 1), (0, 2), (2, 3)]
    shares = {r.cluster: (r.members, r.share) for r in population.population_of_lists(got).collect()}
    assert shares == {0: (2, pytest.approx(2 / 3)), 2: (1, pytest.approx(1 / 3))}


def test_written_clusters_spread_over_documents(spark, tmp_path):
    rows = spark.range(100).selectExpr("cast(id % 3 as int) pos", "id")
    path = str(tmp_path / "out")
    clusters.write_clusters_json(rows, path, 4, document_rows=10)
    assert spark.read.json(path).count() > 3
    got = clusters.read_clusters_json(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted((r.pos, r.id) for r in rows.collect())


def test_population_helpers(spark):
    df = spark.createDataFrame(
        [(0, [1, 4]), (1, [9, 0]), (2, [1, 4])], "id bigint, vector array<int>"
    )
    assert sorted(r.id for r in population.distinct_vectors(df).collect()) == [0, 1]
    assert population.root_mean_vector(df).first().vector == pytest.approx([5 / 3, 4 / 3])
    assert population.sample_rows(df, 2, 1).collect() == population.sample_rows(df, 2, 1).collect()
    listed = spark.createDataFrame([(2,), (2,)], "id bigint")
    assert [r.id for r in population.gather(df, listed).collect()] == [2]
    spread = spark.range(200).selectExpr("id", "array(id % 2 * 100 + id % 7, id % 5) vector")
    centres, placed = population.kmeans_baseline(spread, k=2, max_iter=5, tol=0.0, attempts=3)
    assert placed.count() == 200 and centres.count() == 2
    assert all(c.count() == 0 for c in population.kmeans_baseline(spread.limit(0)))
    assert sorted(r["count"] for r in placed.groupBy("cluster").count().collect()) == [100, 100]


@pytest.fixture(scope="module")
def planted(spark):
    """Pairs that follow one homography per group, with outliers; group 0 is large, 3 too small."""
    rng = np.random.default_rng(12)
    rows = []
    for group, n in ((0, 1500), (1, 60), (2, 20), (3, 3)):
        h = np.array([[1.1, 0.05 * group, 20], [-0.04, 0.95, 5], [1e-5, 2e-5, 1]])
        for i in range(n):
            x, y = rng.uniform(0, 500, 2)
            u, v, w = h @ (x, y, 1)
            good = i % 4 != 0
            shift = rng.normal(0, 0.3, 2) if good else rng.uniform(60, 300, 2)
            placed = (x, y, u / w + shift[0], v / w + shift[1])
            rows.append((group, i, *map(float, placed), good))
    schema = "g bigint, i int, src_x double, src_y double, dst_x double, dst_y double, good boolean"
    return spark.createDataFrame(rows, schema)


def test_consensus_finds_the_planted_inliers(planted):
    kept = consensus.consensus_filter(planted, "g", ["i"]).collect()
    for r in kept:
        assert r.inlier == (r.good and r.g != 3), r
    counts = {r.g: (r.pairs, r.tracked) for r in consensus.tracked(
        consensus.consensus_filter(planted, "g", ["i"]), "g").collect()}
    assert counts == {0: (1500, 1125), 1: (60, 45), 2: (20, 15), 3: (3, 0)}


def test_consensus_is_the_same_in_small_blocks_and_any_partitioning(planted, monkeypatch):
    whole = sorted(map(str, consensus.consensus_models(planted, "g", ["i"]).collect()))
    monkeypatch.setattr(consensus, "BLOCK", 100)
    parts = sorted(map(str, consensus.consensus_models(planted.repartition(7), "g", ["i"]).collect()))
    assert whole == parts and len(whole) == 3


def test_consensus_sends_no_table_to_all(planted):
    found = consensus.consensus_models(planted, "g", ["i"])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_ways_agree(spark, how):
    rows = spark.range(200).selectExpr("id", "case when id < 80 then 0 else id % 7 end k")
    table = spark.createDataFrame([(0, "a"), (3, "b"), (5, "c")], "k bigint, v string")
    sent = runtime.lookup_join(rows, table, ["k"], how, table_bytes=100)
    salted = runtime.lookup_join(rows, table, ["k"], how, hot=True)
    plain = rows.join(table, ["k"], how)
    columns = sorted(plain.columns)
    expect = sorted(map(str, plain.select(columns).collect()))
    assert sorted(map(str, sent.select(columns).collect())) == expect
    assert sorted(map(str, salted.select(columns).collect())) == expect


def test_scratch_follows_the_session(spark):
    assert runtime.scratch_path(spark, "x").startswith(runtime.scratch_root(spark))
    df = runtime.materialise(spark.range(5).withColumn("v", F.col("id") * 2), "t")
    assert df.inputFiles() and df.count() == 5
