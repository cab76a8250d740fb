import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import twins
from glyphgrove.functions import metrics
from glyphgrove.operators import assignment, kmedoids
from glyphgrove.operators.assignment import assign, assign_arrow
from glyphgrove.operators.medoid_cost import candidate_costs, measure


def frame(spark, data, kind="int"):
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, f"id bigint, vector array<{kind}>").repartition(3)


@pytest.fixture(scope="module")
def bytes_(spark):
    return np.random.default_rng(5).integers(0, 256, (120, 8))


@pytest.mark.parametrize("metric", ["hamming", "euclidean", "l2sq"])
@pytest.mark.parametrize("dense", [True, False])
def test_fit_equals_the_sequential_definition(spark, metric, dense, monkeypatch):
    if not dense:
        monkeypatch.setattr(kmedoids, "fits_dense", lambda *a: False)
    high = 4 if metric == "hamming" else 256
    data = np.random.default_rng(3).integers(0, high, (120, 8))
    found = kmedoids.fit(frame(spark, data), 5, metric)
    medoids, placed, history = twins.fit(data, 5, metric)
    assert [r.id for r in found.medoids().orderBy("pos").collect()] == medoids
    assert found.costs == history
    got = {r.id: r.pos for r in found.assignment().select("id", "pos").collect()}
    assert got == {i: p for i, p in enumerate(placed) if p >= 0}
    assert all(a > b for a, b in zip(history[:-1], history[1:-1]))


def test_best_policy_returns_the_partition_before(spark, bytes_):
    kept = kmedoids.fit(frame(spark, bytes_), 4, "euclidean", return_policy="best")
    plain = kmedoids.fit(
        frame(spark, bytes_), 4, "euclidean", max_iter=len(kept.costs) - 2
    )
    ids = lambda c: [r.id for r in c.medoids().orderBy("pos").collect()]
    assert ids(kept) == ids(plain)


@pytest.mark.parametrize("metric", ["hamming", "l1", "l2sq"])
@pytest.mark.parametrize("kind", ["int", "double"])
def test_linear_costs_equal_blocked_pairwise_costs(spark, metric, kind, monkeypatch):
    rng = np.random.default_rng(7)
    data = rng.integers(0, 5, (90, 6)) if kind == "int" else np.round(rng.normal(size=(90, 6)), 1)
    points = kmedoids.as_node(frame(spark, data, kind))
    packs = kmedoids.explicit_seeds(points, [0, 1, 2])
    placed = assign(points, packs, metric)
    if kind == "double":
        # make every (cluster, coordinate) count as too large for one window
        from glyphgrove.operators import medoid_cost, ordered

        monkeypatch.setattr(
            medoid_cost, "order_rows", lambda df, k, o: ordered.order_rows(df, k, o, 4)
        )
    shape = measure(points)
    fast = candidate_costs(placed, metric, 3, shape)
    slow = candidate_costs(
        placed, metrics.custom("pairwise", metrics.resolve(metric).cost), block_rows=7
    )
    a = {(r.pos, r.id): float(r.cost) for r in fast.collect()}
    b = {(r.pos, r.id): float(r.cost) for r in slow.collect()}
    assert a.keys() == b.keys() and len(a) == 87
    assert all(a[key] == pytest.approx(b[key], abs=1e-9) for key in a)


def test_costs_without_bounds_use_the_shuffled_lookup(spark, bytes_):
    points = kmedoids.as_node(frame(spark, bytes_))
    placed = assign(points, kmedoids.explicit_seeds(points, [0, 1]), "hamming")
    bounded = candidate_costs(placed, "hamming", 2, measure(points)).collect()
    free = candidate_costs(placed, "hamming").collect()
    assert sorted(map(tuple, bounded)) == sorted(map(tuple, free))


def two_nodes(spark, data):
    """Rows split over two nodes, with medoids in both."""
    df = frame(spark, data).withColumn("node_id", F.when(F.col("id") < 50, "a").otherwise("b"))
    points = df.select("node_id", "id", "vector")
    chosen = points.filter("id % 9 = 0").groupBy("node_id").agg(
        F.sort_array(F.collect_list(F.struct(
            F.floor(F.col("id") / 9).cast("int").alias("pos"), "id", "vector"))).alias("medoids")
    )
    return points, chosen


@pytest.mark.parametrize("metric", ["hamming", "l1", "l2sq", "euclidean"])
@pytest.mark.parametrize("keep, cube", [(False, 0), (True, 1 << 18)])
def test_arrow_assignment_is_the_same(spark, bytes_, metric, keep, cube, monkeypatch):
    # the switch is read where the tasks are pickled, by value, from this process
    monkeypatch.setattr(assignment, "SMALL_CUBE", cube)
    points, packs = two_nodes(spark, bytes_)
    plain = assign(points, packs, metric, keep_medoids=keep)
    quick = assign_arrow(points, packs, metric, keep_medoids=keep)
    columns = ["node_id", "id", "pos", "dist"]
    assert plain.count() == (120 if keep else 106)
    assert sorted(map(tuple, plain.select(columns).collect())) == sorted(
        map(tuple, quick.select(columns).collect())
    )
    assert plain.schema["dist"].dataType == quick.schema["dist"].dataType


@pytest.mark.parametrize("metric", ["hamming", "l2sq"])
@pytest.mark.parametrize("elements", [0, 1 << 30])
def test_both_seeding_forms(spark, metric, elements, monkeypatch):
    monkeypatch.setattr(assignment, "ARROW_ELEMENTS", elements)
    data = np.random.default_rng(6).integers(0, 3, (120, 8))
    points, _ = two_nodes(spark, data)
    packs = kmedoids.farthest_first(points, 4, metric, nodes=2)
    got = {r.node_id: [m.id for m in r.medoids] for r in packs.collect()}
    assert got["a"] == twins.seeds(data[:50], 4, metric)
    assert got["b"] == [50 + i for i in twins.seeds(data[50:], 4, metric)]


def test_wide_comparisons_take_the_arrow_path(spark, bytes_):
    found = kmedoids.fit(frame(spark, np.tile(bytes_, (1, 4))), 40, "hamming", max_iter=1)
    assert "ArrowEvalPython" in found.assignment()._jdf.queryExecution().toString()
    assert found.assignment().count() == 80
    counted = found.assignment().groupBy("node_id").count()
    assert "ArrowEvalPython" not in counted._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("dense", [True, False])
def test_medoid_stays_a_candidate_on_request(spark, dense, monkeypatch):
    if not dense:
        monkeypatch.setattr(kmedoids, "fits_dense", lambda *a: False)
    data = np.array([[0, 0], [1, 0], [0, 1], [9, 9], [9, 8]])
    points = kmedoids.as_node(frame(spark, data))
    packs = kmedoids.explicit_seeds(points, [0, 3])
    shape = measure(points)
    kept = kmedoids.update(points, packs, "l1", 2, 1, shape, candidates="members+medoid", cost="medoid")
    row = kept.first()
    assert [m.id for m in row.medoids] == [0, 3] and row.cost == 3.0
    moved = kmedoids.update(points, packs, "l1", 2, 1, shape).first()
    assert [m.id for m in moved.medoids] == [1, 4] and moved.cost == 4.0


def test_edges(spark):
    data = np.arange(10).reshape(5, 2)
    df = frame(spark, data)
    everything = kmedoids.fit(df, 5, "l1")
    assert everything.assignment().count() == 0
    assert [r.members for r in everything.clusters().collect()] == [[]] * 5
    for k in (0, 6):
        with pytest.raises(ValueError, match="between 1 and 5"):
            kmedoids.fit(df, k, "l1")
    with pytest.raises(ValueError, match="not in the data"):
        kmedoids.fit(df, 2, "l1", seeding=[0, 99])
    with pytest.raises(ValueError, match="different rows"):
        kmedoids.fit(df, 2, "l1", seeding=[1, 1])
    with pytest.raises(ValueError, match="unknown seeding"):
        kmedoids.fit(df, 2, "l1", seeding="clever")
    ragged = spark.createDataFrame([(0, [1]), (1, [1, 2])], "id bigint, vector array<int>")
    with pytest.raises(ValueError, match="length"):
        kmedoids.fit(ragged, 1, "l1")


def test_equal_vectors_leave_empty_clusters(spark):
    df = frame(spark, np.zeros((6, 3), dtype=int))
    found = kmedoids.fit(df, 2, "hamming", seeding=[2, 4])
    lists = found.clusters().orderBy("pos").collect()
    assert [len(r.members) for r in lists] == [4, 0]
    check = kmedoids.completeness(found.assignment(), found.points, 2).first()
    assert check.complete and check.placed == 4


def test_seeding_choices(spark, bytes_):
    df = frame(spark, bytes_)
    a = kmedoids.fit(df, 3, "l1", seeding="random", random_state=4, max_iter=1)
    b = kmedoids.fit(df, 3, "l1", seeding="random", random_state=4, max_iter=1)
    assert a.medoids().orderBy("pos").collect() == b.medoids().orderBy("pos").collect()
    points = kmedoids.as_node(df)
    packs = kmedoids.farthest_first(points, 2, "l1", first=17)
    assert packs.first().medoids[0].id == 17


def test_seeding_beyond_a_refresh(spark, monkeypatch):
    monkeypatch.setattr(kmedoids, "REFRESH", 2)
    data = np.random.default_rng(2).integers(0, 256, (60, 4))
    packs = kmedoids.farthest_first(kmedoids.as_node(frame(spark, data)), 8, "l2sq")
    assert [m.id for m in packs.first().medoids] == twins.seeds(data, 8, "l2sq")


def test_large_tables_are_written_instead_of_pinned(spark, bytes_, monkeypatch):
    from glyphgrove import runtime
    from glyphgrove.operators import dense_update

    for module in (runtime, assignment, dense_update):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    found = kmedoids.fit(frame(spark, bytes_), 4, "hamming", max_iter=2)
    medoids, _, _ = twins.fit(bytes_, 4, "hamming", max_iter=2)
    assert [r.id for r in found.medoids().orderBy("pos").collect()] == medoids


def test_list_blocks_are_bounded(spark, bytes_):
    found = kmedoids.fit(frame(spark, bytes_), 2, "l1", max_iter=1)
    lists = kmedoids.cluster_lists(found.assignment(), found.medoids(), block=10)
    assert lists.agg(F.max(F.size("members"))).first()[0] <= 10
    assert lists.agg(F.sum(F.size("members"))).first()[0] == 118


def test_numpy_metric_in_every_step(spark, bytes_):
    """A metric without column builders: same result as the built-in one it repeats."""
    plain = metrics.from_numpy("manhattan", lambda rows, v: np.abs(rows - v).sum(axis=1))
    found = kmedoids.fit(frame(spark, bytes_), 4, plain, max_iter=3)
    medoids, placed, history = twins.fit(bytes_, 4, "l1", max_iter=3)
    assert [r.id for r in found.medoids().orderBy("pos").collect()] == medoids
    assert found.costs == history
    got = {r.id: r.pos for r in found.assignment().select("id", "pos").collect()}
    assert got == {i: p for i, p in enumerate(placed) if p >= 0}
    pair = spark.sql("select array(1, 2) a, array(4, 0) b")
    assert pair.select(plain.point(F.col("a"), F.col("b"))).first()[0] == 5


def test_seeding_keeps_distances_and_measures_only_new_seeds(spark, monkeypatch):
    data = np.random.default_rng(8).integers(0, 256, (150, 6))
    asked = []
    plain = assignment._distances

    def counted(kernel, rows, medoids):
        asked.append(len(medoids))
        return plain(kernel, rows, medoids)

    monkeypatch.setattr(kmedoids, "REFRESH", 4)
    points = kmedoids.as_node(frame(spark, data))
    found = kmedoids.farthest_first(points, 20, "euclidean").select(F.inline("medoids")).orderBy("pos").collect()
    assert [r.id for r in found] == twins.seeds(data, 20, "euclidean")
    # one batch by hand: with distances kept, only the seeds since then are compared
    monkeypatch.setattr(assignment, "_distances", counted)
    batch = pa.RecordBatch.from_pydict({"near": [5.0, 1.0]})
    near = assignment._near(batch, data[:2], np.arange(2), data[:20], 18, "l2sq")
    assert asked == [2] and (near <= [5.0, 1.0]).all()


def test_a_bound_on_iterations_is_reported(spark, bytes_):
    assert kmedoids.fit(frame(spark, bytes_), 4, "euclidean").converged
    assert not kmedoids.fit(frame(spark, bytes_), 4, "euclidean", max_iter=1).converged


@pytest.mark.parametrize("metric", ["hamming", "l1", "l2sq", "euclidean", "manhattan"])
def test_tables_beyond_the_bound_give_the_same(spark, bytes_, monkeypatch, metric):
    """Nothing is broadcast: medoids and prices meet the rows of their node in salted groups."""
    from glyphgrove.operators import dense_update, grouped

    own = metrics.from_numpy(metric, lambda rows, v: np.abs(rows - v).sum(axis=1)) if metric == "manhattan" else metric
    df = frame(spark, bytes_)
    want = kmedoids.fit(df, 4, own, max_iter=3)
    for module in (assignment, dense_update, kmedoids):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(grouped, "GROUP_ROWS", 7)

    def never(*_):
        raise AssertionError("rows became elements")

    if metric != "manhattan":
        monkeypatch.setattr(kmedoids, "best_candidates", never)
    got = kmedoids.fit(df, 4, own, max_iter=3)
    assert got.medoids().orderBy("pos").collect() == want.medoids().orderBy("pos").collect()
    assert got.costs == want.costs
    columns = ["id", "pos", "dist"]
    assert sorted(got.assignment().select(columns).collect()) == sorted(want.assignment().select(columns).collect())


def test_several_nodes_beyond_the_bound(spark, bytes_, monkeypatch):
    from glyphgrove.operators import dense_update, grouped
    from glyphgrove.operators.medoid_cost import measure

    points = frame(spark, bytes_).select((F.col("id") % 3).cast("string").alias("node_id"), "id", "vector")
    shape = measure(points)
    packs = kmedoids.farthest_first(points, 3, "euclidean", nodes=3, shape=shape)
    metric = metrics.resolve("euclidean")
    for stay, every in ((False, True), (True, False)):
        want = dense_update.dense_update(points, packs, metric, shape, stay, every)
        monkeypatch.setattr(grouped, "GROUP_ROWS", 5)
        got = grouped.update_grouped(points, packs, metric, shape, stay, every)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
