import numpy as np
import pytest
from pyspark.sql import functions as F

import twins
from glyphgrove.functions import metrics
from glyphgrove.operators import bow, matching, tree
from glyphgrove.sources import model as model_files


@pytest.fixture(scope="module")
def data():
    return np.unique(np.random.default_rng(4).integers(0, 3, (90, 10)), axis=0)


@pytest.fixture(scope="module")
def grown(spark, data):
    df = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(data)], "id bigint, vector array<int>"
    )
    built = tree.build_tree(df, 4, "hamming")
    return df, built, tree.words(built).persist()


def test_tree_equals_the_recursive_definition(data, grown):
    _, built, _ = grown
    want = twins.tree(data, np.arange(len(data)), 4, "hamming")
    nodes = {r.node_id: r for r in built.nodes.collect()}
    members = {}
    for r in built.members.collect():
        members.setdefault(r.node_id, {})[r.pos] = r.id
    for path, (medoids, clusters) in want.items():
        parent = "-".join(map(str, path)) or "root"
        for pos, (medoid, ids) in enumerate(zip(medoids, clusters)):
            node = nodes.pop("-".join(map(str, (*path, pos))))
            assert (node.parent_id, node.pos, node.id, node.size) == (parent, pos, medoid, len(ids))
            assert node.is_leaf == (len(ids) <= 4) and node.depth == len(path) + 1
            if node.is_leaf:
                assert members.pop(node.node_id, {}) == dict(enumerate(ids))
    assert not nodes and not members


def test_words_are_numbered_depth_first(grown):
    _, built, words = grown
    listed = [r.word_id for r in words.orderBy("word_index").collect()]
    assert listed == sorted(listed, key=lambda w: [int(s) for s in w.split("-")])
    assert [r.word_index for r in words.orderBy("word_index").collect()] == list(range(len(listed)))
    assert tree.inverse_index(words).count() == len(listed)
    empty = built.nodes.filter("size = 0").count()
    assert len(listed) == built.members.count() + empty


def test_duplicate_word_numbers_are_refused(spark):
    words = spark.createDataFrame([("0", 1), ("1", 1)], "word_id string, word_index bigint")
    with pytest.raises(ValueError, match="not unique"):
        tree.inverse_index(words)


def descend(levels, vector):
    path = "root"
    while path in levels:
        entries = sorted(levels[path])
        best = min(entries, key=lambda e: ((np.array(e[1]) != vector).sum(), e[0]))[0]
        path = str(best) if path == "root" else f"{path}-{best}"
    return path


def test_descent_and_leaf_property(spark, data, grown):
    df, built, words = grown
    table = tree.level_vectors(built)
    levels = {}
    for r in table.collect():
        levels.setdefault(r.node_id, []).append((r.pos, r.vector))
    for bound in (1 << 20, None):
        rows = tree.quantise(df, table, built.depth, table_bytes=bound).collect()
        assert {r.id: r.word_id for r in rows} == {
            i: descend(levels, v) for i, v in enumerate(data)
        }
    known = {r.word_id for r in words.collect()}
    assert {r.word_id for r in rows} <= known
    # whoever reaches its own leaf gets the word of an equal vector
    leaf_of = {r.id: (r.node_id, r.pos) for r in built.members.collect()}
    for r in rows:
        node, pos = leaf_of.get(r.id, (None, None))
        if node and r.word_id.rsplit("-", 1)[0] == node:
            assert r.word_id == f"{node}-{pos}"


def test_neighbourhoods(grown):
    _, built, words = grown
    listed = [r.word_id for r in words.collect()]

    def near(word, distance):
        above = word.split("-")[:-distance] or ["root"]
        stem = "-".join(above)
        return {w for w in listed if stem == "root" or w.startswith(stem + "-")}

    for distance in (1, 2):
        got = {}
        for r in tree.neighbourhood(words, distance).collect():
            got.setdefault(r.word_id, set()).add(r.neighbour_id)
        assert got == {w: near(w, distance) for w in listed}


def test_children(grown):
    _, built, _ = grown
    got = {r.parent_id: r.children for r in tree.children(built).collect()}
    for parent, kids in got.items():
        assert kids == [str(i) if parent == "root" else f"{parent}-{i}" for i in range(4)]


def test_depth_cap_makes_bounded_words(spark, grown):
    df, _, _ = grown
    capped = tree.build_tree(df, 4, "hamming", max_depth=1)
    assert capped.depth == 1 and capped.nodes.filter("not is_leaf").count() == 0
    assert tree.level_vectors(capped).groupBy("node_id").count().agg(F.max("count")).first()[0] <= 4


def test_model_round_trip(spark, grown, tmp_path):
    df, built, words = grown
    rows = tree.quantise(df, tree.level_vectors(built), built.depth)
    saved = model_files.build_model(built, bow.word_weights(rows), words)
    model_files.write_model(saved, str(tmp_path))
    model = model_files.read_model(spark, str(tmp_path))
    again = tree.quantise(df, model.levels, model.depth)
    assert sorted(map(tuple, again.select("id", "word_id").collect())) == sorted(
        map(tuple, rows.select("id", "word_id").collect())
    )
    assert model.weights.agg(F.sum("weight")).first()[0] == pytest.approx(1)


@pytest.fixture(scope="module")
def framed(spark, grown):
    df, built, words = grown
    rows = df.select(
        F.floor(F.col("id") / 9).cast("bigint").alias("frame_id"),
        (F.col("id") % 9).cast("int").alias("pos"), "vector",
    )
    quantised = tree.quantise(rows, tree.level_vectors(built), built.depth).persist()
    pairs = spark.createDataFrame([(f, f - 1) for f in range(1, 10)], "frame_id bigint, prev_frame_id bigint")
    return rows, quantised, pairs, words


def test_candidate_matches(framed):
    _, quantised, pairs, words = framed
    frames = {}
    for r in quantised.collect():
        frames.setdefault(r.frame_id, {})[r.pos] = r.word_id
    near = {}
    for r in tree.neighbourhood(words).collect():
        near.setdefault(r.word_id, set()).add(r.neighbour_id)
    want = set()
    for f in range(1, 10):
        earlier = [frames[f - 1][p] for p in sorted(frames[f - 1])]
        for pos, word in frames[f].items():
            want |= {(f, pos, f - 1, earlier.index(n)) for n in near[word] if n in earlier}
    got = [tuple(r) for r in matching.candidate_matches(quantised, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == want

    covered = {f: set().union(*(near[w] for w in frames[f].values())) for f in frames}
    asked = pairs.selectExpr("frame_id query_id", "prev_frame_id frame_id")
    for r in matching.uncovered_words(asked, quantised).collect():
        used = set(frames[r.query_id].values())
        assert (r.total, r.uncovered) == (len(used), len(used - covered[r.frame_id]))

    index = {r.word_id: r.word_index for r in words.collect()}
    owners = {}
    for f, found in frames.items():
        for word in sorted(found.values(), key=index.get):
            owners.update({(f, n): word for n in near[word]})
    assert {
        (r.frame_id, r.neighbour_id): r.word_id
        for r in matching.neighbour_map(quantised, words).collect()
    } == owners


def test_brute_force_blocks(framed):
    rows, _, pairs, _ = framed
    frames = {}
    for r in rows.collect():
        frames.setdefault(r.frame_id, {})[r.pos] = np.array(r.vector)
    got = matching.brute_force(rows, pairs, metrics.resolve("hamming"), block_rows=2).collect()
    assert len(got) == sum(len(frames[f]) for f in range(1, 10))
    for r in got:
        here, there = frames[r.frame_id][r.pos], frames[r.frame_id - 1]
        dist, pos = min(((here != v).sum(), p) for p, v in there.items())
        assert (r.hamming, r.prev_pos, r.compared) == (dist, pos, len(there))
        assert r.equal == sum((here == v).all() for v in there.values())
        assert r.l2 == pytest.approx(np.linalg.norm(here - there[pos]))


@pytest.mark.parametrize("metric, options", [
    ("hamming", {}), ("euclidean", {"max_depth": 2, "return_policy": "best", "max_iter": 2}),
    ("l1", {"candidates": "members+medoid", "cost": "medoid"}), ("far", {}),
])
def test_subtrees_in_tasks_equal_the_jobs(spark, metric, options):
    if metric == "far":
        metric = metrics.from_numpy("far", lambda rows, vector: np.abs(rows.astype(float) - vector).max(axis=1))
    values = np.unique(np.random.default_rng(8).integers(0, 5, (40, 6)), axis=0)
    df = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(values)], "id bigint, vector array<int>")
    # nothing in tasks, and nodes of some 12 rows, everything below the root
    built = [tree.build_tree(df, 4, metric, local_bytes=b, **options) for b in (0, 12 * 8 * 6, None)]
    nodes = [sorted(map(str, t.nodes.collect())) for t in built]
    members = [sorted(map(str, t.members.collect())) for t in built]
    assert nodes[0] == nodes[1] == nodes[2] and members[0] == members[1] == members[2]
    assert len({t.depth for t in built}) == 1


def test_pair_blocks_equal_the_table_of_values(monkeypatch):
    from glyphgrove.operators import subtree
    from glyphgrove.operators.medoid_cost import Shape

    rows = np.random.default_rng(2).integers(0, 4, (60, 5))
    shape = Shape(60, 5, 0, 3, True)
    for name in ("hamming", "l1", "l2sq", "euclidean"):
        metric = metrics.resolve(name)
        found = subtree.fit_local(rows, 4, metric, shape)
        monkeypatch.setattr(subtree, "TABLE_CELLS", 0)
        monkeypatch.setattr(subtree, "PAIR_ROWS", 7)
        assert (subtree.fit_local(rows, 4, metric, shape) == found).all()
        monkeypatch.undo()


def test_descent_by_joins_keeps_plans_short(spark):
    deep = 9
    entries = [("root", 0, [0]), ("root", 1, [9])]
    entries += [("-".join("0" * n), p, [v]) for n in range(1, deep) for p, v in ((0, 0), (1, 9))]
    levels = spark.createDataFrame(entries, "node_id string, pos int, vector array<int>")
    rows = spark.createDataFrame([(1, [0]), (2, [9]), (3, None)], "id bigint, vector array<int>")
    found = tree.quantise(rows, levels, deep)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= tree.PLAN_LEVELS
    words = {r.id: r.word_id for r in found.collect()}
    assert words[1] == "-".join("0" * deep) and words[2] == "1"
