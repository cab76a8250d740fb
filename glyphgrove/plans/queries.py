"""The query catalogue: one function ``(spark, sf_dir) -> DataFrame`` per operator or feature."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrove.functions import metrics, vectors
from glyphgrove.operators import (
    bow, consensus, frames, kalman, kmedoids, loop_closure, matching, population, postings, similarity, tree,
)
from glyphgrove.operators.assignment import assign
from glyphgrove.operators.medoid_cost import best_candidates, candidate_costs
from glyphgrove.operators.ordered import dense_ids
from glyphgrove.plans import inputs
from glyphgrove.plans.inputs import K
from glyphgrove.runtime import lookup_join, materialise, scratch_path, shuffled, vector_bytes
from glyphgrove.sources import clusters as cluster_files
from glyphgrove.sources import model as model_files
from glyphgrove.sources import vocabulary as vocabulary_files
from glyphgrove.streaming import frames as stream_frames
from glyphgrove.streaming import process as stream_process

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, Query] = {}

#: Frames left out of retrieval, island time, and the score that reported pairs exceed.
EXCLUDE_RECENT = 5
POOL = 5_000_000
MIN_SCORE = 0.0


def query(function: Query) -> Query:
    CATALOGUE[function.__name__] = function
    return function


def _r(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits)


def _joined(array: Column | str) -> Column:
    column = F.col(array) if isinstance(array, str) else array
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


# ---------------------------------------------------------------- sources and sinks


@query
def src_vocab_text(spark, sf_dir):
    path = scratch_path(spark, "vocabulary")
    vocabulary_files.write_vocabulary(inputs.bytes_(spark, sf_dir), path)
    rows = vocabulary_files.read_vocabulary(spark, path, dimension=64)
    return rows.select(vectors.to_key(F.col("vector")).alias("key"), F.size("vector").alias("n"))


@query
def vocab_dedup(spark, sf_dir):
    path = scratch_path(spark, "vocabulary")
    rows = inputs.bytes_(spark, sf_dir)
    vocabulary_files.write_vocabulary(rows.unionByName(rows), path)
    rows = vocabulary_files.read_vocabulary(spark, path, dimension=64, dedup=True)
    keyed = rows.select(vectors.to_key(F.col("vector")).alias("key"))
    return keyed.select("key", _joined(vectors.from_key(F.col("key"))).alias("elements"))


@query
def src_dense_id(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "events").select("user_id", "event_id")
    return dense_ids(rows, ["user_id", "event_id"])


@query
def src_clusters_json(spark, sf_dir):
    path = scratch_path(spark, "clusters")
    cluster_files.write_clusters_json(kmedoids_assign(spark, sf_dir), path, K)
    return cluster_files.read_clusters_json(spark, path)


@query
def sink_model_roundtrip(spark, sf_dir):
    grown, vocabulary = inputs.tree_vocabulary(spark, sf_dir)
    weights = bow.word_weights(inputs.tree_words(spark, sf_dir))
    path = scratch_path(spark, "model")
    model_files.write_model(model_files.build_model(grown, weights, vocabulary), path)
    model = model_files.read_model(spark, path)
    # without a size bound: the form with one lookup join per level
    rows = tree.quantise(inputs.features(spark, sf_dir), model.levels, model.depth)
    bag = bow.bag_of_words(rows, model.words, model.weights)
    return bag.select("frame_id", "word_index", _r("weight").alias("weight"))


# ---------------------------------------------------------------- distances


@query
def dist_metrics(spark, sf_dir):
    def side(prefix: str, convert) -> DataFrame:
        return inputs.features(spark, sf_dir, convert).select(
            "frame_id", "pos", F.col("vector").alias(prefix)
        )

    both = side("bits", vectors.sign_bits).join(side("bytes", vectors.to_bytes), ["frame_id", "pos"])
    earlier = both.select(
        F.col("frame_id").alias("prev_frame_id"), "pos",
        F.col("bits").alias("prev_bits"), F.col("bytes").alias("prev_bytes"),
    )
    paired = lookup_join(both, inputs.frame_pairs(spark, sf_dir), ["frame_id"])
    met = lookup_join(paired, earlier, ["prev_frame_id", "pos"])
    near, far = (F.col("bits"), F.col("prev_bits")), (F.col("bytes"), F.col("prev_bytes"))
    return met.select(
        "frame_id",
        "pos",
        metrics.hamming(*near).alias("hamming"),
        metrics.l1(*far).alias("l1"),
        metrics.l2sq(*far).alias("l2sq"),
        _r(metrics.l2(*far)).alias("l2"),
        (near[0] == near[1]).cast("int").alias("exact"),
        _r(metrics.percent_equal(*far)).alias("percent"),
    )


@query
def match_bruteforce(spark, sf_dir):
    found = matching.brute_force(
        inputs.features(spark, sf_dir), inputs.frame_pairs(spark, sf_dir), "hamming"
    )
    return found.select(
        "frame_id", "prev_frame_id", "pos", "prev_pos", "compared", "equal", "hamming",
        _r("percent").alias("percent"), _r("l2").alias("l2"),
    )


# ---------------------------------------------------------------- k-medoids


@query
def seed_farthest(spark, sf_dir):
    _, seeds, _ = inputs.seeded(spark, sf_dir)
    return seeds.select(F.inline("medoids")).select("pos", "id")


@query
def seed_explicit(spark, sf_dir):
    points = kmedoids.as_node(inputs.bits(spark, sf_dir))
    ids = [r.id for r in points.orderBy(F.desc("id")).select("id").limit(K).collect()]
    packs = kmedoids.explicit_seeds(points, ids)
    placed = assign(points, packs, "hamming")
    return placed.groupBy("pos").agg(
        F.count(F.lit(1)).alias("members"), F.sum("dist").alias("dist")
    )


def _assigned(spark, sf_dir, convert=inputs.bits, metric="hamming"):
    points, seeds, shape = inputs.seeded(spark, sf_dir, convert, metric)
    fitted = kmedoids.Clustering(points, seeds, metrics.resolve(metric), K, 1, shape)
    return fitted, shape


@query
def kmedoids_assign(spark, sf_dir):
    fitted, _ = _assigned(spark, sf_dir)
    return fitted.assignment().select("id", "pos", "dist")


def _farthest_coordinate(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.abs(rows.astype(float) - vector).max(axis=1)


@query
def kmedoids_custom_metric(spark, sf_dir):
    metrics.register(metrics.from_numpy("chebyshev", _farthest_coordinate))
    fitted, _ = _assigned(spark, sf_dir, inputs.bytes_, "chebyshev")
    return fitted.assignment().select("id", "pos", "dist")


@query
def kmedoids_check(spark, sf_dir):
    fitted, _ = _assigned(spark, sf_dir)
    checked = kmedoids.completeness(fitted.assignment(), fitted.points, K)
    return checked.withColumn("complete", F.col("complete").cast("int"))


@query
def cluster_members(spark, sf_dir):
    fitted, _ = _assigned(spark, sf_dir)
    return fitted.clusters().select(
        "pos", "medoid_id", "block", _joined("members").alias("members"),
        F.size("members").alias("n"),
    )


@query
def cluster_population(spark, sf_dir):
    path = scratch_path(spark, "assignment")
    fitted, _ = _assigned(spark, sf_dir)
    cluster_files.write_assignment(fitted.assignment().select("node_id", "id", "pos", "dist"), path)
    shares = population.population(cluster_files.read_assignment(spark, path))
    return shares.select("pos", "members", _r("share").alias("share"))


def _costs(spark, sf_dir, convert, metric):
    fitted, shape = _assigned(spark, sf_dir, convert, metric)
    costs = candidate_costs(fitted.assignment(), metric, K, shape)
    return costs.select("pos", "id", F.col("cost").cast("double").alias("cost"))


@query
def medoid_cost(spark, sf_dir):
    return _costs(spark, sf_dir, inputs.bits, "hamming")


@query
def medoid_cost_l1(spark, sf_dir):
    return _costs(spark, sf_dir, inputs.bytes_, "l1")


@query
def medoid_cost_l2sq(spark, sf_dir):
    return _costs(spark, sf_dir, inputs.bytes_, "l2sq")


@query
def kmedoids_update(spark, sf_dir):
    fitted, shape = _assigned(spark, sf_dir)
    best = best_candidates(fitted.assignment(), "hamming", K, shape)
    return best.select(
        "pos", "id", F.col("medoid_cost").cast("double").alias("medoid_cost"),
        F.col("all_pairs").cast("double").alias("all_pairs"), "members",
    )


@query
def kmedoids_fit(spark, sf_dir):
    fitted = kmedoids.fit(inputs.bits(spark, sf_dir), K, "hamming")
    return fitted.medoids().select("pos", "id", F.lit(int(fitted.converged)).alias("converged"))


@query
def kmedoids_fit_best(spark, sf_dir):
    fitted = kmedoids.fit(inputs.bits(spark, sf_dir), K, "hamming", return_policy="best")
    return fitted.medoids().select("pos", "id")


@query
def kmedoids_fit_random(spark, sf_dir):
    fitted = kmedoids.fit(inputs.bits(spark, sf_dir), K, "hamming", seeding="random", random_state=11)
    return fitted.medoids().select("pos", "id")


@query
def kmedoids_fit_euclidean(spark, sf_dir):
    fitted = kmedoids.fit(inputs.bytes_(spark, sf_dir), K, "euclidean")
    sizes = fitted.assignment().groupBy("pos").agg(F.count(F.lit(1)).alias("members"))
    return fitted.medoids().join(sizes, "pos", "left").select(
        "pos", "id", F.coalesce("members", F.lit(0)).alias("members")
    )


@query
def sample_rows(spark, sf_dir):
    return population.sample_rows(inputs.bits(spark, sf_dir), 50, 7).select("id")


@query
def root_mean_descriptor(spark, sf_dir):
    means = population.root_mean(inputs.bytes_(spark, sf_dir))
    return means.select("j", _r("mean").alias("mean"))


@query
def kmeans_baseline(spark, sf_dir):
    _, placed = population.kmeans_baseline(inputs.bytes_(spark, sf_dir))
    return placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))


@query
def kmeans_attempts(spark, sf_dir):
    """Few centres, so that the attempts differ: which one wins, at what cost, and its clusters."""
    centres, placed = population.kmeans_baseline(inputs.bytes_(spark, sf_dir), k=2 * K)
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("dist").alias("dist"))
    return centres.join(sizes, "cluster", "left").select(
        "attempt", "cluster", F.coalesce("members", F.lit(0)).alias("members"),
        F.round(F.coalesce("dist", F.lit(0.0)), 2).alias("dist"))


# ---------------------------------------------------------------- vocabulary tree


@query
def tree_build(spark, sf_dir):
    grown, _ = inputs.tree_vocabulary(spark, sf_dir)
    return grown.nodes.select(
        "node_id", "parent_id", "pos", "depth", "id", "size", F.col("is_leaf").cast("int").alias("is_leaf")
    )


@query
def tree_words(spark, sf_dir):
    grown, vocabulary = inputs.tree_vocabulary(spark, sf_dir)
    both = tree.inverse_index(vocabulary).join(vocabulary, ["word_index", "word_id"])
    return both.select("word_index", "word_id", "leaf_id")


@query
def tree_children(spark, sf_dir):
    grown, _ = inputs.tree_vocabulary(spark, sf_dir)
    levels = tree.level_vectors(grown).groupBy("node_id").agg(F.count(F.lit(1)).alias("vectors"))
    return tree.children(grown).join(levels, F.col("parent_id") == F.col("node_id")).select(
        "parent_id", _joined("children").alias("children"), "vectors"
    )


@query
def tree_quantise(spark, sf_dir):
    return inputs.tree_words(spark, sf_dir).select("frame_id", "pos", "word_id")


@query
def tree_neighbourhood(spark, sf_dir):
    _, vocabulary = inputs.tree_vocabulary(spark, sf_dir)
    return tree.neighbourhood(vocabulary)


# ---------------------------------------------------------------- bags of words


@query
def word_weights(spark, sf_dir):
    weights = bow.word_weights(inputs.tree_words(spark, sf_dir))
    return weights.select("word_id", _r("weight").alias("weight"))


@query
def word_onehot(spark, sf_dir):
    _, vocabulary = inputs.tree_vocabulary(spark, sf_dir)
    rows = inputs.tree_words(spark, sf_dir)
    weights = bow.word_weights(rows)
    indexed = lookup_join(rows, vocabulary, ["word_id"], hot=True)
    weighted = lookup_join(indexed, weights, ["word_id"], "left", hot=True)
    hot = bow.one_hot_words(weighted, vocabulary.count())
    return hot.select("frame_id", "pos", "word_index", "nonzero", _r("weight").alias("weight"))


@query
def bow_frames(spark, sf_dir):
    _, vocabulary = inputs.tree_vocabulary(spark, sf_dir)
    rows = inputs.tree_words(spark, sf_dir)
    bag = bow.bag_of_words(rows, vocabulary, bow.word_weights(rows))
    counts = bow.nonzero_words(bag)
    return lookup_join(bag, counts, ["frame_id"]).select(
        "frame_id", "word_index", _r("weight").alias("weight"), "nonzero"
    )


@query
def bow_similarity(spark, sf_dir):
    bag = inputs.bags(spark, sf_dir)
    near = similarity.similar_frames(
        bag, bag, MIN_SCORE, admissible=F.col("frame_id") < F.col("query_id")
    )
    return near.select("query_id", "frame_id", _r("score").alias("score"))


@query
def inverted_index(spark, sf_dir):
    lists = bow.postings(inputs.bags(spark, sf_dir))
    return lists.select(
        "word_index",
        "block",
        _joined(F.map_keys("frames")).alias("frame_ids"),
        _r(
            F.aggregate(F.map_values("frames"), F.lit(0.0), lambda a, x: a + x)
        ).alias("total"),
    )


@query
def retrieve_best(spark, sf_dir):
    sequence = inputs.frames(spark, sf_dir).select("frame_id", "seq")
    best = similarity.retrieve_best(inputs.bags(spark, sf_dir), sequence, EXCLUDE_RECENT)
    return best.select(
        "frame_id", "seq", "best_seq", _r("score").alias("score"),
        vectors.floor_cents(_r("score", 9)).alias("shown"),
    )


@query
def retrieve_blocks(spark, sf_dir):
    """The same search through an index of postings blocks, of which most are skipped."""
    bags = materialise(lookup_join(
        inputs.bags(spark, sf_dir), inputs.frames(spark, sf_dir).select("stream_id", "frame_id", "seq", "time_us"),
        ["frame_id"],
    ), "bags")
    index = postings.open_index(spark, scratch_path(spark, "postings"))
    index.append(0, postings.to_blocks(bags))
    asked = bags.select(
        "stream_id", F.col("frame_id").alias("query_id"), (F.col("seq") - EXCLUDE_RECENT).alias("until"),
        "word_index", "weight")
    best = postings.best_past(index.read(), asked).withColumnRenamed("query_id", "frame_id")
    listed = inputs.frames(spark, sf_dir).select("frame_id", "seq")
    score = F.coalesce("score", F.lit(0.0))
    return shuffled(listed).join(best, "frame_id", "left").select(
        "frame_id", "seq", "best_seq", _r(score).alias("score"), vectors.floor_cents(_r(score, 9)).alias("shown"))


# ---------------------------------------------------------------- frame streams in batch


@query
def frame_lag(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    lagged = frames.with_previous(
        rows, ["user_id"], ["ts", "event_id"],
        {"event_id": "prev_event_id", "value": "prev_value"},
    )
    return lagged.select("user_id", "seq", "event_id", "value", "prev_event_id", "prev_value")


@query
def motion_cumulative(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", F.col("value").alias("dx"), (-F.col("value") / 2).alias("dy")
    )
    moved = frames.cumulative_motion(
        rows, ["user_id"], ["ts", "event_id"], {"dx": "x", "dy": "y"}
    )
    return moved.select("user_id", "event_id", _r("x", 4).alias("x"), _r("y", 4).alias("y"))


@query
def keyframes(spark, sf_dir):
    picked = frames.key_frames(inputs.frame_events(spark, sf_dir), ["stream_id"])
    return picked.select("stream_id", "seq", "event_id", "n_points")


@query
def match_candidates(spark, sf_dir):
    return matching.candidate_matches(
        inputs.tree_words(spark, sf_dir), inputs.frame_pairs(spark, sf_dir)
    )


def _consensus(spark, sf_dir):
    rows = inputs.tree_words(spark, sf_dir)
    points = rows.select("frame_id", "pos", "x", "y")
    matched = matching.candidate_matches(rows, inputs.frame_pairs(spark, sf_dir))
    source = points.withColumnsRenamed({"x": "src_x", "y": "src_y"})
    target = points.withColumnsRenamed(
        {"frame_id": "prev_frame_id", "pos": "prev_pos", "x": "dst_x", "y": "dst_y"}
    )
    placed = lookup_join(matched, source, ["frame_id", "pos"])
    placed = materialise(lookup_join(placed, target, ["prev_frame_id", "prev_pos"]), "pairs")
    return consensus.consensus_filter(placed, "frame_id", ["pos", "prev_pos"])


@query
def match_consensus(spark, sf_dir):
    return consensus.tracked(_consensus(spark, sf_dir), "frame_id")


@query
def match_inliers(spark, sf_dir):
    return _consensus(spark, sf_dir).filter("inlier").select("frame_id", "prev_frame_id", "pos", "prev_pos")


def _key_frames(spark, sf_dir):
    picked = frames.key_frames(
        inputs.frames(spark, sf_dir), ["stream_id"], gap=inputs.GAP, min_points=inputs.MIN_POINTS
    )
    return picked.select("frame_id", "time_us")


def _scored(spark, sf_dir):
    return loop_closure.scored_key_frames(
        inputs.bags(spark, sf_dir), _key_frames(spark, sf_dir),
        inputs.frame_pairs(spark, sf_dir),
    )


@query
def loop_islands(spark, sf_dir):
    rows = loop_closure.best_islands(materialise(_scored(spark, sf_dir), "scored"), POOL)
    return rows.select(
        "query_id", "frame_id", "time_us", "island_id", _r("score").alias("score"),
        _r("island_score").alias("island_score"), "island_frames",
        F.col("is_best").cast("int").alias("is_best"),
    )


@query
def session_islands(spark, sf_dir):
    timed = _scored(spark, sf_dir).withColumn("ts", F.timestamp_micros("time_us"))
    rows = frames.session_islands(timed, ["query_id"], "ts")
    return rows.select(
        "query_id",
        vectors.micros(F.col("island_start")).alias("start_at"),
        vectors.micros(F.col("island_end")).alias("end_at"),
        "frames",
        _r("score").alias("score"),
    )


@query
def loop_closures(spark, sf_dir):
    found = loop_closure.loop_closures(
        inputs.bags(spark, sf_dir), inputs.tree_words(spark, sf_dir),
        _key_frames(spark, sf_dir), inputs.frame_pairs(spark, sf_dir), POOL,
    )
    return found.select(
        "query_id", "frame_id", "island_id", _r("island_score").alias("island_score"),
        "island_frames", _r("score").alias("score"), "total", "uncovered",
        F.col("closed").cast("int").alias("closed"),
    )


CATALOGUE["loop_closure"] = CATALOGUE.pop("loop_closures")


@query
def neighbour_words(spark, sf_dir):
    _, vocabulary = inputs.tree_vocabulary(spark, sf_dir)
    return matching.neighbour_map(inputs.tree_words(spark, sf_dir), vocabulary)


@query
def kalman_track(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    tracked = kalman.kalman_track(rows, ["user_id"], ["ts", "event_id"], "value")
    return tracked.select(
        "user_id", "event_id", "step", *[_r(c).alias(c) for c in kalman.OUTPUTS]
    )


# ---------------------------------------------------------------- streams


def _arrivals(spark, rows: DataFrame, order: str, consume: Callable[[DataFrame, str], None]) -> None:
    """Let ``rows`` arrive in three steps along ``order``, and run the stream after each.

    The three runs share a checkpoint, so the stream also has to restart twice.
    """
    path, checkpoint = scratch_path(spark, "arrivals"), scratch_path(spark, "stream")
    first, second = rows.approxQuantile(order, [1 / 3, 2 / 3], 0.01)
    position = F.col(order)
    steps = [position <= first, (position > first) & (position <= second),
             (position > second) | position.isNull()]
    for step in steps:
        rows.filter(step).write.mode("append").parquet(path)
        consume(stream_frames.read_frames(spark, path, rows.schema), checkpoint)


@query
def stream_keyframes(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), vectors.micros(F.col("ts")).alias("time_us"),
        "event_id", F.col("value").alias("n_points"),
    )
    found = scratch_path(spark, "keyframes")

    def consume(stream: DataFrame, checkpoint: str) -> None:
        picked = stream_frames.keyframe_stream(
            stream, "stream_id", ["time_us", "event_id"], "n_points"
        )
        stream_frames.sink_parquet(picked, found, checkpoint)

    _arrivals(spark, rows, "time_us", consume)
    return spark.read.parquet(found).select("stream_id", "seq", "event_id", "n_points")


@query
def stream_kalman(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "events").select(
        "user_id", vectors.micros(F.col("ts")).alias("time_us"), "event_id", "value"
    )
    found = scratch_path(spark, "tracks")

    def consume(stream: DataFrame, checkpoint: str) -> None:
        tracked = stream_frames.kalman_stream(stream, "user_id", ["time_us", "event_id"], "value")
        stream_frames.sink_parquet(tracked, found, checkpoint)

    _arrivals(spark, rows, "time_us", consume)
    return spark.read.parquet(found).select(
        "user_id", "event_id", "step", *[_r(c).alias(c) for c in kalman.OUTPUTS]
    )


def _numbered_features(spark, sf_dir) -> DataFrame:
    numbers = lookup_join(
        inputs.frames(spark, sf_dir).select("stream_id", "frame_id", "seq"),
        inputs.frame_pairs(spark, sf_dir), ["frame_id"], "left",
    )
    return lookup_join(inputs.features(spark, sf_dir), numbers, ["frame_id"])


@query
def stream_prev_match(spark, sf_dir):
    grown, _ = inputs.tree_vocabulary(spark, sf_dir)
    levels = tree.level_vectors(grown)
    found, tails_path = scratch_path(spark, "matches"), scratch_path(spark, "tails")

    def consume(stream: DataFrame, checkpoint: str) -> None:
        writer = stream_frames.prev_match_stream(
            stream, lambda batch: tree.quantise(batch, levels, grown.depth), tails_path, found
        )
        stream_frames.run_available(writer, checkpoint)

    _arrivals(spark, _numbered_features(spark, sf_dir), "seq", consume)
    return spark.read.parquet(found).select("frame_id", "pos", "prev_frame_id", "prev_pos")


@query
def stream_retrieve(spark, sf_dir):
    grown, vocabulary = inputs.tree_vocabulary(spark, sf_dir)
    levels = tree.level_vectors(grown)
    weights = materialise(bow.word_weights(inputs.tree_words(spark, sf_dir)), "weights")
    found, index_path = scratch_path(spark, "found"), scratch_path(spark, "stream-index")

    def to_bags(batch: DataFrame) -> DataFrame:
        return bow.bag_of_words(tree.quantise(batch, levels, grown.depth), vocabulary, weights)

    def consume(stream: DataFrame, checkpoint: str) -> None:
        writer = stream_frames.retrieve_stream(stream, to_bags, index_path, found, EXCLUDE_RECENT)
        stream_frames.run_available(writer, checkpoint)

    _arrivals(spark, _numbered_features(spark, sf_dir), "seq", consume)
    return spark.read.parquet(found).select(
        "frame_id", "seq", "best_seq", _r("score").alias("score"),
        vectors.floor_cents(_r("score", 9)).alias("shown"),
    )


def _processed(spark, sf_dir) -> str:
    """Run the frame process over the features, arriving in three steps; the folder of its results."""
    grown, vocabulary = inputs.tree_vocabulary(spark, sf_dir)
    levels = tree.level_vectors(grown)
    table_bytes = 4 * levels.count() * vector_bytes(grown.shape.dimension)
    weights = bow.word_weights(inputs.tree_words(spark, sf_dir))
    dictionary = materialise(
        lookup_join(tree.word_ranges(vocabulary), weights, ["word_id"], "left").withColumn(
            "weight", F.coalesce("weight", F.lit(1.0))),
        "dictionary")
    rows = lookup_join(
        bow.present(inputs.features(spark, sf_dir)),
        inputs.frames(spark, sf_dir).select(F.col("stream_id").cast("long"), "frame_id", "time_us"), ["frame_id"])
    folder = scratch_path(spark, "process")

    def consume(stream: DataFrame, checkpoint: str) -> None:
        quantised = tree.quantise(stream, levels, grown.depth, table_bytes=table_bytes)
        words = lookup_join(quantised, dictionary, ["word_id"]).select(
            "stream_id", "time_us", "frame_id", F.col("pos").cast("long"), "word_index", "low", "high", "weight")
        writer = stream_process.process_stream(words, folder, inputs.GAP, inputs.MIN_POINTS, POOL)
        stream_frames.run_available(writer, checkpoint)

    with stream_frames.state_provider(spark):
        _arrivals(spark, rows, "time_us", consume)
    return folder


@query
def stream_process_frame(spark, sf_dir):
    folder = _processed(spark, sf_dir)
    keys = ["stream_id", "frame_id"]
    pair = F.struct("pos", "prev_pos")
    matches = spark.read.parquet(f"{folder}/matches").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_matches"),
        F.array_join(F.transform(F.sort_array(F.collect_list(pair)), lambda m: F.concat_ws(
            ":", m["pos"].cast("string"), m["prev_pos"].cast("string"))), ",").alias("matches"))
    closed = spark.read.parquet(f"{folder}/closures").select(
        "stream_id", F.col("query_id").alias("frame_id"), F.col("frame_id").alias("best_frame"), "island_id",
        "island_score", "score", "total", "uncovered", "closed")
    frames_ = spark.read.parquet(f"{folder}/frames")
    return shuffled(shuffled(frames_).join(matches, keys, "left")).join(closed, keys, "left").select(
        "frame_id", "seq", F.col("is_key").cast("int").alias("is_key"), _r("expected").alias("expected"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "matches", "best_frame", "island_id",
        _r("island_score").alias("island_score"), _r("score").alias("score"), "total", "uncovered",
        F.col("closed").cast("int").alias("closed"))


@query
def stream_index(spark, sf_dir):
    index = postings.open_index(spark, f"{_processed(spark, sf_dir)}/postings").read()
    rows = postings.merge_blocks(index)
    return rows.select(
        "word_index", "block", F.col("frames").alias("n_frames"),
        _joined(F.col("entries.frame_id")).alias("frame_ids"),
        _r("most").alias("most"),
        _r(F.aggregate("entries", F.lit(0.0), lambda a, e: a + e["weight"])).alias("total"))
