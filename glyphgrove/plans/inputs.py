"""Descriptor sets, frames and vocabularies derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrove.functions import vectors
from glyphgrove.operators.bow import bag_of_words, present, word_weights
from glyphgrove.operators.frames import with_counter, with_previous
from glyphgrove.operators.kmedoids import as_node, farthest_first
from glyphgrove.operators.medoid_cost import Shape, measure
from glyphgrove.operators.population import distinct_vectors
from glyphgrove.operators.tree import Tree, build_tree, level_vectors, quantise, words
from glyphgrove.runtime import materialise, vector_bytes

#: Features per frame: frame number = vec_id div FRAME.
FRAME = 10

#: Clusters of the k-medoids queries, and children per node of the vocabulary tree.
K = 8
TREE_K = 8

#: Key-frame rule for frames of FRAME features.
GAP = 1
MIN_POINTS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _descriptors(spark: SparkSession, sf_dir: str, convert) -> DataFrame:
    raw = table(spark, sf_dir, "embeddings")
    return raw.select(F.col("vec_id").alias("id"), convert(F.col("embedding")).alias("vector"))


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _descriptors(spark, sf_dir, vectors.sign_bits)


def bytes_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _descriptors(spark, sf_dir, vectors.to_bytes)


def feature_columns(id_: Column) -> tuple[Column, Column]:
    frame = F.floor(id_ / FRAME).cast("bigint").alias("frame_id")
    return frame, F.pmod(id_, F.lit(FRAME)).cast("int").alias("pos")


def features(spark: SparkSession, sf_dir: str, convert=vectors.sign_bits) -> DataFrame:
    """``(frame_id, pos, x, y, vector)``."""
    raw = table(spark, sf_dir, "embeddings")
    last = F.size("embedding")
    return raw.select(
        *feature_columns(F.col("vec_id")),
        (F.element_at("embedding", last - 1).cast("double") * 500).alias("x"),
        (F.element_at("embedding", last).cast("double") * 500).alias("y"),
        convert(F.col("embedding")).alias("vector"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(stream_id, frame_id, time_us, n_points, seq)``, one frame per second."""
    ids = table(spark, sf_dir, "embeddings").select(*feature_columns(F.col("vec_id")))
    counted = ids.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n_points"))
    listed = counted.select(
        F.lit(0).alias("stream_id"), "frame_id", (F.col("frame_id") * 1_000_000).alias("time_us"),
        "n_points",
    )
    return with_counter(listed, ["stream_id"], ["frame_id"])


def frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(frame_id, prev_frame_id)`` of all frames but the first."""
    ids = table(spark, sf_dir, "embeddings").select(*feature_columns(F.col("vec_id")))
    listed = ids.select("frame_id").distinct().withColumn("stream_id", F.lit(0))
    lagged = with_previous(listed, ["stream_id"], ["frame_id"], {"frame_id": "prev_frame_id"})
    return lagged.filter(F.col("prev_frame_id").isNotNull()).select("frame_id", "prev_frame_id")


def frame_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(stream_id, event_id, ts, n_points, seq)`` from ``events``."""
    raw = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), "event_id", "ts", F.col("value").alias("n_points")
    )
    return with_counter(raw, ["stream_id"], ["ts", "event_id"])


def seeded(spark: SparkSession, sf_dir: str, convert=bits, metric="hamming", k: int = K):
    """``(points, seeds, shape)`` under one root node."""
    points = as_node(convert(spark, sf_dir))
    shape = measure(points)
    return points, farthest_first(points, k, metric, shape=shape), shape


_trained: dict[tuple, object] = {}


def forget() -> None:
    """Drop all training results, so that the next query trains again."""
    _trained.clear()


def _stamp(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """When the descriptors were last written, and their size: a table that has changed is trained on anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/embeddings.parquet")
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.getFileStatus(path).getModificationTime(), system.getContentSummary(path).getLength()


def _once(spark: SparkSession, sf_dir: str, label: str, build):
    """Training results are kept per session and state of the table: queries that use a model do not train it again."""
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir), label)
    if key not in _trained:
        _trained[key] = build()
    return _trained[key]


def tree_vocabulary(spark: SparkSession, sf_dir: str) -> tuple[Tree, DataFrame]:
    """Tree over the distinct descriptors, grown until no cluster has more than TREE_K members; its words."""

    def build():
        tree = build_tree(distinct_vectors(bits(spark, sf_dir)), TREE_K)
        return tree, materialise(words(tree), "words")

    return _once(spark, sf_dir, "tree", build)


def words_of_features(spark: SparkSession, sf_dir: str, tree: Tree) -> DataFrame:
    """``(frame_id, pos, x, y, word_id)``."""
    levels = level_vectors(tree)
    rows = quantise(
        present(features(spark, sf_dir)), levels, tree.depth,
        table_bytes=4 * levels.count() * vector_bytes(tree.shape.dimension),
    )
    return rows.drop("vector")


def tree_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all features, written once: bags, weights and matches read them several times."""

    def build():
        return materialise(words_of_features(spark, sf_dir, tree_vocabulary(spark, sf_dir)[0]), "quantised")

    return _once(spark, sf_dir, "quantised", build)


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(frame_id, word_index, weight)``, written once per session."""

    def build():
        _, vocabulary = tree_vocabulary(spark, sf_dir)
        quantised = tree_words(spark, sf_dir)
        return materialise(bag_of_words(quantised, vocabulary, word_weights(quantised)), "bow")

    return _once(spark, sf_dir, "bags", build)
