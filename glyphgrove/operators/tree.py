"""Vocabulary tree: level-synchronous growth, words, and descent.

Every level is one k-medoids run over all nodes that are still open. Medoids are members of no
cluster, so they appear in no child and each level works on fewer rows than the one above.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphgrove.functions.metrics import Metric, resolve
from glyphgrove.functions.paths import ROOT, ancestor, child, prefixes, steps
from glyphgrove.operators.assignment import ARROW_ELEMENTS, descend_arrow, fits_arrow
from glyphgrove.operators.kmedoids import as_node, farthest_first, fit_nodes
from glyphgrove.operators.medoid_cost import Shape, measure
from glyphgrove.operators.ordered import dense_ids
from glyphgrove.operators.subtree import grow_nodes, local_rows
from glyphgrove.runtime import lookup_join, materialise, pin, release, shuffled, vector_bytes

#: Lookup joins of a descent in one plan.
PLAN_LEVELS = 4


@dataclass
class Tree:
    """``nodes``: one row per medoid of every level. ``members``: the rows kept under small leaves.

    nodes   ``(node_id, parent_id, pos, depth, id, vector, size, is_leaf)``
    members ``(node_id, pos, id, vector)``, ``pos`` counted by id within the leaf
    """

    nodes: DataFrame
    members: DataFrame
    k: int
    depth: int
    shape: Shape | None = None


def build_tree(
    df: DataFrame,
    k: int = 4,
    metric: str | Metric = "hamming",
    max_depth: int | None = None,
    local_bytes: int | None = None,
    **options,
) -> Tree:
    """Split ``(id, vector)`` into k clusters, and every cluster of more than k members again.

    A cluster left too large at ``max_depth`` becomes one word, as an empty one does. ``options``
    are those of ``fit_nodes``. The root and nodes of more than ``local_bytes`` of vectors are split by jobs, all
    nodes of a level in the same ones; smaller nodes go to tasks as they are and are split to their leaves there.
    """
    metric = resolve(metric)
    points = as_node(df)
    shape = measure(points)
    if not 0 < k <= shape.rows:
        raise ValueError(f"k={k} needs between 1 and {shape.rows} rows")
    nodes: list[DataFrame] = []
    members: list[DataFrame] = []
    handed: list[DataFrame] = []
    small_rows = local_rows(metric, shape, local_bytes)
    depth, open_nodes = 0, 1
    while open_nodes:
        depth += 1
        seeds = farthest_first(points, k, metric, nodes=open_nodes, shape=shape)
        grown = fit_nodes(points, seeds, metric, k, open_nodes, shape, **options)
        placed = materialise(
            grown.assignment().select(
                child(F.col("node_id"), F.col("pos")).alias("node_id"), "id", "vector"
            ),
            "level",
        )
        bound = open_nodes * k
        sizes = placed.groupBy("node_id").agg(F.count(F.lit(1)).alias("size"))
        medoids = grown.medoids().select(
            child(F.col("node_id"), F.col("pos")).alias("node_id"),
            F.col("node_id").alias("parent_id"), "pos", F.lit(depth).alias("depth"), "id", "vector",
        )
        capped = depth == max_depth
        level = lookup_join(medoids, sizes, ["node_id"], "left", table_bytes=bound * 64).select(
            *medoids.columns,
            F.coalesce("size", F.lit(0)).alias("size"),
            (F.coalesce("size", F.lit(0)) <= k if not capped else F.lit(True)).alias("is_leaf"),
        )
        level = pin(level, bound, 128 + vector_bytes(shape.dimension), "nodes")
        nodes.append(level)
        small = level.filter(F.col("is_leaf") & (F.col("size") <= k)).select("node_id")
        kept = lookup_join(placed, small, ["node_id"], "left_semi", table_bytes=bound * 64, hot=True)
        # a leaf holds at most k rows, so this window is small by construction
        order = W.partitionBy("node_id").orderBy("id")
        members.append(
            kept.select("node_id", (F.row_number().over(order) - 1).alias("pos"), "id", "vector")
        )
        wide = level.filter(~F.col("is_leaf")).select("node_id", "size")
        within = wide.filter(F.col("size") <= small_rows).select("node_id")
        if not within.isEmpty():
            handed.append(lookup_join(placed, within, ["node_id"], "left_semi", table_bytes=bound * 64))
        wide = wide.filter(F.col("size") > small_rows).select("node_id")
        open_nodes = wide.count()
        points = lookup_join(placed, wide, ["node_id"], "left_semi", table_bytes=bound * 64, hot=True)
    if handed:
        grown_there = materialise(grow_nodes(_stack(handed), k, metric, shape, max_depth, **options), "subtrees")
        nodes.append(grown_there.filter("kind = 'node'").select(*nodes[0].columns))
        members.append(grown_there.filter("kind = 'member'").select("node_id", "pos", "id", "vector"))
        depth = grown_there.agg(F.max("depth")).first()[0]
    return Tree(_stack(nodes), _stack(members), k, depth, shape)


def _stack(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def flat_tree(medoids: DataFrame, k: int) -> Tree:
    """A one-level tree: the k medoids are the words."""
    nodes = medoids.select(
        F.col("pos").cast("string").alias("node_id"), F.lit(ROOT).alias("parent_id"), "pos",
        F.lit(1).alias("depth"), "id", "vector", F.lit(None).cast("bigint").alias("size"),
        F.lit(True).alias("is_leaf"),
    )
    members = nodes.select("node_id", "pos", "id", "vector").limit(0)
    return Tree(nodes, members, k, 1)


def level_vectors(tree: Tree) -> DataFrame:
    """``(node_id, pos, vector)``: what a descent compares at each node; empty nodes have no rows."""
    inner = tree.nodes.select(F.col("parent_id").alias("node_id"), "pos", "vector")
    return inner.unionByName(tree.members.select("node_id", "pos", "vector"))


def children(tree: Tree) -> DataFrame:
    """``(parent_id, children)`` with at most k children in position order."""
    return (
        tree.nodes.groupBy("parent_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "node_id"))).alias("_c"))
        .select("parent_id", F.transform("_c", lambda c: c["node_id"]).alias("children"))
    )


def words(tree: Tree, **options) -> DataFrame:
    """``(word_id, leaf_id, word_index)``, numbered in depth-first order.

    Each member of a leaf is a word; a leaf without members is one word itself.
    """
    of_members = tree.members.select(
        F.concat_ws("-", "node_id", F.col("pos").cast("string")).alias("word_id"),
        F.col("node_id").alias("leaf_id"),
    )
    bare = shuffled(tree.nodes.filter("is_leaf")).join(
        tree.members.select("node_id").distinct(), "node_id", "left_anti"
    )
    of_leaves = bare.select(F.col("node_id").alias("word_id"), F.col("node_id").alias("leaf_id"))
    listed = of_members.unionByName(of_leaves).withColumn("path", steps(F.col("word_id")))
    return dense_ids(listed, ["path"], "word_index", **options).select(
        "word_id", "leaf_id", "word_index"
    )


def inverse_index(words_: DataFrame) -> DataFrame:
    """``(word_index, word_id)``; raises when two words share an index."""
    clash = words_.groupBy("word_index").count().filter("count > 1").limit(1).count()
    if clash:
        raise ValueError("word_index is not unique")
    return words_.select("word_index", "word_id")


def quantise(
    features: DataFrame,
    levels: DataFrame,
    depth: int,
    metric: str | Metric = "hamming",
    table_bytes: int | None = None,
) -> DataFrame:
    """Add ``word_id`` by greedy descent: the nearest entry at each node, lowest ``pos`` on ties.

    ``table_bytes`` is a proven bound of ``levels``. Within the broadcast bound the descent is one
    function over Arrow batches; otherwise there is one lookup join per level with the nodes of that depth. Rows that
    are no stream are written after every ``PLAN_LEVELS`` of them.
    Rows whose node has no entries keep it as their word.
    """
    metric = resolve(metric)
    if table_bytes is not None and fits_arrow(metric, table_bytes, ARROW_ELEMENTS):
        return descend_arrow(features, levels, metric, ROOT)
    packs = levels.groupBy(F.col("node_id").alias("word_id")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "vector"))).alias("_entries")
    )
    best = F.array_min(
        F.transform(
            "_entries",
            lambda e: F.struct(
                metric.point(F.col("vector"), e["vector"]).alias("dist"), e["pos"].alias("pos")
            ),
        )
    )
    step = F.when(F.col("_entries").isNull(), F.col("word_id")).otherwise(
        child(F.col("word_id"), best["pos"])
    )
    rows = features.withColumn("word_id", F.lit(ROOT))
    kept = [F.col(c) for c in features.columns]
    # written once: each level reads the nodes of its own depth only
    packs = materialise(packs.withColumn("_depth", F.size(F.split("word_id", "-"))), "packs")
    below = packs.filter(F.col("word_id") != ROOT)
    # nodes by depth, a number per level: few nodes are repeated more often, so that no level has fewer keys than tasks
    nodes = dict(below.groupBy("_depth").count().collect())
    tasks = 2 * int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = None
    for level in range(depth + 1):
        if level == 0:
            # all rows ask for the root's one pack of entries: one row, so it goes to them
            own = packs.filter(F.col("word_id") == ROOT).drop("_depth")
            met = rows.join(F.broadcast(own), ["word_id"], "left")
        elif level not in nodes:
            # no row has a node to go on from
            break
        else:
            salts = max(2, -(-tasks // nodes[level]))
            own = below.filter(F.col("_depth") == level).drop("_depth")
            met = lookup_join(rows, own, ["word_id"], "left", table_bytes=table_bytes, hot=True, salts=salts)
        rows = met.select(*kept, step.alias("word_id"))
        if level and level % PLAN_LEVELS == 0 and not features.isStreaming:
            # the driver plans and tracks only so many joins at once, however deep the tree
            earlier, written = written, materialise(rows, "descent")
            rows = written
            if earlier is not None:
                release(earlier)
    return rows


def words_below(words_: DataFrame) -> DataFrame:
    """``(ancestor_id, word_id)``: every word under every node above it."""
    return words_.select(F.explode(prefixes(F.col("word_id"))).alias("ancestor_id"), "word_id")


def neighbourhood(words_: DataFrame, distance: int = 1) -> DataFrame:
    """``(word_id, neighbour_id)``: words sharing the ancestor ``distance`` levels up, itself too.

    At distance 1 the ancestor is the leaf, which holds at most k words. Larger distances grow with
    k^distance; callers that only need membership should join on ``ancestor_key`` instead.
    """
    keyed = words_.select("word_id", ancestor(F.col("word_id"), distance).alias("ancestor_id"))
    below = words_below(words_).withColumnRenamed("word_id", "neighbour_id")
    return shuffled(keyed).join(below, "ancestor_id").select("word_id", "neighbour_id")


def word_ranges(words_: DataFrame, distance: int = 1) -> DataFrame:
    """``(word_id, word_index, low, high)``: words are numbered depth first, so those near a word are a range.

    The words that share the ancestor ``distance`` levels up are numbered from ``low`` to ``high`` - 1.
    """
    listed = words_.select("word_id", "word_index", ancestor(F.col("word_id"), distance).alias("ancestor_id"))
    below = words_.select(F.explode(prefixes(F.col("word_id"))).alias("ancestor_id"), "word_index")
    spans = below.groupBy("ancestor_id").agg(
        F.min("word_index").alias("low"), (F.max("word_index") + 1).alias("high"))
    return shuffled(listed).join(spans, "ancestor_id").select("word_id", "word_index", "low", "high")
