"""Assignment, seeding and medoid update for node tables beyond the broadcast bound, in numpy.

Each node's medoids go to the node's rows instead of to every task: rows and medoids are cogrouped by node and
salt. A node has one salt per ``GROUP_ROWS`` of its rows, so that no group grows with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrove.functions.metrics import Kernel, Metric
from glyphgrove.operators.assignment import KERNELS, _distances, _kernel, _vectors
from glyphgrove.operators.dense_update import value_costs
from glyphgrove.operators.medoid_cost import Shape
from glyphgrove.runtime import BROADCAST_BYTES, lookup_join

#: Rows of one node that meet its medoids in one group.
GROUP_ROWS = 1 << 16

GROUP = ["node_id", "_salt"]


def has_kernel(metric: Metric) -> bool:
    """Whether distances under the metric can be taken in numpy."""
    return metric.kernel is not None or (metric.name in KERNELS and metric.additive is not None)


def fits_grouped(metric: Metric, k: int, shape: Shape) -> bool:
    """Whether the value table of a single node is within the broadcast bound."""
    if metric.kernel is not None or not has_kernel(metric) or not shape.values:
        return False
    return k * shape.dimension * shape.values * 8 <= BROADCAST_BYTES


def salted(points: DataFrame, packs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the salt they go to, and node rows repeated for each salt of their node."""
    salts = points.groupBy("node_id").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("_salts"))
    rows = lookup_join(points, salts, ["node_id"], hot=True).withColumn(
        "_salt", F.pmod(F.xxhash64("id"), F.col("_salts")).cast("int")).drop("_salts")
    nodes = packs.join(salts, "node_id").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    # both sides come from the same tables: new columns tell them apart in the cogroup
    return rows, nodes.select(*[F.col(c).alias(c) for c in nodes.columns])


def _medoids(nodes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, ids and vectors of the medoids in a group's one node row."""
    listed = nodes.column("medoids")[0].as_py()
    return (np.array([m["pos"] for m in listed], np.int32), np.array([m["id"] for m in listed], np.int64),
            np.array([m["vector"] for m in listed]))


def _placed(rows: pa.Table, nodes: pa.Table, kernel: str | Kernel, keep: bool) -> tuple[np.ndarray, ...]:
    """Row numbers that belong to a cluster, the index of their medoid, its distance; and the vectors of all rows."""
    vectors, ids = _vectors(rows.column("vector").combine_chunks()), rows.column("id").to_numpy()
    _, medoid_ids, medoids = _medoids(nodes)
    all_ = _distances(kernel, vectors, medoids)
    best = all_.argmin(axis=1)
    own = ids[:, None] == medoid_ids
    part = np.arange(len(ids))
    if keep:
        best = np.where(own.any(axis=1), own.argmax(axis=1), best)
    else:
        part = part[~own.any(axis=1)]
    return part, best[part], all_[part, best[part]], vectors


def assign_grouped(points: DataFrame, packs: DataFrame, metric: Metric, keep_medoids: bool = False) -> DataFrame:
    """``assign`` for node tables of any size."""
    kernel = _kernel(metric)
    element = points.schema["vector"].dataType.elementType.simpleString()
    kind = "bigint" if kernel == "hamming" else "double"

    def work(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        if not rows.num_rows or not nodes.num_rows:
            return empty
        part, best, dist, _ = _placed(rows, nodes, kernel, keep_medoids)
        found = rows.select(["node_id", "id", "vector"]).take(pa.array(part))
        positions = _medoids(nodes)[0][best]
        return found.append_column("pos", pa.array(positions, pa.int32())).append_column(
            "dist", pa.array(dist, empty.schema.field("dist").type))

    schema = f"node_id string, id bigint, vector array<{element}>, pos int, dist {kind}"
    empty = points.sparkSession.createDataFrame([], schema).toArrow()
    rows, nodes = salted(points.select("node_id", "id", "vector"), packs.select("node_id", "medoids"))
    return rows.groupBy(*GROUP).cogroup(nodes.groupBy(*GROUP)).applyInArrow(work, schema)


def farthest_grouped(points: DataFrame, packs: DataFrame, metric: Metric) -> DataFrame:
    """One candidate ``(node_id, near, id, vector)`` per group: its row farthest from the node's seeds, lowest id on ties."""
    kernel = _kernel(metric)
    element = points.schema["vector"].dataType.elementType.simpleString()

    def work(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        if not rows.num_rows or not nodes.num_rows:
            return empty
        ids = rows.column("id").to_numpy()
        near = _distances(kernel, _vectors(rows.column("vector").combine_chunks()), _medoids(nodes)[2]).min(axis=1)
        top = np.lexsort((ids, -near))[:1]
        found = rows.select(["node_id", "id", "vector"]).take(pa.array(top))
        return found.add_column(1, "near", pa.array(near[top].astype(float)))

    schema = f"node_id string, near double, id bigint, vector array<{element}>"
    empty = points.sparkSession.createDataFrame([], schema).toArrow()
    rows, nodes = salted(points.select("node_id", "id", "vector"), packs.select("node_id", "medoids"))
    return rows.groupBy(*GROUP).cogroup(nodes.groupBy(*GROUP)).applyInArrow(work, schema)


def update_grouped(
    points: DataFrame, packs: DataFrame, metric: Metric, shape: Shape, keep_medoids: bool, all_pairs: bool,
) -> DataFrame:
    """``(node_id, medoids, cost)`` after one update, as ``dense_update`` finds it; rows never become elements.

    Counts of (cluster, coordinate, value) are merged in each group before they are shuffled; a node's table of
    prices goes to its groups only.
    """
    kernel, kind = _kernel(metric), metric.additive
    low, dimension, values = int(shape.low), shape.dimension, shape.values
    element = points.schema["vector"].dataType.elementType.simpleString()
    column = np.arange(dimension)

    def cells_of(vectors: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return (cluster[:, None] * dimension + column) * values + (vectors.astype(np.int64) - low)

    def count(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        if not rows.num_rows or not nodes.num_rows:
            return no_counts
        part, best, _, vectors = _placed(rows, nodes, kernel, keep_medoids)
        n = np.bincount(cells_of(vectors[part], best).ravel()) if len(part) else np.zeros(0, np.int64)
        met = np.flatnonzero(n)
        name = rows.column("node_id")[0].as_py()
        return pa.table({"node_id": pa.array([name] * len(met), pa.string()), "cell": pa.array(met, pa.int64()),
                         "n": pa.array(n[met], pa.int64())})

    def price(table: pa.Table) -> pa.Table:
        clusters = int(table.column("k")[0].as_py())
        counts = np.zeros(clusters * dimension * values, np.int64)
        counts[table.column("cell").to_numpy()] = table.column("n").to_numpy()
        costs = value_costs(kind, counts.reshape(clusters, dimension, values), low)
        return pa.table({"node_id": pa.array([table.column("node_id")[0].as_py()]), "prices": pa.array([costs.tobytes()], pa.binary())})

    def choose(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        if not rows.num_rows or not nodes.num_rows:
            return no_choice
        part, best, _, vectors = _placed(rows, nodes, kernel, keep_medoids)
        if not len(part):
            return no_choice
        prices = np.frombuffer(nodes.column("prices")[0].as_py(), np.float64)
        costs = prices[cells_of(vectors[part], best)].sum(axis=1)
        ids = rows.column("id").to_numpy()[part]
        order = np.lexsort((ids, costs, best))
        heads = order[np.r_[True, np.diff(best[order]) > 0]]
        sums = np.bincount(best, weights=costs)
        found = rows.select(["node_id", "id", "vector"]).take(pa.array(part[heads]))
        return found.append_column("at", pa.array(best[heads], pa.int32())).append_column(
            "cost", pa.array(costs[heads])).append_column("all_pairs", pa.array(sums[best[heads]]))

    spark = points.sparkSession
    counts_schema, price_schema = "node_id string, cell bigint, n bigint", "node_id string, prices binary"
    choice_schema = f"node_id string, id bigint, vector array<{element}>, at int, cost double, all_pairs double"
    no_counts = spark.createDataFrame([], counts_schema).toArrow()
    no_choice = spark.createDataFrame([], choice_schema).toArrow()

    slim, nodes = points.select("node_id", "id", "vector"), packs.select("node_id", "medoids")
    rows, repeated = salted(slim, nodes)
    counted = rows.groupBy(*GROUP).cogroup(repeated.groupBy(*GROUP)).applyInArrow(count, counts_schema)
    total = counted.groupBy("node_id", "cell").agg(F.sum("n").alias("n"))
    # a node's table is within the bound of fits_grouped, and so is the group that makes it
    sized = total.join(nodes.select("node_id", F.size("medoids").alias("k")), "node_id")
    prices = sized.groupBy("node_id").applyInArrow(price, price_schema)
    rows, repeated = salted(slim, nodes.join(prices, "node_id"))
    chosen = rows.groupBy(*GROUP).cogroup(repeated.groupBy(*GROUP)).applyInArrow(choose, choice_schema)
    best = chosen.groupBy("node_id", "at").agg(
        F.min(F.struct("cost", "id", "vector")).alias("b"), F.sum("all_pairs").alias("all_pairs"))
    won = best.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct(
        F.col("b.id").alias("id"), F.col("b.vector").alias("vector"))))).alias("_won"),
        F.sum("all_pairs" if all_pairs else F.col("b.cost")).alias("cost"))
    moved = F.transform("medoids", lambda m, i: F.struct(
        m["pos"].alias("pos"),
        F.coalesce(F.try_element_at("_won", i)["id"], m["id"]).alias("id"),
        F.coalesce(F.try_element_at("_won", i)["vector"], m["vector"]).alias("vector")))
    return nodes.join(won, "node_id", "left").select(
        "node_id", F.when(F.col("_won").isNull(), F.col("medoids")).otherwise(moved).alias("medoids"),
        F.coalesce("cost", F.lit(0.0)).alias("cost"))
