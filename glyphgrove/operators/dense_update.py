"""Medoid update for integer vectors of a small value range, two passes and no row shuffle.

The counts of (cluster, coordinate, value) fit an array then. Pass one adds them up inside each task
and Spark sums the arrays' entries; from the totals follows the cost of every value (the formulas of
``medoid_cost``). Pass two prices each row by table lookups and keeps one candidate per task and
cluster. Rows are placed again in each pass, which is cheaper than keeping their assignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrove.functions.metrics import Metric
from glyphgrove.operators.assignment import KERNELS, _distances, _node_slices, _vectors
from glyphgrove.operators.medoid_cost import Shape
from glyphgrove.runtime import BROADCAST_BYTES


def fits_dense(metric: Metric, clusters: int, shape: Shape) -> bool:
    """Whether the value table of all clusters is within the broadcast bound."""
    if metric.name not in KERNELS or metric.additive is None or not shape.values:
        return False
    return clusters * shape.dimension * shape.values * 8 <= BROADCAST_BYTES


def value_costs(kind: str, counts: np.ndarray, low: int) -> np.ndarray:
    """Cost of each value per (cluster, coordinate) from ``counts[cluster, coordinate, value]``."""
    counts = counts.astype(np.float64)
    size = counts.sum(axis=2, keepdims=True)
    if kind == "hamming":
        return size - counts
    values = np.arange(low, low + counts.shape[2], dtype=np.float64)
    first = (counts * values).sum(axis=2, keepdims=True)
    if kind == "l2sq":
        second = (counts * values * values).sum(axis=2, keepdims=True)
        return second - 2 * values * first + size * values * values
    rank, partial = counts.cumsum(axis=2), (counts * values).cumsum(axis=2)
    return values * (2 * rank - size) - 2 * partial + first


def dense_best(
    points: DataFrame, nodes: list, metric: Metric, shape: Shape, keep_medoids: bool
) -> dict[int, tuple]:
    """``{cluster: (cost, id, vector, all_pairs)}``; clusters are numbered through ``nodes``.

    ``nodes`` are the rows ``(node_id, medoids)`` of the node table, already on the driver.
    """
    context = points.sparkSession.sparkContext
    kernel, kind = KERNELS[metric.name], metric.additive
    low, dimension, values = int(shape.low), shape.dimension, shape.values
    shipped, clusters = {}, 0
    for row in nodes:
        ids = np.array([m.id for m in row.medoids], np.int64)
        shipped[row.node_id] = (clusters, ids, np.array([m.vector for m in row.medoids]))
        clusters += len(ids)
    table = context.broadcast(shipped)

    def placed(batch: pa.RecordBatch):
        """Rows of a batch that belong to a cluster: ``(row number, cluster, first table cell)``."""
        rows, ids = _vectors(batch.column("vector")), batch.column("id").to_numpy()
        at, found = [], []
        for node, part in _node_slices(batch.column("node_id")):
            if node not in table.value:
                continue
            first, medoid_ids, medoids = table.value[node]
            own = ids[part][:, None] == medoid_ids
            best = _distances(kernel, rows[part], medoids).argmin(axis=1)
            if keep_medoids:
                best = np.where(own.any(axis=1), own.argmax(axis=1), best)
            else:
                outside = ~own.any(axis=1)
                part, best = part[outside], best[outside]
            at.append(part)
            found.append(first + best)
        if not at:
            return None
        at, found = np.concatenate(at), np.concatenate(found)
        column = np.arange(dimension)
        cells = (found[:, None] * dimension + column) * values + (rows[at].astype(np.int64) - low)
        return at, found, cells

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(clusters * dimension * values, np.int64)
        for batch in batches:
            got = placed(batch) if batch.num_rows else None
            if got is not None:
                counts += np.bincount(got[2].ravel(), minlength=len(counts))
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells), pa.array(counts[cells])], names=["cell", "n"]
        )

    slim = points.select("node_id", "id", "vector")
    totals = slim.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    totals = totals.toArrow()
    counts = np.zeros(clusters * dimension * values, np.int64)
    counts[totals.column("cell").to_numpy()] = totals.column("n").to_numpy()
    prices = context.broadcast(
        value_costs(kind, counts.reshape(clusters, dimension, values), low).ravel()
    )

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        sums = np.zeros(clusters)
        for batch in batches:
            got = placed(batch) if batch.num_rows else None
            if got is None or not len(got[0]):
                continue
            at, found, cells = got
            costs = prices.value[cells].sum(axis=1)
            sums += np.bincount(found, weights=costs, minlength=clusters)
            ids = batch.column("id").to_numpy()[at]
            order = np.lexsort((ids, costs, found))
            leaders = order[np.r_[True, np.diff(found[order]) > 0]]
            for i in leaders.tolist():
                candidate = (float(costs[i]), int(ids[i]))
                cluster = int(found[i])
                if cluster not in best or candidate < best[cluster][:2]:
                    best[cluster] = (*candidate, batch.column("vector")[int(at[i])].as_py())
        rows = [
            {"cluster": c, "cost": b[0], "id": b[1], "vector": b[2], "all_pairs": float(sums[c])}
            for c, b in best.items()
        ]
        yield pa.RecordBatch.from_pylist(rows, schema=priced_schema)

    element = points.schema["vector"].dataType.elementType.simpleString()
    widths = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
    priced_schema = pa.schema([
        ("cluster", pa.int32()), ("cost", pa.float64()), ("id", pa.int64()),
        ("vector", pa.list_(widths[element])), ("all_pairs", pa.float64()),
    ])
    priced = slim.mapInArrow(
        price, f"cluster int, cost double, id bigint, vector array<{element}>, all_pairs double"
    )
    found = priced.groupBy("cluster").agg(
        F.min(F.struct("cost", "id", "vector")).alias("b"), F.sum("all_pairs").alias("all_pairs")
    )
    return {
        r.cluster: (r.b.cost, r.b.id, r.b.vector, r.all_pairs)
        for r in found.collect()  # one row per cluster
    }


def dense_update(
    points: DataFrame, packs: DataFrame, metric: Metric, shape: Shape, keep_medoids: bool,
    all_pairs: bool,
) -> DataFrame:
    """``(node_id, medoids, cost)`` after one update; an empty cluster keeps its medoid."""
    nodes = packs.select("node_id", "medoids").collect()
    best = dense_best(points, nodes, metric, shape, keep_medoids)
    moved, cluster = [], 0
    for row in nodes:
        medoids, cost = [], 0.0
        for medoid in row.medoids:
            won = best.get(cluster)
            cluster += 1
            if won is None:
                medoids.append(tuple(medoid))
                continue
            medoids.append((medoid.pos, won[1], won[2]))
            cost += won[3] if all_pairs else won[0]
        moved.append((row.node_id, medoids, cost))
    schema = packs.select("node_id", "medoids", F.lit(0.0).alias("cost")).schema
    return packs.sparkSession.createDataFrame(moved, schema)
