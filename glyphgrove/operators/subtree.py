"""Whole subtrees of a vocabulary tree inside tasks, for nodes whose rows fit a proven bound.

A tree has far more small nodes than large ones. Growing them level by level costs jobs for a handful of
rows each, so nodes within the bound are handed to tasks, many nodes a task, and split to their leaves
there. Seeds, assignment, update and the end of the iteration are those of the distributed form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glyphgrove.functions.metrics import Kernel, Metric
from glyphgrove.functions.paths import ROOT
from glyphgrove.operators.assignment import KERNELS, _distances, _vectors
from glyphgrove.operators.dense_update import value_costs
from glyphgrove.operators.medoid_cost import Shape

#: Bytes of vectors that one node may hold to be grown inside a task.
LOCAL_BYTES = 16 << 20

#: Largest table of counts (cluster, coordinate, value) of one node; beyond it pairs are summed in blocks.
TABLE_CELLS = 1 << 22
PAIR_ROWS = 512


def local_rows(metric: Metric, shape: Shape, local_bytes: int | None = None) -> int:
    """How many rows a node may hold to be grown inside a task, 0 if the metric has no numpy form."""
    if metric.kernel is None and (metric.name not in KERNELS or metric.additive is None):
        return 0
    return (LOCAL_BYTES if local_bytes is None else local_bytes) // (8 * max(1, shape.dimension))


def _seeds(rows: np.ndarray, k: int, kernel: str | Kernel) -> np.ndarray:
    """Row numbers of the k farthest-first seeds; rows are in order of their ids."""
    chosen = [0]
    near = _distances(kernel, rows, rows[:1])[:, 0]
    while len(chosen) < k:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(kernel, rows, rows[chosen[-1:]])[:, 0])
    return np.array(chosen)


def _place(rows: np.ndarray, medoids: np.ndarray, kernel: str | Kernel, keep: bool) -> np.ndarray:
    """The cluster of each row; medoids have none, or their own if ``keep``."""
    at = _distances(kernel, rows, rows[medoids]).argmin(axis=1)
    # a row that is medoid twice, as in tables with repeated ids, belongs to the first
    for pos, m in reversed(list(enumerate(medoids.tolist()))):
        at[m] = pos if keep else -1
    return at


def _candidate_costs(rows: np.ndarray, at: np.ndarray, k: int, metric: Metric, shape: Shape) -> np.ndarray:
    """The sum of distances of each placed row to all rows of its cluster."""
    costs = np.zeros(len(rows))
    placed = np.flatnonzero(at >= 0)
    if not len(placed):
        return costs
    cells = k * shape.dimension * (shape.values or 0)
    if metric.kernel is None and shape.values and cells <= TABLE_CELLS:
        low = int(shape.low)
        column = np.arange(shape.dimension)
        cell = (at[placed][:, None] * shape.dimension + column) * shape.values + (rows[placed].astype(np.int64) - low)
        counts = np.bincount(cell.ravel(), minlength=cells).reshape(k, shape.dimension, shape.values)
        costs[placed] = value_costs(metric.additive, counts, low).ravel()[cell].sum(axis=1)
        return costs
    kernel = metric.cost_kernel or metric.additive
    for pos in range(k):
        own = np.flatnonzero(at == pos)
        for a in range(0, len(own), PAIR_ROWS):
            costs[own[a : a + PAIR_ROWS]] = _distances(kernel, rows[own], rows[own[a : a + PAIR_ROWS]]).sum(axis=0)
    return costs


def fit_local(
    rows: np.ndarray, k: int, metric: Metric, shape: Shape, max_iter: int | None = None,
    candidates: str = "members", cost: str = "all_pairs", return_policy: str = "reference",
) -> np.ndarray:
    """Row numbers of the k medoids of one node, as ``fit_nodes`` finds them. Rows are in order of their ids."""
    kernel = metric.kernel or KERNELS[metric.name]
    keep = candidates == "members+medoid"
    current = earlier = _seeds(rows, k, kernel)
    last, turn = np.inf, 0
    while max_iter is None or turn < max_iter:
        turn += 1
        at = _place(rows, current, kernel, keep)
        costs = _candidate_costs(rows, at, k, metric, shape)
        moved, total = current.copy(), 0.0
        for pos in range(k):
            own = np.flatnonzero(at == pos)
            if len(own):
                moved[pos] = own[costs[own].argmin()]
                total += float(costs[own].sum() if cost == "all_pairs" else costs[own].min())
        if not total < last:
            return current if return_policy == "reference" else earlier
        current, earlier, last = moved, current, total
    return current


def _grow(
    node: str, rows: np.ndarray, k: int, metric: Metric, shape: Shape, max_depth: int | None, options: dict,
) -> Iterator[tuple]:
    """(kind, node_id, parent_id, pos, depth, row, size, is_leaf) of everything below ``node``."""
    kernel = metric.kernel or KERNELS[metric.name]
    waiting = [(node, np.arange(len(rows)))]
    while waiting:
        parent, part = waiting.pop()
        medoids = fit_local(rows[part], k, metric, shape, **options)
        at = _place(rows[part], medoids, kernel, False)
        depth = 1 if parent == ROOT else parent.count("-") + 2
        for pos, m in enumerate(medoids.tolist()):
            name = str(pos) if parent == ROOT else f"{parent}-{pos}"
            own = part[at == pos]
            wide = len(own) > k and depth != max_depth
            yield "node", name, parent, pos, depth, int(part[m]), len(own), not wide
            if wide:
                waiting.append((name, own))
            elif len(own) <= k:
                for i, row in enumerate(own.tolist()):
                    yield "member", name, parent, i, depth, row, 0, False


def grow_nodes(
    points: DataFrame, k: int, metric: Metric, shape: Shape, max_depth: int | None = None, **options
) -> DataFrame:
    """All nodes and kept members below each node of ``points (node_id, id, vector)``, told apart by ``kind``.

    Every node must be within ``local_rows``. Its rows make one group of a grouped map.
    """
    vector = points.schema["vector"].dataType
    # the column builders stay behind: one that has been used holds a handle of the driver
    metric = replace(metric, point=None, cost=None)
    schema = T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("node_id", T.StringType()),
        T.StructField("parent_id", T.StringType()), T.StructField("pos", T.IntegerType()),
        T.StructField("depth", T.IntegerType()), T.StructField("id", T.LongType()),
        T.StructField("vector", vector), T.StructField("size", T.LongType()),
        T.StructField("is_leaf", T.BooleanType()),
    ])

    def work(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        vectors = table.column("vector").chunk(0)
        ids = table.column("id").to_numpy()
        found = list(_grow(key[0].as_py(), _vectors(vectors), k, metric, shape, max_depth, options))
        kind, node, parent, pos, depth, row, size, leaf = zip(*found, strict=True)
        at = np.array(row, np.int64)
        return pa.table([
            pa.array(kind), pa.array(node), pa.array(parent), pa.array(pos, pa.int32()), pa.array(depth, pa.int32()),
            pa.array(ids[at]), vectors.take(pa.array(at)), pa.array(size, pa.int64()), pa.array(leaf),
        ], names=schema.fieldNames())

    return points.select("node_id", "id", "vector").groupBy("node_id").applyInArrow(work, schema)
