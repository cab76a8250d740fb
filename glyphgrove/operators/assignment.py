"""Nearest-medoid assignment of rows grouped in nodes.

Rows are ``(node_id, id, vector)``. Medoids travel as one packed row per node,
``(node_id, medoids ARRAY<STRUCT<pos, id, vector>>)``: k entries, so the join keeps one row per
input row and the arg-min is a row-level expression that needs no shuffle.

Array lambdas are interpreted, about 0.2 us per element. Where the packed medoids of all nodes fit
a broadcast, the same arg-min runs as numpy over Arrow batches, some ten times cheaper; the lambdas
serve node tables of any size, and metrics given as column builders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgrove.functions.metrics import Kernel, Metric, resolve
from glyphgrove.runtime import BROADCAST_BYTES, lookup_join

#: From this many array elements compared per row on, the Arrow form is used.
ARROW_ELEMENTS = 128

#: Up to this many elements compared, one numpy call over the whole cube is cheaper than a loop.
SMALL_CUBE = 1 << 18

#: Metrics the Arrow form knows, with the distance that places rows.
KERNELS = {"hamming": "hamming", "l1": "l1", "l2sq": "l2sq", "euclidean": "l2sq"}


def assign(
    points: DataFrame,
    packs: DataFrame,
    metric: str | Metric = "hamming",
    table_bytes: int | None = None,
    keep_medoids: bool = False,
) -> DataFrame:
    """``(node_id, id, vector, pos, dist)``: each row with its nearest medoid, lowest ``pos`` on ties.

    Medoids are not members of their own cluster unless ``keep_medoids``.
    """
    metric = resolve(metric)
    joined = lookup_join(points, packs, ["node_id"], table_bytes=table_bytes, hot=True)
    own = F.filter("medoids", lambda m: m["id"] == F.col("id"))
    if keep_medoids:
        candidates = F.when(F.size(own) > 0, own).otherwise(F.col("medoids"))
    else:
        joined = joined.filter(~F.exists("medoids", lambda m: m["id"] == F.col("id")))
        candidates = F.col("medoids")
    best = F.array_min(
        F.transform(
            candidates,
            lambda m: F.struct(
                metric.point(F.col("vector"), m["vector"]).alias("dist"), m["pos"].alias("pos")
            ),
        )
    )
    return joined.select("node_id", "id", "vector", best.alias("_best")).select(
        "node_id", "id", "vector", F.col("_best.pos").alias("pos"), F.col("_best.dist").alias("dist")
    )


def _kernel(metric: str | Metric) -> str | Kernel:
    metric = resolve(metric)
    return metric.kernel or KERNELS[metric.name]


def fits_arrow(metric: Metric, table_bytes: int, elements: int) -> bool:
    """Whether the broadcast Arrow form applies: known kernel, bounded table, enough work per row.

    A metric given in numpy always takes an Arrow form; beyond the bound that is the grouped one.
    """
    if metric.kernel is not None:
        return table_bytes <= BROADCAST_BYTES
    known = metric.name in KERNELS and metric.additive is not None
    return known and table_bytes <= BROADCAST_BYTES and elements >= ARROW_ELEMENTS


def _distances(kernel: str | Kernel, rows: np.ndarray, medoids: np.ndarray) -> np.ndarray:
    """Distances rows x medoids, each added up in the order of the coordinates."""
    if callable(kernel):
        return np.stack([kernel(rows, m) for m in medoids], axis=1).astype(np.float64)
    if len(rows) * medoids.size <= SMALL_CUBE:
        if kernel == "hamming":
            return (rows[:, None] != medoids).sum(axis=2, dtype=np.int64)
        gap = rows[:, None].astype(np.float64) - medoids
        return (np.abs(gap) if kernel == "l1" else gap * gap).cumsum(axis=2)[:, :, -1]
    # many rows: one pass over all rows of the batch per coordinate
    columns = np.ascontiguousarray(rows.T)
    if kernel != "hamming":
        columns = columns.astype(np.float64)
    elif columns.dtype.kind == "i" and columns.size and 0 <= columns.min() and columns.max() < 256:
        medoids = np.where((medoids < 0) | (medoids > 255), 256, medoids)
        columns = columns.astype(np.uint8)
    out = np.empty((len(medoids), len(rows)), np.int64 if kernel == "hamming" else np.float64)
    for i, medoid in enumerate(medoids):
        total = np.zeros(len(rows), np.int32 if kernel == "hamming" else np.float64)
        for column, value in zip(columns, medoid.tolist()):
            if kernel == "hamming":
                total += column != value
            else:
                gap = column - value
                total += np.abs(gap) if kernel == "l1" else gap * gap
        out[i] = total
    return out.T


def _ship(packs: DataFrame):
    """Broadcast ``{node_id: (pos, id, vectors)}`` of a node table within the broadcast bound."""
    table = {
        r.node_id: (
            np.array([m.pos for m in r.medoids], np.int32),
            np.array([m.id for m in r.medoids], np.int64),
            np.array([m.vector for m in r.medoids]),
        )
        for r in packs.select("node_id", "medoids").collect()
    }
    return packs.sparkSession.sparkContext.broadcast(table)


def _node_slices(nodes: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """Row numbers of each node in a batch."""
    coded = nodes.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    edges = np.flatnonzero(np.diff(codes[order])) + 1
    for part in np.split(order, edges):
        yield coded.dictionary[int(codes[part[0]])].as_py(), part


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assign_arrow(
    points: DataFrame, packs: DataFrame, metric: str | Metric = "hamming",
    keep_medoids: bool = False,
) -> DataFrame:
    """``assign`` for node tables within the broadcast bound."""
    kernel = _kernel(metric)
    counts = kernel == "hamming"
    shared = _ship(packs)

    @F.arrow_udf(T.StructType([
        T.StructField("pos", T.IntegerType()),
        T.StructField("dist", T.LongType() if counts else T.DoubleType()),
    ]))
    def nearest(nodes: pa.Array, ids: pa.Array, vectors: pa.Array) -> pa.Array:
        rows, id_values = _vectors(vectors), ids.to_numpy()
        pos = np.zeros(len(rows), np.int32)
        dist = np.zeros(len(rows), np.int64 if counts else np.float64)
        known = np.zeros(len(rows), bool)
        for node, part in _node_slices(nodes) if len(rows) else ():
            if node not in shared.value:
                continue
            positions, medoid_ids, medoids = shared.value[node]
            all_ = _distances(kernel, rows[part], medoids)
            best = all_.argmin(axis=1)
            own = id_values[part][:, None] == medoid_ids
            best = np.where(own.any(axis=1), own.argmax(axis=1), best)
            pos[part], dist[part] = positions[best], all_[np.arange(len(part)), best]
            known[part] = True
        fields = [pa.array(pos, mask=~known), pa.array(dist, mask=~known)]
        return pa.StructArray.from_arrays(fields, ["pos", "dist"])

    listed = packs.select("node_id", F.inline("medoids")).select("node_id", "id")
    small = BROADCAST_BYTES  # the ids are a part of the shipped table
    if keep_medoids:
        nodes = packs.select("node_id")
        rows = lookup_join(points, nodes, ["node_id"], "left_semi", table_bytes=small)
    else:
        rows = lookup_join(points, listed, ["node_id", "id"], "left_anti", table_bytes=small)
        rows = lookup_join(rows, packs.select("node_id"), ["node_id"], "left_semi", table_bytes=small)
    return rows.select(
        "node_id", "id", "vector", nearest("node_id", "id", "vector").alias("_best")
    ).select(
        "node_id", "id", "vector", F.col("_best.pos").alias("pos"), F.col("_best.dist").alias("dist")
    )


def _near(batch: pa.RecordBatch, rows: np.ndarray, part: np.ndarray, medoids: np.ndarray, since: int, kernel) -> np.ndarray:
    """Distance of some rows of a batch to the nearest seed: the one kept so far, and the seeds from ``since``."""
    known = np.asarray(batch.column("near"))[part] if "near" in batch.schema.names else None
    if len(medoids) <= since:
        return known
    gaps = _distances(kernel, rows[part], medoids[since:]).min(axis=1)
    return gaps if known is None else np.minimum(gaps, known)


def near_arrow(points: DataFrame, packs: DataFrame, metric: str | Metric, since: int = 0) -> DataFrame:
    """``points`` with ``near`` brought up to all seeds; only those from ``since`` on are measured."""
    kernel = _kernel(metric)
    shared = _ship(packs)
    element = points.schema["vector"].dataType.elementType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _vectors(batch.column("vector")) if batch.num_rows else None
            near = np.zeros(batch.num_rows)
            for node, part in _node_slices(batch.column("node_id")) if batch.num_rows else ():
                if node in shared.value:
                    near[part] = _near(batch, rows, part, shared.value[node][2], since, kernel)
            held = [batch.column(c) for c in ("node_id", "id", "vector")]
            yield pa.RecordBatch.from_arrays([*held, pa.array(near)], names=["node_id", "id", "vector", "near"])

    return points.mapInArrow(measure, f"node_id string, id bigint, vector array<{element}>, near double")


def farthest_arrow(points: DataFrame, packs: DataFrame, metric: str | Metric, since: int = 0) -> DataFrame:
    """One candidate ``(node_id, near, id, vector)`` per batch and node: its row farthest from the
    node's seeds, lowest id on ties. The caller takes the maximum over batches. Where ``points`` keep
    ``near``, only the seeds from ``since`` on are measured.
    """
    kernel = _kernel(metric)
    shared = _ship(packs)
    element = points.schema["vector"].dataType.elementType.simpleString()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, ids = _vectors(batch.column("vector")), batch.column("id").to_numpy()
            picked, near = [], []
            for node, part in _node_slices(batch.column("node_id")):
                if node not in shared.value:
                    continue
                gaps = _near(batch, rows, part, shared.value[node][2], since, kernel)
                far = np.flatnonzero(gaps == gaps.max())
                picked.append(part[far[ids[part][far].argmin()]])
                near.append(float(gaps.max()))
            chosen = batch.take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [chosen.column("node_id"), pa.array(near, pa.float64()), chosen.column("id"),
                 chosen.column("vector")],
                names=["node_id", "near", "id", "vector"],
            )

    return points.mapInArrow(
        reduce, f"node_id string, near double, id bigint, vector array<{element}>"
    )


def descend_arrow(
    features: DataFrame, levels: DataFrame, metric: str | Metric, root: str, word: str = "word_id"
) -> DataFrame:
    """Add the path that the nearest entry at each node leads to, for level tables within the
    broadcast bound: the whole descent is one function of the vector, without any join.
    """
    kernel = _kernel(metric)
    packed = levels.groupBy("node_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "vector"))).alias("entries")
    )
    shared = features.sparkSession.sparkContext.broadcast({
        r.node_id: ([e.pos for e in r.entries], np.array([e.vector for e in r.entries]))
        for r in packed.collect()
    })

    @F.arrow_udf("string")
    def path(vectors: pa.Array) -> pa.Array:
        found = np.empty(len(vectors), object)
        rows = _vectors(vectors) if len(vectors) else None
        waiting = [(root, np.arange(len(vectors)))] if len(vectors) else []
        while waiting:
            node, part = waiting.pop()
            if node not in shared.value:
                found[part] = node
                continue
            positions, entries = shared.value[node]
            best = _distances(kernel, rows[part], entries).argmin(axis=1)
            for b in np.unique(best).tolist():
                child = str(positions[b]) if node == root else f"{node}-{positions[b]}"
                waiting.append((child, part[best == b]))
        return pa.array(found, pa.string())

    return features.select("*", path("vector").alias(word))
