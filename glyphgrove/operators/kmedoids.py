"""Seeding, iteration and results of k-medoids, for one data set or for many nodes at once.

``points`` are ``(node_id, id, vector)``. All nodes advance together, one Spark action per step;
the driver sees no rows, only the small node tables that ``pin`` bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import count

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrove.functions.metrics import Metric, resolve
from glyphgrove.functions.paths import ROOT
from glyphgrove.operators.assignment import (
    assign, assign_arrow, farthest_arrow, fits_arrow, near_arrow,
)
from glyphgrove.operators.dense_update import dense_update, fits_dense
from glyphgrove.operators.grouped import (
    assign_grouped, farthest_grouped, fits_grouped, has_kernel, update_grouped,
)
from glyphgrove.operators.medoid_cost import Shape, best_candidates, measure
from glyphgrove.runtime import BROADCAST_BYTES, lookup_join, materialise, pin, vector_bytes

#: Seeding rounds between two writes of the distance to the nearest seed so far.
REFRESH = 16


def as_node(df: DataFrame, node: str = ROOT) -> DataFrame:
    """Put a plain ``(id, vector)`` table under one node."""
    return df.select(F.lit(node).alias("node_id"), F.col("id").cast("bigint").alias("id"), "vector")


def _per_node(df: DataFrame, nodes: int, top: Column) -> DataFrame:
    """One aggregate per node. A single node needs no grouping, hence no sort and no shuffle by key."""
    if nodes == 1:
        return df.agg(F.min("node_id").alias("node_id"), top.alias("_top")).filter(
            F.col("node_id").isNotNull()
        )
    return df.groupBy("node_id").agg(top.alias("_top"))


def _entry(pos: Column, id_: Column, vector: Column) -> Column:
    return F.struct(pos.alias("pos"), id_.alias("id"), vector.alias("vector"))


def _pack_bytes(nodes: int, k: int, shape: Shape) -> int:
    return nodes * (64 + k * (32 + vector_bytes(shape.dimension)))


def farthest_first(
    points: DataFrame,
    k: int,
    metric: str | Metric = "hamming",
    first: int | None = None,
    random_state: int | None = None,
    nodes: int = 1,
    shape: Shape | None = None,
) -> DataFrame:
    """k seeds per node, each the row farthest from those before it (lowest id on ties).

    The first seed is the row ``first``, or a repeatable random row when ``random_state`` is given,
    or the lowest id.
    """
    metric = resolve(metric)
    shape = shape or measure(points)
    row_bytes = _pack_bytes(1, k, shape)
    start = points if first is None else points.filter(F.col("id") == first)
    rank = F.col("id") if random_state is None else F.xxhash64("id", F.lit(random_state))
    opening = _per_node(start, nodes, F.min(F.struct(rank.alias("rank"), "id", "vector")))
    packs = pin(
        opening.select(
            "node_id", F.array(_entry(F.lit(0), F.col("_top.id"), F.col("_top.vector"))).alias("medoids")
        ),
        nodes, row_bytes, "seeds",
    )
    done, rows = 0, points.select("node_id", "id", "vector")

    def nearest(seeds: Column) -> Column:
        return F.array_min(F.transform(seeds, lambda m: metric.point(F.col("vector"), m["vector"])))

    # no literal of the round number in these, so that all rounds share their generated code
    near = nearest(F.col("medoids"))
    farthest = F.max(F.struct("near", (-F.col("id")).alias("neg"), "vector"))
    grown = F.array_append(
        "medoids", _entry(F.size("medoids"), -F.col("_top.neg"), F.col("_top.vector"))
    )
    arrow = fits_arrow(metric, nodes * row_bytes, k * shape.dimension)
    apart = not arrow and metric.kernel is not None
    for pos in range(1, k):
        if apart:
            far = _per_node(farthest_grouped(rows, packs, metric), nodes, farthest)
            packs = pin(
                packs.join(far, "node_id").select("node_id", grown.alias("medoids")),
                nodes, row_bytes, "seeds",
            )
            continue
        if arrow:
            if pos - done >= REFRESH:
                rows, done = materialise(near_arrow(rows, packs, metric, done), "near"), pos
            far = _per_node(farthest_arrow(rows, packs, metric, done), nodes, farthest)
            packs = pin(
                packs.join(far, "node_id").select("node_id", grown.alias("medoids")),
                nodes, row_bytes, "seeds",
            )
            continue
        joined = lookup_join(rows, packs, ["node_id"], table_bytes=nodes * row_bytes, hot=True)
        scored = joined.select("node_id", "id", "vector", near.alias("near"))
        if pos - done >= REFRESH:
            rows, done = materialise(scored, "near"), pos
            scored = rows
            since = F.slice("medoids", F.lit(done + 1), F.size("medoids") - done)
            near = F.least(F.col("near"), nearest(since))
        far = _per_node(scored, nodes, farthest)
        packs = pin(
            packs.join(far, "node_id").select("node_id", grown.alias("medoids")),
            nodes, row_bytes, "seeds",
        )
    return packs


def explicit_seeds(points: DataFrame, ids: Sequence[int]) -> DataFrame:
    """The given rows of the root as medoids, in the given order."""
    wanted = points.sparkSession.createDataFrame(
        [(p, int(i)) for p, i in enumerate(ids)], "pos int, id bigint"
    )
    found = points.join(F.broadcast(wanted), "id").groupBy("node_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "id", "vector"))).alias("medoids")
    )
    return found


def random_seeds(points: DataFrame, k: int, random_state: int = 0) -> DataFrame:
    """k rows of the root drawn without replacement, repeatable for one ``random_state``."""
    draw = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(random_state))))
    drawn = (
        points.select("id", draw.alias("draw"))
        .orderBy("draw", "id")
        .limit(k)
        .collect()
    )
    return explicit_seeds(points, [r.id for r in drawn])


@dataclass
class Clustering:
    """Medoids per node, and the assignment they imply."""

    points: DataFrame
    packs: DataFrame
    metric: Metric
    k: int
    nodes: int
    shape: Shape
    #: Total cost of the partition seen by each iteration (nodes still running only).
    costs: list[float] = field(default_factory=list)
    #: False if a caller's ``max_iter`` ended the iteration.
    converged: bool = True

    def medoids(self) -> DataFrame:
        """``(node_id, pos, id, vector)``."""
        return self.packs.select("node_id", F.inline("medoids"))

    def assignment(self) -> DataFrame:
        """``(node_id, id, vector, pos, dist)`` of all rows but the medoids."""
        return _place(self.points, self.packs, self.metric, self.k, self.nodes, self.shape)

    def clusters(self) -> DataFrame:
        return cluster_lists(self.assignment(), self.medoids())


#: Ids in one list of ``cluster_lists``.
LIST_BLOCK = 4096


def cluster_lists(
    assignment: DataFrame, medoids: DataFrame, block: int = LIST_BLOCK
) -> DataFrame:
    """``(node_id, pos, medoid_id, block, members)``, one row with ``[]`` for an empty cluster.

    The list form of an assignment. A cluster is cut by id range, so no list is longer than
    ``block`` however large the cluster.
    """
    members = (
        assignment.withColumn("block", F.floor(F.col("id") / block).cast("bigint"))
        .groupBy("node_id", "pos", "block")
        .agg(F.sort_array(F.collect_list("id")).alias("members"))
    )
    return medoids.join(members, ["node_id", "pos"], "left").select(
        "node_id",
        "pos",
        F.col("id").alias("medoid_id"),
        F.coalesce("block", F.lit(0)).alias("block"),
        F.coalesce("members", F.array().cast("array<bigint>")).alias("members"),
    )


def _place(
    points: DataFrame, packs: DataFrame, metric: Metric, k: int, nodes: int, shape: Shape,
    keep_medoids: bool = False,
) -> DataFrame:
    table_bytes = _pack_bytes(nodes, k, shape)
    if fits_arrow(metric, table_bytes, k * shape.dimension):
        return assign_arrow(points, packs, metric, keep_medoids)
    if metric.kernel is not None or (has_kernel(metric) and table_bytes > BROADCAST_BYTES):
        return assign_grouped(points, packs, metric, keep_medoids)
    return assign(points, packs, metric, table_bytes, keep_medoids)


def update(
    points: DataFrame,
    packs: DataFrame,
    metric: str | Metric,
    k: int,
    nodes: int,
    shape: Shape,
    candidates: str = "members",
    cost: str = "all_pairs",
    storage: StorageLevel | None = StorageLevel.MEMORY_AND_DISK,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One medoid update of every node: ``(node_id, medoids, cost)``.

    Integer vectors of a small value range take the two passes of ``dense_update`` or, where the tables of all
    nodes together are beyond the broadcast bound, those of ``update_grouped``. Otherwise the
    assignment is read three times, so it is persisted with ``storage`` until ``keep`` has fixed
    the result; ``storage=None`` recomputes it instead.

    ``candidates="members+medoid"`` lets a medoid keep its place. ``cost`` is the sum over every
    candidate ("all_pairs") or over the chosen ones ("medoid"). An empty cluster keeps its medoid.
    """
    metric = resolve(metric)
    keep = keep or (lambda df: pin(df, nodes, _pack_bytes(1, k, shape), "medoids"))
    _cost_column(cost)
    if fits_dense(metric, nodes * k, shape):
        stay = candidates == "members+medoid"
        return keep(dense_update(points, packs, metric, shape, stay, cost == "all_pairs"))
    if fits_grouped(metric, k, shape):
        stay = candidates == "members+medoid"
        return keep(update_grouped(points, packs, metric, shape, stay, cost == "all_pairs"))
    placed = _place(points, packs, metric, k, nodes, shape, candidates == "members+medoid")
    assigned = placed.select("node_id", "pos", "id", "vector")
    if storage is not None:
        assigned = assigned.persist(storage)
    best = best_candidates(assigned, metric, nodes * k, shape)
    best = best.select("node_id", "pos", "id", F.col(_cost_column(cost)).alias("cost"))
    winners = lookup_join(
        assigned, best, ["node_id", "pos", "id"], table_bytes=nodes * k * 128
    )
    winners = winners.select(
        "node_id", "pos", F.struct("id", "vector").alias("won"), "cost"
    )
    merged = lookup_join(
        packs.select("node_id", F.inline("medoids")), winners, ["node_id", "pos"], "left",
        table_bytes=nodes * k * (64 + vector_bytes(shape.dimension)),
    )
    result = keep(
        merged.groupBy("node_id").agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "pos",
                        F.coalesce("won.id", "id").alias("id"),
                        F.coalesce("won.vector", "vector").alias("vector"),
                    )
                )
            ).alias("medoids"),
            F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("cost"),
        )
    )
    if storage is not None:
        assigned.unpersist()
    return result


def _cost_column(cost: str) -> str:
    names = {"all_pairs": "all_pairs", "medoid": "medoid_cost"}
    if cost not in names:
        raise ValueError(f"unknown cost {cost!r}; known: {', '.join(names)}")
    return names[cost]


def fit_nodes(
    points: DataFrame,
    seeds: DataFrame,
    metric: str | Metric,
    k: int,
    nodes: int,
    shape: Shape,
    max_iter: int | None = None,
    candidates: str = "members",
    cost: str = "all_pairs",
    return_policy: str = "reference",
) -> Clustering:
    """Iterate every node until its cost first fails to drop.

    The cost of an iteration is that of the partition it starts from. With
    ``return_policy="reference"`` a node ends with the partition whose cost failed to drop, with
    ``"best"`` with the one before it. Costs fall until they stop, so the loop ends by itself; a
    caller's ``max_iter`` ends it earlier and leaves ``converged`` false if a node was still moving.
    """
    if return_policy not in ("reference", "best"):
        raise ValueError(f"unknown return_policy {return_policy!r}")
    metric = resolve(metric)
    row_bytes = 2 * _pack_bytes(1, k, shape) + 32
    # current: medoids now; earlier: medoids one iteration before; last: cost of that partition
    state = seeds.select(
        "node_id", F.col("medoids").alias("current"), F.col("medoids").alias("earlier"),
        F.lit(float("inf")).alias("last"),
    )
    finished: DataFrame | None = None
    costs: list[float] = []
    active = nodes
    for _ in count() if max_iter is None else range(max_iter):
        running = state.select("node_id", F.col("current").alias("medoids"))
        live = points if active == nodes else lookup_join(
            points, state.select("node_id"), ["node_id"], "left_semi", table_bytes=active * 64,
            hot=True,
        )
        previous, rows = state, active

        def judge(moved: DataFrame) -> DataFrame:
            both = lookup_join(moved, previous, ["node_id"], table_bytes=rows * row_bytes)
            better = (F.col("cost") < F.col("last")).alias("better")
            return pin(both.select("*", better), rows, 2 * row_bytes, "state")

        judged = update(live, running, metric, k, active, shape, candidates, cost, keep=judge)
        tally = judged.agg(
            F.sum("cost").alias("cost"), F.sum(F.col("better").cast("int")).alias("better")
        ).first()
        costs.append(tally.cost)
        kept = "current" if return_policy == "reference" else "earlier"
        stopped = judged.filter(~F.col("better")).select("node_id", F.col(kept).alias("medoids"))
        if tally.better < active:
            finished = stopped if finished is None else finished.unionByName(stopped)
        active = tally.better
        state = judged.filter("better").select(
            "node_id", F.col("medoids").alias("current"), F.col("current").alias("earlier"),
            F.col("cost").alias("last"),
        )
        if not active:
            break
    result = finished
    if active:
        rest = state.select("node_id", F.col("current").alias("medoids"))
        result = rest if result is None else result.unionByName(rest)
    packs = pin(result, nodes, row_bytes, "clustering")
    return Clustering(points, packs, metric, k, nodes, shape, costs, converged=not active)


def fit(
    df: DataFrame,
    k: int = 2,
    metric: str | Metric = "euclidean",
    seeding: str | Sequence[int] = "heuristic",
    first: int | None = None,
    random_state: int | None = None,
    **options,
) -> Clustering:
    """Cluster ``(id, vector)`` rows.

    ``seeding`` is "heuristic" (farthest-first), "random", or a list of k row ids. ``options`` are
    those of ``fit_nodes``.
    """
    metric = resolve(metric)
    points = as_node(df)
    shape = measure(points)
    if not 0 < k <= shape.rows:
        raise ValueError(f"k={k} needs between 1 and {shape.rows} rows")
    if seeding == "heuristic":
        seeds = farthest_first(points, k, metric, first, random_state, shape=shape)
    elif seeding == "random":
        seeds = random_seeds(points, k, random_state or 0)
    elif isinstance(seeding, str):
        raise ValueError(f"unknown seeding {seeding!r}")
    else:
        if len(set(seeding)) != k:
            raise ValueError(f"seeding lists {len(set(seeding))} different rows, k is {k}")
        seeds = explicit_seeds(points, seeding)
        if seeds.select(F.size("medoids")).first() != (k,):
            raise ValueError("some seed ids are not in the data")
    return fit_nodes(points, seeds, metric, k, 1, shape, **options)


def completeness(assignment: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Data-quality row: a partition of n rows around k medoids must place n - k of them."""
    placed = assignment.agg(F.count(F.lit(1)).alias("placed"))
    total = points.agg(F.count(F.lit(1)).alias("total"))
    # both sides are one aggregate row
    return placed.join(F.broadcast(total), F.lit(True)).select(
        "placed", (F.col("total") - k).alias("expected"),
        (F.col("placed") == F.col("total") - k).alias("complete"),
    )
