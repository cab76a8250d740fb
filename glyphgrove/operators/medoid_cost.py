"""Cost of every candidate medoid, in linear instead of quadratic work.

The cost of candidate x in cluster c is the sum of its distances to all members. For a distance
that adds up over coordinates it follows from the counts of the distinct values in each coordinate:

* Hamming:     sum over j of (size - count[j, x_j])
* L1:          sum over j of x_j * (2r - size) - 2P + T, with r and P the count and sum of the
               values up to x_j and T the sum of all values
* squared L2:  sum over j of s2 - 2 * x_j * s1 + size * x_j^2

So each vector element needs one lookup in a table of per-coordinate statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphgrove.functions.metrics import Metric, block_total, resolve
from glyphgrove.operators.ordered import finish, order_rows, running
from glyphgrove.runtime import lookup_join

CLUSTER = ["node_id", "pos"]
COORDINATE = [*CLUSTER, "j"]

#: Up to this many distinct integer values a coordinate is ordered by a plain window.
SMALL_DOMAIN = 4096


@dataclass(frozen=True)
class Shape:
    """What one pass over the vectors tells: how many, how long, and their value range."""

    rows: int
    dimension: int
    low: float
    high: float
    integral: bool

    @property
    def values(self) -> int | None:
        """Bound of the distinct values in a coordinate, if the elements are integers."""
        return int(self.high) - int(self.low) + 1 if self.integral and self.rows else None


def measure(points: DataFrame) -> Shape:
    row = points.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("vector")).alias("short"),
        F.max(F.size("vector")).alias("long"),
        F.min(F.array_min("vector")).alias("low"),
        F.max(F.array_max("vector")).alias("high"),
    ).first()
    if row.n and row.short != row.long:
        raise ValueError(f"vectors differ in length: {row.short} to {row.long}")
    element = points.schema["vector"].dataType.elementType.simpleString()
    integral = element in ("tinyint", "smallint", "int", "bigint")
    return Shape(row.n, row.long or 0, row.low or 0, row.high or 0, integral)


def _hamming_terms(elements: DataFrame, table_bytes: int | None) -> DataFrame:
    # cost = length * size - number of equal elements; the first part is the same for all members
    # of a cluster, so it is left to the caller and no second table is needed
    histogram = elements.groupBy(*COORDINATE, "x").agg(F.count(F.lit(1)).alias("n"))
    priced = lookup_join(elements, histogram, [*COORDINATE, "x"], table_bytes=table_bytes)
    return priced.withColumn("term", -F.col("n"))


def _l1_terms(
    elements: DataFrame, table_bytes: int | None, totals_bytes: int | None, shape: Shape | None
) -> DataFrame:
    value = F.col("x").cast("double")
    histogram = elements.groupBy(*COORDINATE, "x").agg(F.count(F.lit(1)).alias("n"))
    cost = value * (2 * F.col("r") - F.col("size")) - 2 * F.col("p") + F.col("s1")
    sums = {"r": F.col("n").cast("double"), "p": F.col("n") * value}
    if shape is not None and shape.values is not None and shape.values <= SMALL_DOMAIN:
        whole = W.partitionBy(*COORDINATE)
        upto = whole.orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
        table = histogram.select(
            *COORDINATE,
            "x",
            *[F.sum(v).over(upto).alias(c) for c, v in sums.items()],
            F.sum(sums["r"]).over(whole).alias("size"),
            F.sum(sums["p"]).over(whole).alias("s1"),
        )
    else:
        totals = histogram.groupBy(*COORDINATE).agg(
            F.sum(sums["r"]).alias("size"), F.sum(sums["p"]).alias("s1")
        )
        ranked = finish(running(order_rows(histogram, COORDINATE, ["x"]), sums))
        table = lookup_join(ranked, totals, COORDINATE, table_bytes=totals_bytes, hot=True)
    table = table.select(*COORDINATE, "x", cost.alias("term"))
    return lookup_join(elements, table, [*COORDINATE, "x"], table_bytes=table_bytes)


def _l2sq_terms(elements: DataFrame, totals_bytes: int | None) -> DataFrame:
    value = F.col("x").cast("double")
    totals = elements.groupBy(*COORDINATE).agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(value).alias("s1"),
        F.sum(value * value).alias("s2"),
    )
    priced = lookup_join(elements, totals, COORDINATE, table_bytes=totals_bytes, hot=True)
    term = F.col("s2") - 2 * value * F.col("s1") + F.col("size") * value * value
    return priced.withColumn("term", term)


def _blocked_costs(assigned: DataFrame, metric: Metric, block_rows: int) -> DataFrame:
    """Costs under a metric known only pair by pair: quadratic work, but no pair leaves a task.

    The members of a cluster are packed into blocks of about ``block_rows``; every candidate meets
    every block of its cluster and emits one partial sum.
    """
    counts = assigned.groupBy(*CLUSTER).agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")
    )
    sized = lookup_join(assigned.select(*CLUSTER, "id", "vector"), counts, CLUSTER, hot=True)
    members = (
        sized.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .groupBy(*CLUSTER, "block")
        .agg(F.collect_list("vector").alias("members"))
    )
    candidates = sized.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    if metric.cost_kernel is not None:
        part = block_total(metric.cost_kernel)(F.col("vector"), F.col("members"))
    else:
        part = F.aggregate(
            "members",
            F.lit(0.0),
            lambda acc, other: acc + metric.cost(F.col("vector"), other).cast("double"),
        )
    met = lookup_join(candidates.drop("blocks"), members, [*CLUSTER, "block"])
    return met.select(*CLUSTER, "id", part.alias("cost")).groupBy(*CLUSTER, "id").agg(
        F.sum("cost").alias("cost")
    )


def candidate_costs(
    assigned: DataFrame,
    metric: str | Metric = "hamming",
    clusters: int | None = None,
    shape: Shape | None = None,
    block_rows: int = 256,
) -> DataFrame:
    """``(node_id, pos, id, cost)`` for every member of every cluster of ``assigned``.

    ``clusters`` and ``shape`` are proven bounds; with them the value table is broadcast when it is
    small enough.
    """
    metric = resolve(metric)
    if metric.additive is None:
        return _blocked_costs(assigned, metric, block_rows)
    elements = assigned.select(*CLUSTER, "id", F.posexplode("vector").alias("j", "x"))
    values = totals = None
    if clusters and shape:
        totals = clusters * shape.dimension * 64
        values = totals * min(shape.values, shape.rows) if shape.values else None
    if metric.additive == "hamming":
        terms = _hamming_terms(elements, values)
    elif metric.additive == "l1":
        terms = _l1_terms(elements, values, totals, shape)
    else:
        terms = _l2sq_terms(elements, totals)
    costs = terms.groupBy(*CLUSTER, "id").agg(
        F.sum("term").alias("cost"), F.count(F.lit(1)).alias("length")
    )
    if metric.additive == "hamming":
        sizes = assigned.groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("size"))
        costs = lookup_join(
            costs, sizes, CLUSTER, table_bytes=clusters * 64 if clusters else None, hot=True
        )
        costs = costs.withColumn("cost", F.col("length") * F.col("size") + F.col("cost"))
    return costs.select(*CLUSTER, "id", "cost")


def best_candidates(
    assigned: DataFrame,
    metric: str | Metric = "hamming",
    clusters: int | None = None,
    shape: Shape | None = None,
) -> DataFrame:
    """One row per non-empty cluster: cheapest member (lowest id on ties), its cost, and all costs."""
    costs = candidate_costs(assigned, metric, clusters, shape)
    return (
        costs.groupBy(*CLUSTER)
        .agg(
            F.min(F.struct("cost", "id")).alias("best"),
            # as double: the sum over all pairs of a large cluster leaves the range of BIGINT
            F.sum(F.col("cost").cast("double")).alias("all_pairs"),
            F.count(F.lit(1)).alias("members"),
        )
        .select(
            *CLUSTER,
            F.col("best.id").alias("id"),
            F.col("best.cost").alias("medoid_cost"),
            "all_pairs",
            "members",
        )
    )
