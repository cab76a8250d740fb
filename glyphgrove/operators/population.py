"""Descriptor statistics: distinct vectors, samples, cluster shares, mean root, k-means baseline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphgrove.runtime import BROADCAST_BYTES, materialise


def distinct_vectors(df: DataFrame) -> DataFrame:
    """One row per vector, under its lowest id. Copies meet in partial aggregates first."""
    return df.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector")


def sample_rows(df: DataFrame, n: int, random_state: int = 0) -> DataFrame:
    """n rows without replacement, the same ones for the same ``random_state``."""
    draw = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(random_state))))
    return df.withColumn("_draw", draw).orderBy("_draw", "id").limit(n).drop("_draw")


def population(assignment: DataFrame) -> DataFrame:
    """``(node_id, pos, members, share)`` of all assigned rows."""
    counts = assignment.groupBy("node_id", "pos").agg(F.count(F.lit(1)).alias("members"))
    total = counts.agg(F.sum("members")).scalar()
    return counts.select("node_id", "pos", "members", (F.col("members") / total).alias("share"))


def population_of_lists(clusters: DataFrame) -> DataFrame:
    """``(cluster, members, share)`` of a saved clustering in long form ``(cluster, id)``."""
    counts = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    total = counts.agg(F.sum("members")).scalar()
    return counts.select("cluster", "members", (F.col("members") / total).alias("share"))


def members_of(assignment: DataFrame, node_id: str, pos: int) -> DataFrame:
    """Rows of one cluster."""
    return assignment.filter((F.col("node_id") == node_id) & (F.col("pos") == pos))


def gather(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id is listed."""
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def root_mean(df: DataFrame) -> DataFrame:
    """``(j, mean)``: mean of the square roots per coordinate."""
    return (
        df.select(F.posexplode("vector").alias("j", "x"))
        .groupBy("j")
        .agg(F.avg(F.sqrt(F.col("x").cast("double"))).alias("mean"))
    )


def root_mean_vector(df: DataFrame) -> DataFrame:
    """The mean root descriptor as one array (as long as one descriptor)."""
    listed = F.sort_array(F.collect_list(F.struct("j", "mean")))
    return root_mean(df).agg(F.transform(listed, lambda e: e["mean"]).alias("vector"))


def _squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances rows x centres, to six digits, so that equal ones stay equal however they are added up."""
    gaps = (rows * rows).sum(1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(1)
    return np.round(np.maximum(gaps, 0.0), 6)


def _drawn_centres(rows: DataFrame, k: int, attempts: int, random_state: int) -> np.ndarray:
    """For each attempt the k rows that a hash of id, attempt and ``random_state`` puts first."""
    name = F.concat_ws(":", F.col("id").cast("string"), F.col("attempt").cast("string"), F.lit(str(random_state)))
    listed = rows.select("id", F.explode(F.lit(list(range(attempts)))).alias("attempt")).withColumn("draw", F.md5(name))
    # the limit is applied in every task before the rows of an attempt meet
    place = F.row_number().over(W.partitionBy("attempt").orderBy("draw", "id"))
    first = listed.withColumn("pos", place - 1).filter(F.col("pos") < k).select("id", "attempt", "pos")
    found = rows.join(F.broadcast(first), "id").select("attempt", "pos", "vector").collect()
    out = np.zeros((attempts, k, len(found[0]["vector"])))
    for r in found:
        out[r["attempt"], r["pos"]] = r["vector"]
    return out


def kmeans_baseline(
    df: DataFrame, k: int = 1024, max_iter: int = 1, tol: float = 10.0, attempts: int = 10,
    random_state: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """k-means from random centres, the cheapest of several attempts: centres and assignment.

    Centres are ``(attempt, cluster, vector, cost)``, the assignment is ``(id, cluster, dist)`` with squared
    distances. Starting centres are drawn by hash from the rows. Each of up to ``max_iter`` updates moves all
    centres of all attempts to the means of their rows, an empty one stays; they end when no centre moves
    more than ``tol``. All attempts are placed, added up and priced in the same scans; the lowest cost wins, then the
    lowest attempt. Their centres must be within the broadcast bound. ``id`` must be unique; no rows give no rows.
    """
    spark = df.sparkSession
    rows = materialise(df.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector")), "vectors")
    k = min(k, rows.count())
    shapes = "attempt int, cluster int, vector array<double>, cost double", "id bigint, cluster int, dist double"
    if not k:
        return tuple(spark.createDataFrame([], s) for s in shapes)
    dimension = len(rows.first()["vector"])
    if attempts * k * dimension * 8 > BROADCAST_BYTES:
        raise ValueError(f"{attempts} x {k} centres exceed the broadcast bound; lower attempts or k")
    centres = _drawn_centres(rows, k, attempts, random_state)
    width = dimension + 1

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.asarray(batch.column("vector").flatten()).reshape(batch.num_rows, dimension)

    for _ in range(max_iter):
        shared = spark.sparkContext.broadcast(centres)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sums of the coordinates and number of rows of each cluster, as cells of one long vector."""
            sums = np.zeros((attempts * k, width))
            for batch in batches:
                if batch.num_rows:
                    own = matrix(batch)
                    for attempt in range(attempts):
                        at = _squared(own, shared.value[attempt]).argmin(axis=1) + attempt * k
                        np.add.at(sums, at, np.column_stack([own, np.ones(len(own))]))
            cells = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums.ravel()[cells])], names=["cell", "x"])

        total = rows.mapInArrow(add_up, "cell bigint, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow()
        sums = np.zeros(attempts * k * width)
        sums[total.column("cell").to_numpy()] = total.column("x").to_numpy()
        sums = sums.reshape(attempts, k, width)
        held = sums[:, :, -1:]
        moved = np.where(held > 0, sums[:, :, :-1] / np.maximum(held, 1), centres)
        shift = np.sqrt(((moved - centres) ** 2).sum(axis=2)).max()
        centres = moved
        if shift <= tol:
            break
    final = spark.sparkContext.broadcast(centres)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = np.zeros(attempts)
        for batch in batches:
            if batch.num_rows:
                own = matrix(batch)
                cost += [_squared(own, final.value[a]).min(axis=1).sum() for a in range(attempts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(attempts), pa.int32()), pa.array(cost)], names=["attempt", "cost"])

    costs = rows.mapInArrow(price, "attempt int, cost double").groupBy("attempt").agg(
        F.round(F.sum("cost"), 3).alias("cost"))
    best = costs.orderBy("cost", "attempt").first()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gaps = _squared(matrix(batch), final.value[best["attempt"]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(gaps.argmin(axis=1), pa.int32()), pa.array(gaps.min(axis=1))],
                    names=["id", "cluster", "dist"])

    listed = [(best["attempt"], pos, v, best["cost"]) for pos, v in enumerate(centres[best["attempt"]].tolist())]
    narrow = rows.select(F.col("id").cast("bigint").alias("id"), "vector")
    return spark.createDataFrame(listed, shapes[0]), narrow.mapInArrow(place, shapes[1])
