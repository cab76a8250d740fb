"""Ordered work per key that stays parallel when one key holds most of the rows.

A window over ``partitionBy(key).orderBy(...)`` sends a whole key to one task. Here the largest
key is measured first. Below ``max_group_rows`` the plain window is used. Above it the rows are
range-partitioned by (key, order), every range becomes a chunk of bounded size, the work is done
per chunk, and what one chunk needs from the chunks before it travels in a table of one row per
(key, chunk).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgrove.runtime import lookup_join, materialise

CHUNK = "_chunk"
MAX_GROUP_ROWS = 1_000_000


@dataclass(frozen=True)
class Ordered:
    """Rows with a chunk number that rises along ``order`` within each key."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    chunked: bool

    @property
    def scope(self) -> list[str]:
        return [*self.keys, CHUNK]

    def window(self) -> W:
        return W.partitionBy(*self.scope).orderBy(*self.order)

    def before(self) -> W:
        """All earlier chunks of the key, over a table of one row per (key, chunk)."""
        return W.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)

    def replace(self, rows: DataFrame) -> Ordered:
        return Ordered(rows, self.keys, self.order, self.chunked)


def order_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> Ordered:
    """Measure the largest key and cut the rows into chunks only where that is needed.

    ``max_group_rows=None`` says that the caller has a proof that every key is small.
    """
    if max_group_rows is None:
        return Ordered(df.withColumn(CHUNK, F.lit(0)), keys, order, chunked=False)
    sizes = df.groupBy(*keys).count() if keys else df.agg(F.count(F.lit(1)).alias("count"))
    largest, total = sizes.agg(F.max("count"), F.sum("count")).first()
    if (largest or 0) <= max_group_rows:
        return Ordered(df.withColumn(CHUNK, F.lit(0)), keys, order, chunked=False)
    ranges = max(2, -(-2 * total // max_group_rows))
    # the range bounds come from a sample, so the chunk number is written down before it is used
    cut = df.repartitionByRange(int(ranges), *keys, *order).withColumn(
        CHUNK, F.spark_partition_id()
    )
    return Ordered(materialise(cut, "chunks"), keys, order, chunked=True)


def running(ordered: Ordered, sums: dict[str, Column]) -> Ordered:
    """Add running totals, the current row included: ``{new column: value}``."""
    window = ordered.window().rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = ordered.rows.select("*", *[F.sum(v).over(window).alias(c) for c, v in sums.items()])
    if ordered.chunked:
        totals = ordered.rows.groupBy(*ordered.scope).agg(
            *[F.sum(v).alias(f"_sum_{c}") for c, v in sums.items()]
        )
        before = totals.select(
            *ordered.scope,
            *[
                F.coalesce(F.sum(f"_sum_{c}").over(ordered.before()), F.lit(0)).alias(f"_before_{c}")
                for c in sums
            ],
        )
        rows = lookup_join(rows, before, ordered.scope)
        for c in sums:
            rows = rows.withColumn(c, F.col(c) + F.col(f"_before_{c}")).drop(f"_before_{c}")
    return ordered.replace(rows)


def number(ordered: Ordered, name: str) -> Ordered:
    """Add the position of each row within its key, counted from 1."""
    rows = ordered.rows.withColumn(name, F.row_number().over(ordered.window()).cast("bigint"))
    if ordered.chunked:
        counts = ordered.rows.groupBy(*ordered.scope).agg(F.count(F.lit(1)).alias("_rows"))
        before = counts.select(
            *ordered.scope, F.coalesce(F.sum("_rows").over(ordered.before()), F.lit(0)).alias("_before")
        )
        rows = lookup_join(rows, before, ordered.scope)
        rows = rows.withColumn(name, F.col(name) + F.col("_before")).drop("_before")
    return ordered.replace(rows)


def previous(ordered: Ordered, columns: dict[str, str]) -> Ordered:
    """Add the value each column had one row earlier: ``{column: new column}``."""
    window = ordered.window()
    rows = ordered.rows.select(
        "*",
        *[F.lag(c).over(window).alias(new) for c, new in columns.items()],
        F.row_number().over(window).alias("_at"),
    )
    if ordered.chunked:
        last = ordered.rows.groupBy(*ordered.scope).agg(
            F.max(F.struct(*ordered.order, F.struct(*columns).alias("_row"))).alias("_last")
        )
        edge = W.partitionBy(*ordered.keys).orderBy(CHUNK)
        last = last.select(*ordered.scope, F.lag("_last").over(edge).alias("_edge"))
        rows = lookup_join(rows, last, ordered.scope)
        for c, new in columns.items():
            rows = rows.withColumn(
                new, F.when(F.col("_at") == 1, F.col(f"_edge._row.{c}")).otherwise(F.col(new))
            )
        rows = rows.drop("_edge")
    return ordered.replace(rows.drop("_at"))


def scan(
    rows: DataFrame,
    scope: list[str],
    order: list[str],
    inputs: list[str],
    outputs: T.StructType,
    advance: Callable[[list[np.ndarray], Any], tuple[list[np.ndarray], Any]],
) -> DataFrame:
    """Run a sequential rule along the sorted rows of each scope and append its ``outputs``.

    Sorted partitions are streamed batch by batch. ``advance`` gets the ``inputs`` of a run of rows
    of one scope and the state it returned for the run before (None at the start of a scope), so
    many small scopes cost no more than one large one and memory holds one batch.
    """
    schema = T.StructType([*rows.schema.fields, *outputs.fields])
    names = outputs.fieldNames()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            if batch.empty:
                continue
            keys = batch[scope]
            moved = (keys.ne(keys.shift()) & ~(keys.isna() & keys.shift().isna())).any(axis=1)
            starts = np.flatnonzero(moved.to_numpy())
            if not len(starts) or starts[0]:
                starts = np.r_[0, starts]
            first = tuple(keys.iloc[0].fillna("").tolist())
            values = [batch[c].to_numpy() for c in inputs]
            parts = []
            for i, (lo, hi) in enumerate(zip(starts, np.r_[starts[1:], len(batch)])):
                if i or first != last:
                    state = None
                part, state = advance([v[lo:hi] for v in values], state)
                parts.append(part)
            last = tuple(keys.iloc[-1].fillna("").tolist())
            for name, column in zip(names, zip(*parts)):
                batch[name] = np.concatenate(column)
            yield batch[schema.fieldNames()]

    return rows.repartition(*scope).sortWithinPartitions(*scope, *order).mapInPandas(walk, schema)


def finish(ordered: Ordered) -> DataFrame:
    return ordered.rows.drop(CHUNK)


def dense_ids(df: DataFrame, order: list[str], name: str = "id", **options) -> DataFrame:
    """Number all rows 0, 1, 2, ... along ``order`` without moving them to one task."""
    numbered = finish(number(order_rows(df, [], order, **options), name))
    return numbered.withColumn(name, F.col(name) - 1)
