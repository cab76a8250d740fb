"""Distances between two array columns, and the registry that names them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = Callable[[Column, Column], Column]
Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _total(terms: Column, zero: Column) -> Column:
    return F.aggregate(terms, zero, lambda acc, x: acc + x)


def hamming(a: Column, b: Column) -> Column:
    """Number of positions whose elements differ (elements, not bits)."""
    return _total(F.zip_with(a, b, lambda x, y: (x != y).cast("bigint")), F.lit(0).cast("bigint"))


def l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences, widened first so that small types never wrap."""
    return _total(
        F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0)
    )


def l2sq(a: Column, b: Column) -> Column:
    """Sum of squared differences."""

    def term(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return _total(F.zip_with(a, b, term), F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2sq(a, b))


def percent_equal(a: Column, b: Column) -> Column:
    """Share of equal positions, in percent."""
    return (F.size(a) - hamming(a, b)) * 100.0 / F.size(a)


@dataclass(frozen=True)
class Metric:
    """``point`` places rows and seeds; ``cost`` scores candidate medoids.

    ``additive`` names the linear-time cost formula (see ``operators.medoid_cost``); ``None`` means
    that only the blocked pairwise sum of ``cost`` is known to be right.

    ``kernel`` and ``cost_kernel`` are the numpy forms of a metric without column builders: they
    take a matrix of rows and one vector, and return one distance per row.
    """

    name: str
    point: Pair
    cost: Pair
    additive: str | None = None
    kernel: Kernel | None = None
    cost_kernel: Kernel | None = None


_REGISTRY: dict[str, Metric] = {
    "hamming": Metric("hamming", hamming, hamming, "hamming"),
    "l1": Metric("l1", l1, l1, "l1"),
    "l2sq": Metric("l2sq", l2sq, l2sq, "l2sq"),
    # places by squared L2 and costs by L1
    "euclidean": Metric("euclidean", l2sq, l1, "l1"),
}


def register(metric: Metric) -> None:
    _REGISTRY[metric.name] = metric


def resolve(metric: str | Metric) -> Metric:
    if isinstance(metric, Metric):
        return metric
    if metric not in _REGISTRY:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[metric]


def custom(name: str, point: Pair, cost: Pair | None = None) -> Metric:
    """A metric given by column builders only; its medoid costs are summed block by block."""
    return Metric(name, point, cost or point)


def from_numpy(name: str, kernel: Kernel, cost_kernel: Kernel | None = None) -> Metric:
    """A metric given by a numpy function ``(rows, vector) -> distances``.

    It runs on Arrow batches, with the medoids of a level broadcast or, beyond that bound, cogrouped with the
    rows of their node; like any metric without a linear formula its medoid costs are summed block by block.
    """
    cost_kernel = cost_kernel or kernel
    return Metric(name, _pairwise(kernel), _pairwise(cost_kernel), None, kernel, cost_kernel)


def _pairwise(kernel: Kernel) -> Pair:
    @F.arrow_udf("double")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist())
        return pa.array([float(kernel(np.array([x]), np.array(y))[0]) for x, y in pairs], pa.float64())

    return distance


def block_total(kernel: Kernel) -> Pair:
    """Sum of the distances of a vector to each vector of an array."""

    @F.arrow_udf("double")
    def total(vectors: pa.Array, members: pa.Array) -> pa.Array:
        sums = []
        for vector, block in zip(vectors, members):
            inner = block.values
            rows = inner.flatten().to_numpy(zero_copy_only=False).reshape(len(inner), -1)
            sums.append(float(kernel(rows, np.array(vector.as_py())).sum()))
        return pa.array(sums, pa.float64())

    return total
