"""Small column helpers over numeric arrays and sparse word rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_bits(v: Column) -> Column:
    return F.transform(v, lambda x: (x > 0).cast("int"))


def to_bytes(v: Column) -> Column:
    """Values in [-1, 1] as integers 0..255."""
    return F.transform(v, lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))


def root(v: Column) -> Column:
    return F.transform(v, lambda x: F.sqrt(x.cast("double")))


def to_key(v: Column) -> Column:
    """The vector as one string, elements joined by dots."""
    return F.concat_ws(".", F.transform(v, lambda x: x.cast("string")))


def from_key(key: Column) -> Column:
    return F.transform(F.split(key, r"\."), lambda x: x.cast("int"))


def count_nonzero(v: Column | np.ndarray) -> Column | np.ndarray:
    """Elements that are not zero; of a numpy block, those of each of its rows."""
    if isinstance(v, np.ndarray):
        # comparison and count of flags are vectorised; counting numbers, or along an axis, takes up to twice as long
        return np.array([np.count_nonzero(row) for row in v != 0], np.int32)
    return F.size(F.filter(v, lambda x: x != 0))


def one_hot(
    index: Column | np.ndarray, weight: Column | np.ndarray, size: int | Column
) -> Column | np.ndarray:
    """Dense vector with ``weight`` at ``index`` and zero elsewhere; of numpy arrays, a block with one vector a row."""
    if isinstance(index, np.ndarray):
        hot = np.zeros((len(index), size))
        inside = np.flatnonzero((index >= 0) & (index < size))
        hot[inside, index[inside]] = weight[inside]
        return hot
    last = (F.lit(size) if isinstance(size, int) else size) - 1
    # the length hangs on the row: of a constant one, the whole sequence would become a part of the plan
    last = last + F.coalesce(index * 0, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last.cast("int")),
        lambda j: F.when(j == index, weight.cast("double")).otherwise(0.0),
    )


def dense(entries: Column, size: int) -> Column:
    """Dense view of a ``map<index, weight>``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.coalesce(entries[j], F.lit(0.0))
    )


def floor_cents(x: Column) -> Column:
    """Floor to two decimals."""
    return F.floor(x * 100) / 100.0


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
