"""Node paths of a tree: ``root``, ``3``, ``3-0-7``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "root"


def child(node: Column, pos: Column) -> Column:
    """Path of the child at ``pos``; children of the root carry no prefix."""
    label = pos.cast("string")
    return F.when(node == ROOT, label).otherwise(F.concat_ws("-", node, label))


def steps(path: Column) -> Column:
    """The path as integers, which sort in depth-first order."""
    return F.transform(F.split(path, "-"), lambda s: s.cast("int"))


def ancestor(path: Column, distance: int = 1) -> Column:
    """The node ``distance`` levels above, ``root`` when the path is used up."""
    parts = F.split(path, "-")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - distance, F.lit(0)))
    return F.when(F.size(parts) > distance, F.array_join(kept, "-")).otherwise(ROOT)


def prefixes(path: Column) -> Column:
    """Every proper ancestor of a path, ``root`` first."""
    parts = F.split(path, "-")
    inner = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: n > 0),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"),
    )
    return F.concat(F.array(F.lit(ROOT)), inner)
