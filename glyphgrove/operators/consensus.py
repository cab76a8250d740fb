"""Consensus filter of match pairs: keep the pairs that one planar model per group explains.

Each trial fits four pairs drawn from the whole group, and all pairs of the group vote on every model, in
blocks; the inlier test of the best model then runs on every pair as a plain column expression. Draws and models are
closed formulas, so the result can be stated in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrove.operators.ordered import number, order_rows
from glyphgrove.runtime import lookup_join, materialise, shuffled

#: Largest distance, in pixels, between a mapped point and its partner.
THRESHOLD = 5.0
TRIALS = 200
#: Pairs that one task tries the models on at once.
BLOCK = 4096
MODEL = [f"h{i}" for i in range(9)]


def _turn(a, b, c):
    """Twice the area of the triangle a, b, c, signed; zero if they lie on a line."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])


def solve_four(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Homographies that map four points each, for arrays of shape (samples, 4, 2), up to scale; (samples, 9).

    The fourth point in terms of the first three gives three factors on either side; the map takes each
    of the three points to its partner, times the quotient of their factors. A sample with three points on
    a line has no model: its row is not finite.
    """
    p, q = [src[:, i].T for i in range(4)], [dst[:, i].T for i in range(4)]

    def factors(e):
        return _turn(e[3], e[1], e[2]), _turn(e[0], e[3], e[2]), _turn(e[0], e[1], e[3]), _turn(e[0], e[1], e[2])

    with np.errstate(divide="ignore", invalid="ignore"):
        fp, fq = factors(p), factors(q)
        # the whole triangle's area on both sides must not vanish either
        flat = (fp[3] == 0) | (fq[3] == 0)
        for f in fq[:3]:
            flat |= f == 0
        scale = [b / a for a, b in zip(fp[:3], fq[:3], strict=True)]
        cross = [
            (p[j][1] - p[k][1], p[k][0] - p[j][0], p[j][0] * p[k][1] - p[k][0] * p[j][1])
            for j, k in ((1, 2), (2, 0), (0, 1))
        ]
        out = [
            scale[0] * point[0] * cross[0][c] + scale[1] * point[1] * cross[1][c] + scale[2] * point[2] * cross[2][c]
            for point in (*[[q[i][axis] for i in range(3)] for axis in (0, 1)], [1.0, 1.0, 1.0])
            for c in range(3)
        ]
    return np.where(flat[:, None], np.nan, np.stack(out, axis=1))


def _errors(models: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Squared distances models x pairs between mapped points and their partners."""
    h = models.T[:, :, None]
    x, y = src.T[:, None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        w = h[6] * x + h[7] * y + h[8]
        gap_x = (h[0] * x + h[1] * y + h[2]) / w - dst[:, 0]
        gap_y = (h[3] * x + h[4] * y + h[5]) / w - dst[:, 1]
        gap = gap_x * gap_x + gap_y * gap_y
    return np.where(np.isfinite(gap), gap, np.inf)


def _error(x: Column, y: Column, u: Column, v: Column) -> Column:
    h = [F.col(c) for c in MODEL]
    w = h[6] * x + h[7] * y + h[8]
    gap_x = (h[0] * x + h[1] * y + h[2]) / w - u
    gap_y = (h[3] * x + h[4] * y + h[5]) / w - v
    return F.when(w != 0, gap_x * gap_x + gap_y * gap_y)


def draw_numbers(trials: int, random_state: int) -> np.ndarray:
    """Four numbers below 2^32 for each trial, from a hash of the trial, the place and ``random_state``."""
    return np.array([
        [int(hashlib.md5(f"{t}:{k}:{random_state}".encode()).hexdigest()[:8], 16) for k in range(4)]
        for t in range(trials)
    ], np.int64)


def draws(n: int, numbers: np.ndarray) -> np.ndarray:
    """Four different row numbers below ``n`` for each trial: one from each quarter of the rows."""
    edges = np.array([n * k // 4 for k in range(5)])
    return edges[:-1] + numbers % np.diff(edges)


def consensus_models(
    pairs: DataFrame,
    key: str,
    identity: list[str],
    threshold: float = THRESHOLD,
    trials: int = TRIALS,
    random_state: int = 0,
) -> DataFrame:
    """``(key, h0..h8)``: per group the model with most inliers among all its pairs.

    ``pairs`` carry ``src_x, src_y, dst_x, dst_y``. Groups of fewer than four pairs have no model. Every
    trial fits four pairs drawn by hash, one from each quarter of the group in the order of ``identity``, and
    every model is tried on every pair; most inliers win, then the first trial. The group is cut into blocks of ``BLOCK`` pairs whose counts are added up, so no task holds more than one block.
    """
    kind = pairs.schema[key].dataType.simpleString()
    slim = pairs.select(key, *identity, "src_x", "src_y", "dst_x", "dst_y").filter(F.col(key).isNotNull())
    rows = number(order_rows(slim, [key], identity), "_i").rows.withColumn("_i", F.col("_i") - 1)
    rows = materialise(rows.select(key, "_i", "src_x", "src_y", "dst_x", "dst_y"), "pairs")
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 4")

    numbers = draw_numbers(trials, random_state)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, n in zip(frame[key], frame["_n"], strict=True):
                picks = draws(int(n), numbers)
                yield pd.DataFrame({
                    key: name, "_trial": np.repeat(np.arange(trials), 4), "_i": picks.ravel()})

    drawn = shuffled(sizes.mapInPandas(draw, f"{key} {kind}, _trial int, _i bigint")).join(rows, [key, "_i"])
    four = drawn.groupBy(key, "_trial").agg(
        F.sort_array(F.collect_list(F.struct("_i", "src_x", "src_y", "dst_x", "dst_y"))).alias("_four"))

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = np.array([
                [[p[c] for c in ("src_x", "src_y", "dst_x", "dst_y")] for p in four_] for four_ in frame["_four"]
            ], float).reshape(-1, 4, 4)
            models = solve_four(points[:, :, :2], points[:, :, 2:])
            good = np.isfinite(models).all(axis=1)
            out = frame.loc[good, [key, "_trial"]].reset_index(drop=True)
            out[MODEL] = models[good]
            yield out

    columns = ", ".join(f"{c} double" for c in MODEL)
    models = materialise(four.mapInPandas(fit, f"{key} {kind}, _trial int, {columns}"), "models")
    blocks = sizes.select(key, F.explode(F.expr(f"sequence(0L, (_n - 1) div {BLOCK})")).alias("_block"))
    tried = shuffled(models).join(blocks, key)
    placed = rows.withColumn("_block", F.expr(f"_i div {BLOCK}"))

    def tally(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if part.empty or own.empty:
            return pd.DataFrame(columns=[key, "_trial", "_inliers"])
        src, dst = part[["src_x", "src_y"]].to_numpy(float), part[["dst_x", "dst_y"]].to_numpy(float)
        counts = (_errors(own[MODEL].to_numpy(float), src, dst) < threshold**2).sum(axis=1)
        return pd.DataFrame({key: own[key], "_trial": own["_trial"], "_inliers": counts})

    counted = placed.groupBy(key, "_block").cogroup(tried.groupBy(key, "_block")).applyInPandas(
        tally, f"{key} {kind}, _trial int, _inliers bigint")
    best = counted.groupBy(key, "_trial").agg(F.sum("_inliers").alias("_inliers")).groupBy(key).agg(
        F.max(F.struct("_inliers", (-F.col("_trial")).alias("_neg"))).alias("_b"))
    best = best.select(key, (-F.col("_b._neg")).alias("_trial"))
    return shuffled(models).join(best, [key, "_trial"]).drop("_trial")


def consensus_filter(
    pairs: DataFrame, key: str, identity: list[str], threshold: float = THRESHOLD, **options
) -> DataFrame:
    """Add ``inlier`` to every pair; false where its group has no model."""
    models = consensus_models(pairs, key, identity, threshold, **options)
    error = _error(F.col("src_x"), F.col("src_y"), F.col("dst_x"), F.col("dst_y"))
    inlier = F.coalesce(error < threshold**2, F.lit(False)).alias("inlier")
    return lookup_join(pairs, models, [key], "left", hot=True).select(*pairs.columns, inlier)


def tracked(filtered: DataFrame, key: str) -> DataFrame:
    """``(key, pairs, tracked)``: pairs and inliers per group."""
    return filtered.groupBy(key).agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(F.col("inlier").cast("int")).alias("tracked")
    )
