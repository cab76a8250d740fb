"""Per-key Kalman tracking of a scalar measurement in time order.

Model: state (angle, rate), transition [[1, 1], [0, 1]], measurement row [1, 1]. The covariance and
the gain depend on the step number only, never on the data, so every step is a known affine map of
the state. A chunk of a long key is therefore summarised by one 2x2 matrix and one vector, the
chunks are chained on these, and then all chunks are tracked at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgrove.operators.ordered import CHUNK, MAX_GROUP_ROWS, number, order_rows, scan
from glyphgrove.runtime import lookup_join

#: Columns added to each measurement.
OUTPUTS = ["predicted", "angle", "rate", "p00", "p01", "p11"]


@dataclass(frozen=True)
class Model:
    """Noise levels and the initial covariance, all elements of which equal ``initial``."""

    process_noise: float = 1e-5
    measurement_noise: float = 0.1
    initial: float = 1.0


@lru_cache(maxsize=16)
def gain_table(model: Model) -> np.ndarray:
    """Rows ``(k0, k1, p00, p01, p11)`` per step, up to the step from which they stay the same.

    The recursion settles to a value that reproduces itself exactly, or to a short cycle in the last
    digits; in both cases the last row stands for all later steps.
    """
    rows, seen = [], set()
    p00 = p01 = p11 = model.initial
    while (p00, p01, p11) not in seen:
        seen.add((p00, p01, p11))
        a00 = p00 + 2 * p01 + p11 + model.process_noise
        a01 = p01 + p11
        a11 = p11 + model.process_noise
        h0, h1 = a00 + a01, a01 + a11
        s = h0 + h1 + model.measurement_noise
        k0, k1 = h0 / s, h1 / s
        p00, p01, p11 = a00 - k0 * h0, a01 - k0 * h1, a11 - k1 * h1
        rows.append((k0, k1, p00, p01, p11))
    return np.array(rows)


def compose(matrices: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix compositions of the affine maps x -> matrices[t] x + shifts[t], all at once by doubling."""
    matrices, shifts, reach = matrices.copy(), shifts.copy(), 1
    while reach < len(matrices):
        later, earlier = matrices[reach:], matrices[:-reach]
        moved = np.einsum("tij,tj->ti", later, shifts[:-reach]) + shifts[reach:]
        joined = later @ earlier
        shifts[reach:], matrices[reach:] = moved, joined
        reach *= 2
    return matrices, shifts


def step_maps(z: np.ndarray, first_step: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each step (predict, correct with ``z``) as an affine map of the state, and its covariance."""
    steps = table[np.minimum(np.arange(first_step, first_step + len(z)), len(table) - 1)]
    k0, k1 = steps[:, 0], steps[:, 1]
    matrices = np.stack([np.stack([1 - k0, 1 - 2 * k0], 1), np.stack([-k1, 1 - 2 * k1], 1)], 1)
    return matrices, np.stack([k0 * z, k1 * z], 1), steps[:, 2:]


def track(z: np.ndarray, first_step: int, state: tuple[float, float], table: np.ndarray):
    """``OUTPUTS`` of each measurement, and the last state."""
    if not len(z):
        return np.empty((0, len(OUTPUTS))), state
    matrices, shifts, covariance = step_maps(z, first_step, table)
    matrices, shifts = compose(matrices, shifts)
    states = matrices @ np.array(state) + shifts
    before = np.vstack([[state], states[:-1]])
    return np.column_stack([before.sum(axis=1), states, covariance]), tuple(states[-1].tolist())


def kalman_track(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    model: Model = Model(),
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add the step number and, per measurement, the prediction and the corrected state.

    ``(keys, order)`` must identify a row. The filter starts at state 0.
    """
    ordered = number(order_rows(df, keys, order, max_group_rows), "step")
    table = gain_table(model)
    outputs = T.StructType([T.StructField(c, T.DoubleType()) for c in OUTPUTS])

    def follow(run: list[np.ndarray], state: tuple | None) -> tuple[list[np.ndarray], tuple]:
        z, steps, angle, rate = run
        state = (float(angle[0]), float(rate[0])) if state is None else state
        tracked, state = track(z.astype(float), int(steps[0]) - 1, state, table)
        return list(tracked.T), state

    rows = ordered.rows
    if ordered.chunked:
        key_fields = [df.schema[c] for c in keys]
        chunk = T.StructField(CHUNK, T.IntegerType())
        maps = ["m00", "m01", "m10", "m11", "c0", "c1"]

        def summarise(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("step")
            first = int(part["step"].iloc[0]) - 1
            z = part[value].to_numpy(float)
            matrices, shifts = compose(*step_maps(z, first, table)[:2])
            head = part.iloc[[0]][[*keys, CHUNK]].reset_index(drop=True)
            head[maps] = [*matrices[-1].ravel(), *shifts[-1]]
            return head

        def chain(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(CHUNK, ignore_index=True)
            matrices = part[maps[:4]].to_numpy(float).reshape(-1, 2, 2)
            # the filter starts at state 0, so the state after a chunk is the shift of its composition
            _, after = compose(matrices, part[maps[4:]].to_numpy(float))
            out = part[keys].copy()
            out[CHUNK] = part["chunk_no"]
            out[["_angle", "_rate"]] = np.vstack([np.zeros((1, 2)), after[:-1]])
            return out

        doubles = [T.StructField(c, T.DoubleType()) for c in maps]
        summary = rows.select(*ordered.scope, "step", value).groupBy(*ordered.scope).applyInPandas(
            summarise, T.StructType([*key_fields, chunk, *doubles])
        )
        entries = summary.withColumn("chunk_no", F.col(CHUNK)).groupBy(*keys).applyInPandas(
            chain,
            T.StructType(
                [*key_fields, chunk, T.StructField("_angle", T.DoubleType()),
                 T.StructField("_rate", T.DoubleType())]
            ),
        )
        rows = lookup_join(rows, entries, ordered.scope)
    else:
        rows = rows.select("*", F.lit(0.0).alias("_angle"), F.lit(0.0).alias("_rate"))
    inputs = [value, "step", "_angle", "_rate"]
    tracked = scan(rows, ordered.scope, ["step"], inputs, outputs, follow)
    return tracked.select(*df.columns, "step", *OUTPUTS)
