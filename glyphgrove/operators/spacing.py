"""Greedy picks along an order: take the first row, then the next one more than ``gap`` further.

Key frames (frames since the last insert) and temporal islands (time since the island start) are
both this rule. It is sequential, yet a long key need not be walked in one task: a chunk is entered
by at most the rows within ``gap`` of its first row, so each chunk reports where the walk leaves it
for every such entry, these short tables are chained, and then all chunks are walked at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgrove.operators.ordered import CHUNK, MAX_GROUP_ROWS, order_rows, scan
from glyphgrove.runtime import lookup_join, materialise


def _anchors(at: np.ndarray, last: int | None, gap: int) -> np.ndarray:
    """Latest pick at or before each position; ``last`` (or -1 before any pick) until the first."""
    anchors = np.full(len(at), -1 if last is None else last, dtype=np.int64)
    i = 0 if last is None else int(np.searchsorted(at, last + gap, side="right"))
    while i < len(at):
        nxt = int(np.searchsorted(at, at[i] + gap, side="right"))
        anchors[i:nxt] = at[i]
        i = nxt
    return anchors


def _exits(at: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Possible first picks of a chunk and the last pick that follows from each."""
    after = np.searchsorted(at, at + gap, side="right")
    jump = np.where(after < len(at), after, np.arange(len(at)))
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    entries = min(len(at), int(np.searchsorted(at, at[0] + gap, side="right")) + 1)
    return at[:entries], at[jump[:entries]]


def _hops(exits: DataFrame, keys: list[str], gap: int, opening: int) -> DataFrame:
    """``(keys, chunk, _entry)``: the last pick before each chunk, for tables of exits too long for one task.

    That happens where very many rows lie within one gap. All keys hop together: each round finds, per key, the
    first entry beyond the last pick, whose exit is the last pick of its chunk. So there are as many rounds as a key
    has chunks with picks, each an aggregate, and the only tables per key have a row for each chunk.
    """
    last = exits.select(*keys).distinct().withColumn("last", F.lit(opening).cast("bigint"))
    hops: list[DataFrame] = []
    first = True
    while True:
        beyond = F.lit(True) if first and opening < 0 else F.col("entry") > F.col("last") + gap
        ahead = lookup_join(exits, last, keys, hot=True) if keys else exits.join(F.broadcast(last))
        hop = materialise(
            ahead.filter(beyond).groupBy(*keys).agg(F.min(F.struct(CHUNK, "entry", "exit")).alias("h"))
            .filter("h is not null").select(*keys, F.col(f"h.{CHUNK}").alias(CHUNK), F.col("h.exit").alias("exit")),
            "hops",
        )
        if hop.isEmpty():
            break
        hops.append(hop)
        last, first = hop.select(*keys, F.col("exit").alias("last")), False
    chunks = exits.select(*keys, CHUNK).distinct()
    # the round that finds nothing adds no rows
    left = hop
    for one in hops:
        left = left.unionByName(one)
    known = chunks.join(left, [*keys, CHUNK], "left")
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    return known.select(
        *keys, CHUNK, F.coalesce(F.last("exit", ignorenulls=True).over(before), F.lit(opening).cast("bigint")).alias("_entry"))


def spaced_picks(
    df: DataFrame,
    keys: list[str],
    position: str,
    gap: int,
    start: int | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add ``anchor``: the position of the latest pick, so that a pick has ``anchor = position``.

    ``position`` is a non-negative BIGINT, unique within the key. Without ``start`` the first row of
    a key is a pick; with it, the walk behaves as if the last pick were at ``start``. Rows before
    any pick have a null anchor.
    """
    ordered = order_rows(df, keys, [position], max_group_rows)
    opening = -1 if start is None else start

    def walk(run: list[np.ndarray], last: int | None) -> tuple[list[np.ndarray], int]:
        at, entry = run
        last = int(entry[0]) if last is None else last
        anchors = _anchors(at, None if last < 0 else last, gap)
        return [anchors], int(anchors[-1])

    def marked(entered: DataFrame) -> DataFrame:
        out = T.StructType([T.StructField("_anchor", T.LongType())])
        rows = scan(entered, ordered.scope, [position], [position, "_entry"], out, walk)
        # before the first pick there is no anchor
        anchor = F.when(F.col("_anchor") > opening, F.col("_anchor")).alias("anchor")
        return rows.select(*df.columns, anchor)

    if not ordered.chunked:
        return marked(ordered.rows.withColumn("_entry", F.lit(opening).cast("bigint")))

    key_fields = [df.schema[c] for c in keys]
    chunk = T.StructField(CHUNK, T.IntegerType())
    exits_schema = T.StructType(
        [*key_fields, chunk, T.StructField("entry", T.LongType()), T.StructField("exit", T.LongType())]
    )

    def leave(rows: pd.DataFrame) -> pd.DataFrame:
        entry, leaving = _exits(np.sort(rows[position].to_numpy(np.int64)), gap)
        head = rows.iloc[[0]][[*keys, CHUNK]]
        return pd.concat([head] * len(entry), ignore_index=True).assign(entry=entry, exit=leaving)

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        out, last = [], opening
        for number, part in rows.sort_values([CHUNK, "entry"]).groupby(CHUNK):
            out.append((number, last))
            entry = part["entry"].to_numpy()
            i = 0 if last < 0 else int(np.searchsorted(entry, last + gap, side="right"))
            if i < len(entry):
                last = int(part["exit"].iloc[i])
        head = rows.iloc[[0]][keys]
        frame = pd.DataFrame(out, columns=[CHUNK, "_entry"])
        return pd.concat([head] * len(out), ignore_index=True).join(frame)

    # rows up to the start can never be picked; without them every chunk lies behind its entry
    slim = ordered.rows.select(*ordered.scope, position).filter(F.col(position) > opening)
    exits = materialise(slim.groupBy(*ordered.scope).applyInPandas(leave, exits_schema), "exits")
    longest = exits.groupBy(*keys).count().agg(F.max("count")).first()[0] if keys else exits.count()
    if (longest or 0) > max_group_rows:
        entries = _hops(exits, keys, gap, opening)
    else:
        entries = exits.groupBy(*keys).applyInPandas(
            chain, T.StructType([*key_fields, chunk, T.StructField("_entry", T.LongType())])
        )
    entered = lookup_join(ordered.rows, entries, ordered.scope, "left").withColumn(
        "_entry", F.coalesce("_entry", F.lit(opening).cast("bigint"))
    )
    return marked(entered)
