"""Helpers shared by the text operators: hashing of words, scratch tables, row numbers."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from glyphgrove.runtime import materialise

#: Bytes of text that one vectorised step handles at once, unless a single text is longer. Hashing takes some 60 times that.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_SIGNS = _WHITE.copy()
_SIGNS[:128] = [not (chr(c).isalnum()) for c in range(128)]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Cut a column of texts into runs of bounded size: (first row, texts). Nulls become empty."""
    texts = pc.fill_null(texts, "")
    sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)] if len(texts) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield a, texts.slice(a, b - a)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words of each text.

    A word is a run of characters other than space and \\t to \\r, with A-Z lower-cased.
    """
    return _tokens(texts, _WHITE)[:2]


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for runs of letters, digits and characters beyond ASCII, so without punctuation.

    Also gives each token's first byte within its text and its length in bytes.
    """
    return _tokens(texts, _SIGNS)


def _tokens(texts: pa.Array, between: np.ndarray) -> tuple[np.ndarray, ...]:
    nothing = np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    n = len(texts)
    if n == 0 or data is None:
        return nothing
    offsets = np.frombuffer(places, wide)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if len(raw) == 0:
        return nothing
    inside = ~between[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[1:] > offsets[:-1]]
    start[heads] = inside[heads]
    kept = np.flatnonzero(inside)
    first = np.flatnonzero(start[kept])
    if len(first) == 0:
        return nothing
    lengths = np.diff(np.append(first, len(kept)))
    at = np.arange(len(kept)) - np.repeat(first, lengths)
    longest = int(lengths.max())
    power = _powers(1 << max(6, math.ceil(math.log2(longest + 1))))
    value = (_LOWER[raw[kept]].astype(np.uint64) + np.uint64(1)) * power[at]
    hashes = mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    before = np.concatenate([[0], np.cumsum(start)])
    counts = before[offsets[1:]] - before[offsets[:-1]]
    return hashes, counts, kept[first] - np.repeat(offsets[:-1], counts), lengths


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word windows of each text and their number per text.

    A text of fewer than ``size`` words has its whole word sequence as its only window, a text
    without words has none.
    """
    ends = np.cumsum(counts)
    starts = ends - counts

    def windows(at: np.ndarray, length: int) -> np.ndarray:
        seed = mix(np.array([length], np.uint64) * np.uint64(0xA0761D6478BD642F))[0]
        value = np.full(len(at), seed, np.uint64)
        for j in range(length):
            value = mix(value * np.uint64(0xE7037ED1A0B428DB) + words[at + j])
        return value

    number = np.maximum(counts - size + 1, 0)
    rest = np.repeat(ends, counts) - np.arange(len(words))
    at = np.flatnonzero(rest >= size)
    short = (counts > 0) & (counts < size)
    if not short.any():
        return windows(at, size), number
    number = number + short
    place = np.cumsum(number) - number
    out = np.zeros(int(number.sum()), np.uint64)
    full = np.ones(len(out), bool)
    full[place[short]] = False
    out[full] = windows(at, size)
    for length in range(1, size):
        rows = np.flatnonzero(counts == length)
        out[place[rows]] = windows(starts[rows], length)
    return out, number


def distinct_sets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text sorted and without repeats, and their number per text."""
    ends = np.cumsum(counts)
    parts = [np.unique(hashes[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else hashes), sizes


def running_position(
    df: DataFrame, keys: list[str], order: list[Column], amount: Column, name: str, chunks: int
) -> DataFrame:
    """Add to each row the sum of ``amount`` over the rows before it within its keys.

    The order within a key is that of (chunk, ``order``), a chunk being a hash of the ordering
    columns: any one order will do for the callers, but the same in every run. A key of any size is
    spread over ``chunks`` windows; only one row per (key, chunk) is combined.
    """
    rows = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    rows = rows.withColumn("_amount", amount)
    by = [*keys, "_chunk"]
    inside = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_inside", F.sum("_amount").over(inside) - F.col("_amount"))
    totals = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    totals = totals.groupBy(*by).agg(F.sum(amount).alias("_total"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(*by, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    # the rows may come from a well compressed file: its size is no bound of theirs, so never send them
    out = rows.hint("merge").join(base, by)
    return out.withColumn(name, F.col("_base") + F.col("_inside")).drop(
        "_chunk", "_amount", "_inside", "_base"
    )


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def spread(spark: SparkSession, factor: int = 4) -> int:
    """Number of pieces a hot group is cut into: grows with the shuffle partitions of the session."""
    return factor * int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary_search(value: Column, bounds: list) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``: a built-in expression."""
    if not bounds:
        return F.lit(0)
    table, steps = F.lit(bounds), []
    step = 1 << (len(bounds).bit_length() - 1)
    while step:
        steps.append(step)
        step >>= 1
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda low, s: F.when(
            (low + s <= len(bounds)) & (F.get(table, low + s - 1) <= value), low + s
        ).otherwise(low),
    )


def schema_of(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns])


__all__ = [
    "SLICE_BYTES", "binary_search", "distinct_sets", "free_name", "materialise", "mix", "read", "running_position",
    "schema_of", "shingle_hashes", "slices", "spread", "token_hashes", "word_hashes",
]
