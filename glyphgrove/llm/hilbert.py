"""Sharding along a Hilbert curve over several metadata columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgrove.llm.common import binary_search, materialise
from glyphgrove.operators.ordered import finish, order_rows, running
from glyphgrove.runtime import lookup_join

#: Bits per dimension and shards.
BITS, SHARDS = 6, 40


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``cells`` (integers below 2^bits).

    The cells are turned into the curve's transposed index by undoing its rotations bit by bit, then
    Gray-decoded and their bits interleaved. Neighbouring positions differ by one in one dimension.
    """
    x = cells.astype(np.int64).T.copy()
    dims, one = x.shape[0], np.int64(1)
    q = one << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = one << (bits - 1)
    while q > 1:
        turn = np.where(x[dims - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _category_cells(df: DataFrame, column: str, cells: int) -> DataFrame:
    """(column, _cell): cells 1 to ``cells`` - 1 for the values of a column that is no number, in the order of the values.

    A value's cell follows from how many rows hold lesser values, so cells are even in rows and a common value
    leaves cells empty behind it. Values are counted and added up in Spark, however many there are.
    """
    counted = materialise(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n")), "values")
    total = counted.agg(F.sum("_n")).first()[0] or 1
    summed = finish(running(order_rows(counted, [], [column]), {"_upto": F.col("_n")}))
    before = F.col("_upto") - F.col("_n")
    return summed.select(column, (1 + F.floor((cells - 1) * before / total)).cast("int").alias("_cell"))


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> tuple[DataFrame, list[Column]]:
    """``df`` and a number below 2^bits for each of ``dims``: numbers by quantiles, other values by their order.

    All keep their order, equal values share a cell, null is cell 0. The quantiles, at most 2^bits - 1
    numbers a column, are all that reaches the driver; the cells of other values are joined, sent only within the
    broadcast bound.
    """
    cells = 1 << bits
    numbers = [c for c in dims if isinstance(df.schema[c].dataType, T.NumericType)]
    shares = [i / cells for i in range(1, cells)]
    found = df.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in numbers]).first() if numbers else {}
    out = []
    for k, c in enumerate(dims):
        if c in numbers:
            cell = binary_search(F.col(c), sorted(set(found[c] or [])))
        else:
            table = materialise(_category_cells(df, c, cells).withColumnRenamed("_cell", f"_cell{k}"), "cells")
            size = table.agg(F.sum(F.octet_length(F.col(c).cast("string")) + 64)).first()[0] or 0
            df = lookup_join(df, table, [c], "left", table_bytes=2 * size, hot=True)
            cell = F.col(f"_cell{k}")
        out.append(F.when(F.col(c).isNull(), 0).otherwise(cell).cast("int"))
    return df, out


def _curve(bits: int):
    @F.pandas_udf(T.LongType())
    def along(cells: pd.Series) -> pd.Series:
        return pd.Series(curve_index(np.stack(cells.to_numpy()), bits) if len(cells) else [], dtype="int64")

    return along


def ordered_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number all rows from 0 along ``order``: ranges are sorted apart, their sizes added up.

    The ranges are written before they are counted, for their bounds come from a sample.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    written = materialise(sorted_.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_at", 33)
    sizes = written.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = written.withColumn("_part", part).join(F.broadcast(base), "_part")   # a row for each range
    return ranked.withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_base")


def shard(rows: DataFrame, dims: list[str], group: list[str], tie: list[str], shards: int = SHARDS,
          bits: int = BITS) -> DataFrame:
    """Add ``curve``, ``shard`` and ``slot``: runs of equal row counts along the curve.

    Rows are ordered by curve index, then ``group``, then ``tie``. All rows of a group take the place of the
    group's least metadata, so a group lies together and is cut only where a run ends; it may be larger
    than a shard. Shard counts differ by one at most; slots count from 0.
    """
    least = [F.min(F.struct(*dims)).alias("_least")]
    # the group's row in the middle of nowhere is its least metadata: one small row per group
    groups = rows.groupBy(*group).agg(*least).select(*group, *[F.col(f"_least.{d}").alias(f"_m_{d}") for d in dims])
    groups, cells = quantised(groups, [f"_m_{d}" for d in dims], bits)
    placed = groups.select(*group, _curve(bits)(F.array(*cells)).alias("curve"))
    ranked = ordered_rank(rows.join(placed, group), ["curve", *group, *tie], "_rank")
    total = ranked.count()
    number = F.expr(f"_rank * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", number).withColumn("slot", F.col("_rank") - first).drop("_rank")


def shard_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang",
                    source: str = "source", shards: int = SHARDS) -> DataFrame:
    """Return (doc_id, size, text_crc32, law, shard, slot, grown_shard, lang, source, curve), a row per row.

    The curve runs over language, source and text size. ``size`` is the UTF-8 bytes of the text (null: none)
    plus 16. Law ``rows``: shard counts differ by one at most; ``grown_shard`` is null. Equal texts lie side
    by side. Null values are cells of their own; repeated rows follow each other; extra columns are ignored;
    no rows give no rows. Texts are not shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"),
        F.xxhash64(body).alias("_hash"))
    found = shard(rows, ["lang", "source", "size"], ["_hash", "text_crc32"], ["doc_id"], shards)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "lang", "source", "curve")


def manifest(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """What a reader needs to skip shards: rows, bytes, and the least and greatest value of each column."""
    bounds = [b for d in dims for b in (F.min(d).alias(f"least_{d}"), F.max(d).alias(f"most_{d}"))]
    values = [F.sort_array(F.collect_set(d)).alias(f"values_{d}") for d in dims if d in ("lang",)]
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *bounds, *values)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows by slot."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
