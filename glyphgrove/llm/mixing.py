"""Mixing sources to target weights: blocks, multinomial counts per shard, permuted slots, join by index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgrove.llm.common import free_name, materialise, running_position, schema_of, spread
from glyphgrove.llm.common import mix as scramble
from glyphgrove.operators.ordered import finish, number, order_rows, running
from glyphgrove.runtime import lookup_join

WORD = "[^\\x20\\x09-\\x0D]+"
#: Words per block, slots per output shard, passes over a source at most, size of the mix, the weights
#: that the sources take in turn, and the seed of all draws.
BLOCK, SHARD_SLOTS, PASSES, SHARE, WEIGHTS, SEED = 256, 4096, 2, 1.5, (3.0, 1.0, 2.0), 17

#: Slots that one row of the plan stands for before they are spread.
CHUNK = 1 << 16

_ROUNDS = scramble(np.arange(1, 5, dtype=np.uint64))


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key, computed index by index.

    A four-round Feistel network on the next even number of bits; values beyond ``size`` go round again.
    """
    bits = np.maximum(np.ceil(np.log2(np.maximum(size, 2).astype(float)) / 2).astype(np.uint64), 1)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    rounds = [scramble(key + salt) for salt in _ROUNDS]
    value, todo = index.astype(np.uint64), np.arange(len(index))
    limit = size.astype(np.uint64)
    while len(todo):
        left, right = value[todo] >> bits[todo], value[todo] & mask[todo]
        for k in rounds:
            left, right = right, left ^ (scramble(right ^ k[todo]) & mask[todo])
        value[todo] = (left << bits[todo]) | right
        todo = todo[value[todo] >= limit[todo]]
    return value.astype(np.int64)


def number_rows(docs: DataFrame, name: str = "_row") -> DataFrame:
    """Write ``docs`` once with a row number of their own, so that it never changes again."""
    return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            passes: int = PASSES) -> DataFrame:
    """(source, source_size, target): words each source should give.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` times all words. A target
    stops at ``passes`` times its source; what is over is shared again by weight until none is above. Only
    the level of the water reaches the driver.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = materialise(sizes.withColumn("_last", F.col("source").isNull()), "sources")
    ranked = number(order_rows(sizes, [], ["_last", "source"]), "_n").rows
    weight = F.element_at(F.lit(list(weights)), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = materialise(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    top, level, full = passes * F.col("source_size"), 0.0, -1
    while True:
        over = top <= F.col("weight") * F.lit(level)
        count, taken, free = ranked.agg(
            F.coalesce(F.sum(F.when(over, 1).otherwise(0)), F.lit(0)),
            F.coalesce(F.sum(F.when(over, top).otherwise(0)), F.lit(0)),
            F.coalesce(F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.lit(0.0)),
        ).first()
        if count == full or not free:
            break
        full, level = count, (total - taken) / free
    return ranked.select(
        "source", "source_size", F.least(top.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def _fill(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """(key, blocks, size, slots, last_words): how many slots the mix has for each source.

    Slots run through whole passes of the source and then through the part of one more pass whose words make
    up the target; its last block is cut to fit.
    """
    schema = schema_of(*[(c, T.LongType()) for c in ("key", "blocks", "size", "slots", "last_words")])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, size, target in zip(frame["key"], frame["size"], frame["target"], strict=True):
                key, size, want = int(key), int(size), int(round(target))
                if not size or not want:
                    continue
                blocks = -(-size // block)
                short = size - (blocks - 1) * block
                whole, rest = divmod(want, size)
                slots, last = whole * blocks, 0
                if rest:
                    turn = np.array([key], np.int64).view(np.uint64) + np.uint64(whole + seed)
                    # where the short last block comes in the permuted order
                    q = _position(blocks, turn)
                    if rest <= q * block:
                        more = -(-rest // block)
                        last = rest - (more - 1) * block
                    elif rest <= q * block + short:
                        more, last = q + 1, rest - q * block
                    else:
                        beyond = rest - q * block - short
                        more = q + 1 + -(-beyond // block)
                        last = beyond - (more - q - 2) * block
                    slots += more
                yield pd.DataFrame({
                    "key": [key], "blocks": [blocks], "size": [size], "slots": [slots], "last_words": [last]})

    return sources.mapInPandas(work, schema)


def _position(blocks: int, turn: np.ndarray) -> int:
    """Where the last block stands in the permuted order: the inverse of ``permute``, round by round."""
    size = np.array([blocks])
    bits = max(int(np.ceil(np.log2(max(blocks, 2)) / 2)), 1)
    mask = np.uint64((1 << bits) - 1)
    rounds = [scramble(turn + salt) for salt in _ROUNDS]
    value = np.array([blocks - 1], np.uint64)
    while True:
        left, right = value >> np.uint64(bits), value & mask
        for k in rounds[::-1]:
            left, right = right ^ (scramble(left ^ k) & mask), left
        value = (left << np.uint64(bits)) | right
        if value[0] < size[0]:
            return int(value[0])


def slots(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(key, block, pass, shard, place, slot, words): every slot of the mix, where it goes and the block it shows.

    ``sources`` holds (key, size, target). ``words`` is how many words of the block are taken, ``slot`` the slot's
    number within its source. All slots of all sources, laid one after another, are dealt to the places of the
    mix by one more permutation: shards of ``shard_slots`` places each, the last may be shorter. So the counts of the
    sources in a shard are drawn without replacement from the totals that the targets fix: a multinomial draw per
    shard, conditional on these. Each slot is computed by itself, in chunks, however many a source has.
    """
    filled = materialise(_fill(sources.select("key", "size", "target"), block, seed), "slots")
    laid = finish(running(order_rows(filled, [], ["key"]), {"_upto": F.col("slots")}))
    total = filled.agg(F.sum("slots")).first()[0] or 0
    each = laid.select(
        "key", "blocks", "size", "slots", "last_words", (F.col("_upto") - F.col("slots")).alias("offset"),
        F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK})")).alias("chunk"))
    schema = schema_of(*[(c, T.LongType()) for c in ("key", "block", "pass", "shard", "place", "slot", "words")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                slot = np.arange(r["chunk"] * CHUNK, min(r["slots"], (r["chunk"] + 1) * CHUNK))
                key = np.array([r["key"]], np.int64).view(np.uint64)
                turn = slot // r["blocks"]
                at = permute(slot - turn * r["blocks"], np.full(len(slot), r["blocks"]), key + (turn + seed).astype(np.uint64))
                words = np.minimum(block, r["size"] - at * block)
                if r["last_words"]:
                    words = np.where(slot == r["slots"] - 1, np.minimum(r["last_words"], words), words)
                dealt = permute(slot + r["offset"], np.full(len(slot), total), np.full(len(slot), seed, np.uint64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(slot), r["key"])), pa.array(at), pa.array(turn), pa.array(dealt // shard_slots),
                    pa.array(dealt % shard_slots), pa.array(slot), pa.array(words)], names=schema.names)

    return each.repartition("key", "chunk").mapInArrow(work, schema)


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES,
         block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix of ``rows`` (_row, doc_id, tie, source, size): (sources, taken).

    ``taken`` has a row for each stretch of a document in the mix: (_row, pass, shard, place, slot, first, words),
    ``first`` being the document's word it starts with. A source's documents lie one after another in
    a fixed order and are cut into blocks of ``block`` words; blocks and slots meet by index.
    """
    spark = rows.sparkSession
    sources = targets(rows, weights, share, passes).withColumn(
        "key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    sources = materialise(sources.withColumn("size", F.col("source_size")), "targets")
    keyed = rows.where("size > 0").select(
        "_row", "doc_id", "tie", "size", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("key"))
    # by content alone: row numbers depend on how the input was split
    order = [F.coalesce("doc_id", F.lit(-1)), F.col("tie")]
    laid = running_position(keyed, ["key"], order, F.col("size"), "start", spread(spark))
    cut = laid.select(
        "_row", "key", "start", "size",
        F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    edge = F.col("block") * block
    cut = cut.select(
        "_row", "key", "block",
        (F.greatest(edge, F.col("start")) - edge).alias("_from"),
        (F.least(edge + block, F.col("start") + F.col("size")) - edge).alias("_to"),
        (F.greatest(edge, F.col("start")) - F.col("start")).alias("first"))
    shown = slots(sources, block, shard_slots, seed)
    # Spark takes the slots to be as few as the sources they are drawn for, so say that both sides are large
    taken = cut.join(shown.hint("merge"), ["key", "block"]).withColumn(
        "words", F.least("_to", "words") - F.col("_from")).where("words > 0")
    return sources, taken.select("_row", "pass", "shard", "place", "slot", "first", "words")


def amounts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
            **options) -> DataFrame:
    """Return (doc_id, size, source_size, target, taken), one row per row of ``docs``.

    ``size`` counts words, ``taken`` those the mix takes, repeats counted: at most ``PASSES`` times the
    size. Null texts have no words and nothing is taken. Null is a source of its own, the last. Repeated rows
    and null ids are rows like others. Extra columns are ignored; no rows give no rows. The draws depend on
    seed, source, ids and texts alone, so reruns agree however the input is split.
    """
    narrow = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("tie"))
    rows = number_rows(narrow)
    sources, taken = plan(rows, **options)
    sums = taken.groupBy("_row").agg(F.sum("words").alias("taken"))
    known = lookup_join(
        rows.withColumn("key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())),
        sources.select("key", "source_size", "target"), ["key"],
        table_bytes=64 * sources.count())
    return known.join(sums.hint("merge"), "_row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixture(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
            n_chars: str | None = "n_chars", **options) -> DataFrame:
    """The mix itself as rows like ``docs``: a row per unbroken stretch of a document in a pass.

    A stretch that covers the whole document is the text as it stands, any other runs from its first to its
    last word. ``n_chars`` is set to the new length where the column exists. Documents without words are in
    no block and so in no mix.
    """
    row, held = free_name(docs, "_row"), free_name(docs, "_parts")
    rows = number_rows(docs, row)
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    narrow = rows.select(F.col(row).alias("_row"), F.col(id_column).cast("long").alias("doc_id"),
                         F.col(source).cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("tie"))
    _, taken = plan(narrow, **options)
    # one row per document: its blocks number its size / BLOCK, times the passes
    parts = taken.groupBy(F.col("_row").alias(row)).agg(
        F.sort_array(F.collect_list(F.struct("pass", "first", "words"))).alias(held))
    joined = rows.join(parts.hint("merge"), row).drop(row)
    schema = docs.schema
    length = n_chars if n_chars in schema.names else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            at, out, sizes = [], [], []
            texts = batch.column(text).to_pylist()
            for i, found in enumerate(batch.column(held).to_pylist()):
                runs: list[list[int]] = []
                for p in found:
                    if runs and runs[-1][0] == p["pass"] and runs[-1][2] == p["first"]:
                        runs[-1][2] += p["words"]
                    else:
                        runs.append([p["pass"], p["first"], p["first"] + p["words"]])
                spans = [m.span() for m in word.finditer(texts[i])]
                for _, a, b in runs:
                    whole = a == 0 and b == len(spans)
                    piece = texts[i] if whole else texts[i][spans[a][0] : spans[b - 1][1]]
                    at.append(i)
                    out.append(piece)
                    sizes.append(len(piece))
            rest = batch.take(pa.array(at, pa.int64()))
            changed = {text: pa.array(out, pa.string())}
            if length:
                changed[length] = pa.array(sizes, pa.int64()).cast(rest.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(
                [changed[n] if n in changed else rest.column(n) for n in schema.names], names=schema.names)

    return joined.mapInArrow(work, schema)
