"""Document fingerprints: one-permutation MinHash, densified, low-order bits packed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgrove.llm import minhash
from glyphgrove.llm.common import (
    binary_search, distinct_sets, schema_of, shingle_hashes, slices, spread, word_hashes,
)

BINS, BITS, SHINGLE = 512, 4, 5


def sketch(texts: pa.Array, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> np.ndarray:
    """Packed fingerprints of a batch of texts, one row of bytes each.

    A text without words has the all-zero fingerprint.
    """
    parts = [np.zeros((0, bins * bits // 8), np.uint8)]
    for _, part in slices(texts):
        hashes, number = shingle_hashes(*word_hashes(part), shingle)
        minima = minhash.densify(minhash.bin_minima(*distinct_sets(hashes, number), bins))
        low = minhash.per_bin(minima)
        low[number == 0] = 0
        parts.append(minhash.pack_bits(low, bits))
    return np.concatenate(parts)


def has_words(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0, bool)] + [word_hashes(t)[1] > 0 for _, t in slices(texts)])


def compare(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int) -> np.ndarray:
    """Likeness of two columns of fingerprints; two texts without words are alike, one is not."""
    found = minhash.likeness(a, b, bits)
    return np.where(some_a & some_b, found, (some_a == some_b).astype(float))


def fingerprint(
    docs: DataFrame, text: str = "text", out: str = "fingerprint",
    bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE,
) -> DataFrame:
    """Add a binary column ``out`` to ``docs``; a null text counts as empty. No shuffle.

    Shingles are ``shingle`` lower-cased words; a shorter text is one shingle. A column already called
    ``out`` is replaced. An empty table gives an empty table.
    """

    @F.pandas_udf(T.BinaryType())
    def fold(column):
        rows = sketch(pa.array(column, pa.string()), bins, bits, shingle)
        return pd.Series([r.tobytes() for r in rows])

    return docs.withColumn(out, fold(F.col(text)))


def _in_chunks(docs: DataFrame, chunks: int) -> DataFrame:
    """Deal (_key, _text) rows into ranges of the key, each with the first key of the next range.

    Only the bounds and the least key of each range, at most ``chunks`` numbers, reach the driver.
    """
    keys = docs.select("_key")
    shares = [i / chunks for i in range(1, chunks)]
    found = keys.agg(F.percentile_approx("_key", shares, 10_000)).first()[0] or []
    bounds = sorted(set(found))
    chunk = binary_search(F.col("_key"), bounds)
    firsts = sorted(
        (r["_chunk"], r["_first"])
        for r in keys.groupBy(chunk.alias("_chunk")).agg(F.min("_key").alias("_first")).collect()
    )
    # the first key of each range also goes to the range before it, the very first to the last
    also = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    wanted = F.create_map(*[F.lit(x) for pair in also.items() for x in pair]) if also else None
    extra = F.element_at(wanted, F.col("_key")) if also else F.lit(None).cast("int")
    first_of_all = F.col("_key") == F.lit(firsts[0][1] if firsts else None)
    dealt = docs.withColumn(
        "_at",
        F.explode(F.array_compact(F.array(
            F.struct(chunk.alias("chunk"), F.lit(False).alias("guest"), F.lit(False).alias("wraps")),
            F.when(extra.isNotNull(), F.struct(
                extra.alias("chunk"), F.lit(True).alias("guest"), first_of_all.alias("wraps"))),
        ))),
    )
    return dealt.select("_key", "_text", "doc_id", F.col("_at.chunk").alias("_chunk"),
                        F.col("_at.guest").alias("_guest"), F.col("_at.wraps").alias("_wraps"))


def edit_probe(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text",
    bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE,
) -> DataFrame:
    """Fingerprint every text and an edited copy of it, and compare them and the next document.

    The edited copy has its last quarter of code points replaced by the first as many of the next
    document by ascending id; the first document follows the last. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next.

    Null ids sort first. Rows of one id are each fingerprinted; their next document is that of the
    next larger id, and of several rows with that id the one with the least text. A single document
    follows itself. Null texts are empty. Extra columns are ignored; no rows give no rows.

    Each text is shuffled once, into ranges of the id read in descending order, so that a row meets
    its successor in the stream: memory is one batch and one text.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_column), F.lit(-(1 << 63))).cast("long").alias("_key"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    dealt = _in_chunks(rows, spread(docs.sparkSession))
    # the wrapped first document stands for the largest key of the last range
    dealt = (
        dealt.repartition("_chunk")
        .sortWithinPartitions(F.asc("_chunk"), F.desc("_wraps"), F.desc("_key"), F.desc("_text"))
    )
    schema = schema_of(
        ("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()),
        ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()),
        ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()),
    )
    width = bins * bits // 8

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None       # (chunk, wraps, key) of the row before
        ahead = None      # text, fingerprint and has-words of the next document of the current key
        previous = None   # the same of the row before
        for batch in batches:
            for lo, part in slices(batch.column("_text")):
                piece = batch.slice(lo, len(part))
                prints, some = sketch(part, bins, bits, shingle), has_words(part)
                texts = part.to_pylist()
                tags = list(zip(*[piece.column(c).to_pylist() for c in ("_chunk", "_wraps", "_key")],
                                strict=True))
                guest = piece.column("_guest").to_pylist()
                ids, lengths, edited, follower, follows = [], [], [], [], []
                own = []
                for i, tag in enumerate(tags):
                    if last is None or tag[0] != last[0]:
                        ahead = None
                    elif tag != last:
                        ahead = previous
                    last, previous = tag, (texts[i], prints[i], some[i])
                    if guest[i]:
                        continue
                    after = ahead if ahead is not None else previous
                    cut = len(texts[i]) // 4
                    own.append(i)
                    lengths.append(len(texts[i]))
                    edited.append(texts[i][: len(texts[i]) - cut] + after[0][:cut])
                    follower.append(after[1])
                    follows.append(after[2])
                if not own:
                    continue
                own = np.array(own)
                ids = piece.column("doc_id").take(pa.array(own))
                changed = pa.array(edited, pa.string())
                new, new_some = sketch(changed, bins, bits, shingle), has_words(changed)
                near = compare(prints[own], new, some[own], new_some, bits)
                apart = compare(prints[own], np.array(follower, np.uint8).reshape(-1, width),
                                some[own], np.array(follows), bits)
                yield pa.RecordBatch.from_arrays([
                    ids,
                    pa.array(lengths, pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array([p.tobytes().hex() for p in prints[own]], pa.string()),
                    pa.array([p.tobytes().hex() for p in new], pa.string()),
                    pa.array(near, pa.float64()),
                    pa.array(apart, pa.float64()),
                ], names=schema.names)

    return dealt.mapInArrow(work, schema)
