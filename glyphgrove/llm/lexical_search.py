"""Ranked lexical search: hashed max-sketches bound all scores, exact rescoring by descending bound."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from glyphgrove.llm.common import materialise, schema_of, slices, token_hashes

#: Documents returned for a query.
TOP = 20
#: Cells of a sketch for each distinct term, fewest and most of them. A cell holds a bound in steps of STEP.
CELLS, LEAST, MOST, STEP = 8, 64, 1 << 17, 4000
#: Text of the queries that one pass over the index answers, documents rescored at once, sketch bytes at once.
QUERY_BYTES, RESCORE, SKETCH_BYTES = 4 << 20, 64, 16 << 20
#: Ways the rows of one query are split before the last ranking.
SALTS = 64

INDEX = schema_of(
    ("doc_id", T.LongType()), ("n", T.LongType()), ("terms", T.ArrayType(T.LongType())),
    ("impacts", T.ArrayType(T.IntegerType())), ("sketch", T.BinaryType()),
)


class Index(NamedTuple):
    """A written table of documents, how many hold a term, and how many terms they hold."""

    rows: DataFrame
    documents: int
    terms: int


def cell_count(distinct: np.ndarray) -> np.ndarray:
    """Cells of the sketches: a power of two that grows with the document, so that bounds stay tight."""
    bits = np.ceil(np.log2(np.maximum(distinct * CELLS, 1)))
    return np.clip(2 ** bits, LEAST, MOST).astype(np.int64)


def _cells_of(terms: np.ndarray, cells) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each term: both are no less than its impact, so the lesser one bounds it."""
    last = np.uint64(cells) - np.uint64(1)
    return tuple(((terms >> np.uint64(shift)) & last).astype(np.int64) for shift in (8, 36))


def impacts_of(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m), m being 75 + (25 n N) div L."""
    m = 75 + (25 * n * documents) // max(terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(documents: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


def _counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, terms of each text, distinct terms of each text, the distinct terms, their counts)."""
    for at, part in slices(texts):
        words, n = token_hashes(part)[:2]
        rows = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((words, rows))
        words, rows = words[order], rows[order]
        head = np.ones(len(words), bool)
        head[1:] = (words[1:] != words[:-1]) | (rows[1:] != rows[:-1])
        first = np.flatnonzero(head)
        tf = np.diff(np.append(first, len(words)))
        yield at, n, np.bincount(rows[first], minlength=len(n)), words[first], tf


def build(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> Index:
    """Write the index of ``docs``: per document its terms, their impacts, and a max-sketch of these.

    Terms are runs of letters, digits and characters beyond ASCII, only A-Z lower-cased, kept as 64-bit
    hashes. A document's sketch has cells by the hash of a term, each with the largest impact that falls into
    it, in steps rounded up. Every row is a document, also rows that share an id or have none; a null or empty
    text holds no term and is found by no query. Extra columns are ignored; no rows give an empty index.
    """
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for batch in batches:
            for _, part in slices(batch.column("_text")):
                n = token_hashes(part)[1]
                documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_pydict({"documents": [documents], "terms": [terms]})

    total = narrow.select("_text").mapInArrow(count, "documents long, terms long").agg(
        F.sum("documents"), F.sum("terms")).first()
    documents, terms = total[0] or 0, total[1] or 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, distinct, words, tf in _counts(batch.column("_text")):
                impacts = impacts_of(tf, np.repeat(n, distinct), documents, terms)
                cells = np.where(distinct > 0, cell_count(distinct), 0)
                ends = np.cumsum(cells)
                base, bound = np.repeat(ends - cells, distinct), (-(-impacts // STEP)).astype(np.uint8)
                sketch = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
                for cell in _cells_of(words, np.repeat(np.maximum(cells, 1), distinct)):
                    np.maximum.at(sketch, base + cell, bound)
                places = pa.array(np.concatenate([[0], np.cumsum(distinct)]), pa.int32())
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, len(n)), pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(places, pa.array(words.view(np.int64))),
                    pa.ListArray.from_arrays(places, pa.array(impacts.astype(np.int32))),
                    pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(sketch)]),
                ], names=INDEX.names)

    return Index(materialise(narrow.mapInArrow(work, INDEX), "lexical"), documents, terms)


def _holders(index: Index, vocabulary: np.ndarray) -> dict[int, int]:
    """How many documents hold each of the terms ``vocabulary`` (sorted)."""
    shared = index.rows.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        held = np.zeros(len(wanted), np.int64)
        for batch in batches:
            words = np.asarray(batch.column("terms").flatten()).view(np.uint64)
            at = np.searchsorted(wanted, words)
            at[at == len(wanted)] = 0
            held += np.bincount(at[wanted[at] == words], minlength=len(wanted))
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(held[met])], names=["term", "held"])

    found = index.rows.select("terms").mapInArrow(work, "term long, held long").groupBy("term").agg(F.sum("held").alias("held"))
    return {r["term"]: r["held"] for r in found.collect()}


class _Query(NamedTuple):
    terms: np.ndarray
    weights: np.ndarray


class _Best:
    """The best documents of one query so far: (score, id, place), ids ascending among equal scores, null last."""

    def __init__(self, top: int):
        self.top, self.rows, self.bar = top, [], 1

    def add(self, found: list[tuple[int, int | None]]) -> None:
        self.rows = sorted(self.rows + found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.top]
        if len(self.rows) == self.top:
            self.bar = self.rows[-1][0]


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(cells, rows): documents whose sketches have the same number of cells, within SKETCH_BYTES."""
    for cells in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == cells)
        step = max(1, SKETCH_BYTES // cells)
        for a in range(0, len(rows), step):
            yield cells, rows[a : a + step]


def _exact(rows: np.ndarray, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray, q: _Query) -> np.ndarray:
    """The scores of some documents: their sorted terms are searched for all terms of the query at once."""
    shape = (len(rows), len(q.terms))
    low, high = np.broadcast_to(ends[rows][:, None], shape).copy(), np.broadcast_to(ends[rows + 1][:, None], shape)
    stop, last = high.copy(), len(terms) - 1
    high = high.copy()
    while (low < high).any():
        middle = (low + high) // 2
        less = (terms[np.minimum(middle, last)] < q.terms) & (low < high)
        high = np.where(less, high, middle)
        low = np.where(less, middle + 1, low)
        high = np.maximum(high, low)
    at = np.minimum(low, last)
    met = (low < stop) & (terms[at] == q.terms)
    return (np.where(met, impacts[at], 0) * q.weights).sum(axis=1)


def _search_batch(batch: pa.RecordBatch, queries: list[_Query], best: list[_Best]) -> int:
    """Bring ``best`` up to date with the documents of ``batch``; returns how many pairs were scored exactly."""
    sketches = batch.column("sketch")
    sizes = np.asarray(pc.fill_null(pc.binary_length(sketches), 0), np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(sketches.to_pylist()), np.uint8)
    lists = batch.column("terms")
    ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))])
    terms = np.asarray(lists.flatten()).view(np.uint64)
    impacts = np.asarray(batch.column("impacts").flatten()).astype(np.int64)
    ids = batch.column("doc_id").to_pylist()
    scored = 0
    bounds = np.zeros((len(queries), batch.num_rows))
    for cells, rows in _blocks(sizes):
        table = np.ascontiguousarray(raw[starts[rows][:, None] + np.arange(cells)].T)
        for k, q in enumerate(queries):
            a, b = _cells_of(q.terms, cells)
            # whole numbers below 2^53, so the sum is exact
            bounds[k, rows] = (q.weights * STEP).astype(np.float64) @ np.minimum(table[a], table[b]).astype(np.float64)
    for k, q in enumerate(queries):
        held = best[k]
        todo = np.flatnonzero(bounds[k] >= held.bar)
        todo = todo[np.argsort(-bounds[k][todo], kind="stable")]
        for a in range(0, len(todo), RESCORE):
            part = todo[a : a + RESCORE]
            part = part[bounds[k][part] >= held.bar]
            if not len(part):
                break
            scores = _exact(part, ends, terms, impacts, q)
            scored += len(part)
            held.add([(int(v), ids[row]) for row, v in zip(part.tolist(), scores.tolist(), strict=True) if v >= held.bar])
    return scored


def _query_blocks(queries: DataFrame, id_column: str, text: str) -> Iterator[list[tuple]]:
    """The queries in blocks of bounded text, an order that is the same in every run."""
    rows = queries.select(F.col(id_column).alias("item_id"), F.col(text).cast("string").alias("text"))
    held, size = [], 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += 64 + len(r["text"] or "")
        if size > QUERY_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(index: Index, queries: DataFrame, top: int = TOP, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents with a score above 0 for each row of ``queries``.

    A document's score adds, over the terms of the query with their repeats, weight times impact. Each batch
    of documents looks up all queries in its sketches: the cell of a term is no less than its impact, so the
    sum is an upper bound of the score. Documents are then scored exactly by descending bound until the
    next bound is below the worst of the best so far. Each task hands on at most ``top`` rows for a query.

    Equal scores rank by ascending doc_id, null last, then arbitrarily; ranks are unique. Queries with equal ids are answered each by
    itself; one without a known term, empty or null, has no rows. Queries are taken in blocks of 4 MB of
    text, one pass over the index for each. No queries or no documents give no rows.
    """
    spark = index.rows.sparkSession
    kind = queries.schema[id_column].dataType
    schema = schema_of(("item_id", kind), ("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType()))
    out = None
    for block in _query_blocks(queries, id_column, text):
        one = _search_block(index, block, top, kind)
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], schema) if out is None else out


def _search_block(index: Index, block: list[tuple], top: int, kind: T.DataType) -> DataFrame:
    spark = index.rows.sparkSession
    words, n = token_hashes(pa.array([t or "" for _, t in block], pa.string()))[:2]
    vocabulary = np.unique(words)
    held = _holders(index, vocabulary) if len(vocabulary) else {}
    weights = np.array([weight(index.documents, held[i]) if i in held else 0 for i in range(len(vocabulary))], np.int64)
    known = np.array([i in held for i in range(len(vocabulary))], bool)
    made, start = [], 0
    for size in n.tolist():
        own, times = np.unique(words[start : start + size], return_counts=True)
        start += size
        at = np.searchsorted(vocabulary, own)
        use = known[at]
        made.append(_Query(own[use], (weights[at] * times)[use]))
    shared = spark.sparkContext.broadcast(made)
    schema = "query int, doc_id long, score long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(top) for _ in shared.value]
        for batch in batches:
            if batch.num_rows:
                _search_batch(batch, shared.value, best)
        rows = [(k, i, s) for k, b in enumerate(best) for s, i in b.rows]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int64())], names=["query", "doc_id", "score"])

    found = index.rows.select("doc_id", "terms", "impacts", "sketch").mapInArrow(work, schema)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    some = W.partitionBy("query", "_salt").orderBy(*order)
    few = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).withColumn(
        "rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)
    names = spark.createDataFrame(
        [(k, item) for k, (item, _) in enumerate(block)],
        T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", kind)]))
    # at most one block of queries
    return ranked.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY doc_id, t),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS d, sum(n)::BIGINT AS l FROM lengths),
weights AS (
  SELECT t, floor(1000 * ln((2 * d + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, totals GROUP BY t, d),
asked AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY item_id, t),
scored AS (
  SELECT item_id, tf.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * d) // l))))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN weights USING (t) JOIN lengths ON lengths.doc_id = tf.doc_id, totals
  GROUP BY item_id, tf.doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
