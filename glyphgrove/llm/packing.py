"""Packing token pieces into sequences: bin completion with branch and bound over a length histogram."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from glyphgrove.llm.common import materialise, schema_of, slices
from glyphgrove.runtime import lookup_join

CAPACITY, END = 1024, 2
#: Choices the search may try beyond a first descent, and fillings it weighs per bin.
NODES, WIDTH = 2_000, 4


# ---- tokens -------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def _encoders(vocabulary: str, ranks: str | None):
    """The tokenizer of ``vocabulary`` and, where its merge ranks are given, a faster form of the same."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    if ranks is None:
        return slow, None, ()
    with open(public_tokenizers.path(ranks), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = tuple(t.content for t in slow.get_added_tokens_decoder().values())
    return slow, fast, special


#: Last code point for which both libraries are known to class characters alike (up to Cyrillic), and the
#: longest text without white space that goes through the faster form.
_PLAIN = 0x052F


def encode(texts: list[str], vocabulary: str, ranks: str | None) -> list[np.ndarray]:
    """Token ids as ``tokenizers`` gives them, without special tokens added.

    Texts of common alphabets go through the merge ranks of the same vocabulary, which give the same ids
    several times faster; texts that hold a special token's string or rarer characters go through
    ``tokenizers`` itself.
    """
    slow, fast, special = _encoders(vocabulary, ranks)
    out: list[np.ndarray] = []
    for text in texts:
        plain = fast is not None and (text.isascii() or max(text) <= chr(_PLAIN)) and not any(
            s in text for s in special)
        ids = fast.encode_ordinary(text) if plain else slow.encode(text, add_special_tokens=False).ids
        out.append(np.array(ids, np.uint32))
    return out


def pieces(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end: int = END, vocabulary: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken",
    keep_ids: bool = False,
) -> DataFrame:
    """Cut each document's ids (``end`` appended) into (doc_id, piece, start, length, ids_crc32, part, rank[, ids]).

    Only a document longer than ``capacity`` is cut: into pieces of ``capacity``, the first of which takes
    what is left over. A null or empty text has the one id ``end``. ``rank`` numbers the pieces of each length
    within the task ``part`` that cut them; both are fixed once the pieces are written.
    """
    columns = [
        ("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()),
        ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("rank", T.LongType()),
    ]
    if keep_ids:
        columns.append(("ids", T.ArrayType(T.IntegerType())))
    schema = schema_of(*columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, met = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for at, part in slices(batch.column("_text")):
                rows: list[tuple] = []
                runs: list[np.ndarray] = []
                names = batch.column("doc_id").slice(at, len(part)).to_pylist()
                for name, ids in zip(names, encode(part.to_pylist(), vocabulary, ranks), strict=True):
                    ids = np.append(ids, np.uint32(end))
                    cut = len(ids) % capacity or capacity
                    for k, stop in enumerate(range(cut, len(ids) + 1, capacity)):
                        start = max(0, stop - capacity) if k else 0
                        run = ids[start:stop]
                        rows.append((name, k, start, len(run), zlib.crc32(run.astype("<u4").tobytes()), task, met[len(run)]))
                        met[len(run)] += 1
                        if keep_ids:
                            runs.append(run)
                made = [pa.array([r[i] for r in rows], kind) for i, kind in
                        enumerate([pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()])]
                if keep_ids:
                    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                    flat = np.concatenate([np.zeros(0, np.uint32), *runs]).astype(np.int32)
                    made.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return narrow.mapInArrow(work, schema)


# ---- the search over lengths --------------------------------------------------------------------


@dataclass
class Pattern:
    """``times`` sequences that hold the same lengths, longest first: [(length, how many)]."""

    items: list[tuple[int, int]]
    times: int


@dataclass
class _State:
    counts: np.ndarray
    waste: int = 0
    patterns: list[Pattern] = field(default_factory=list)


def best_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, many equal sequences at a time: the first solution of the search."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out: list[Pattern] = []
    for head in range(capacity, 0, -1):
        while counts[head]:
            need, room = {head: 1}, capacity - head
            while room:
                there = np.flatnonzero(counts[: room + 1])
                there = [x for x in there[::-1] if counts[x] > need.get(int(x), 0)]
                if not there:
                    break
                need[int(there[0])] = need.get(int(there[0]), 0) + 1
                room -= int(there[0])
            times = int(min(counts[x] // n for x, n in need.items()))
            for x, n in need.items():
                counts[x] -= n * times
            out.append(Pattern(sorted(need.items(), reverse=True), times))
    return out


def _closest(room: int, counts: np.ndarray, width: int) -> list[tuple[int, ...]]:
    """The longest single length that fits, and the pairs that fill ``room`` better than it."""
    there = np.flatnonzero(counts[: room + 1])
    last = np.zeros(room + 1, np.int64)      # the longest length at hand up to each room
    last[there] = there
    last = np.maximum.accumulate(last)
    single = int(last[room])
    found: list[tuple[int, ...]] = [(single,)]
    if single < room:
        second = np.minimum(last[room - there], there)
        alone = (second == there) & (counts[there] < 2)
        second = np.where(alone, last[there - 1], second)
        total = there + second
        good = np.flatnonzero((second > 0) & (total > single))
        order = good[np.lexsort((-there[good], -total[good]))][:width]
        found += [(int(there[i]), int(second[i])) for i in order]
    return found


def fillings(room: int, counts: np.ndarray, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Up to ``width`` undominated ways to fill ``room`` from the lengths at hand, least waste first.

    A single length is dominated by a longer one; a pair by a single length that holds both; three
    lengths by a pair as full. What is then left over is filled again by the same rule.
    """
    there = np.flatnonzero(counts[1 : room + 1]) + 1 if room > 0 else np.zeros(0, np.int64)
    if len(there) == 0:
        return [()]
    found = _closest(room, counts, 2 * width)
    best = max(sum(f) for f in found)
    if best < room:
        for x in there[::-1][: 4 * width].tolist():
            counts[x] -= 1
            rest = there[(there <= room - x) & (counts[there] > 0)]
            if len(rest):
                pair = max(_closest(room - x, counts, 1), key=sum)
                if len(pair) == 2 and x >= pair[0] and x + sum(pair) > best:
                    found.append((x, *pair))
            counts[x] += 1
    found.sort(key=lambda f: (-sum(f), len(f), tuple(-x for x in f)))
    out = []
    for f in found[:width]:
        left = room - sum(f)
        if left >= there[0]:
            for x in f:
                counts[x] -= 1
            more = fillings(left, counts, 1)[0]
            for x in f:
                counts[x] += 1
            f = (*f, *more)
        out.append(f)
    out.sort(key=lambda f: (-sum(f), len(f), tuple(-x for x in f)))
    return out


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: for each limit, long pieces that exclude each other, and what the
    middling ones need beyond the room these leave."""
    length = np.arange(capacity + 1)
    best = 0
    for limit in range(capacity // 2 + 1):
        long = length > capacity - limit
        half = (length > capacity / 2) & ~long
        rest = (length >= limit) & (length <= capacity / 2)
        apart = int(counts[half].sum())
        over = int((counts * length)[rest].sum()) - (apart * capacity - int((counts * length)[half].sum()))
        best = max(best, int(counts[long].sum()) + apart + max(0, -(-over // capacity)))
    return best


def bin_completion(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Pack ``histogram`` (length: count) into as few sequences of ``capacity`` as the search finds.

    The longest length left opens a sequence, its undominated fillings are tried least waste first, and
    a filling is repeated for as many sequences as its lengths allow. A branch ends when its waste shows
    that it cannot beat the best solution so far, which starts as best-fit decreasing. The search ends
    when ``lower_bound`` is met, or after ``nodes`` choices beyond a descent or two.
    """
    histogram = {int(k): int(v) for k, v in histogram.items() if v}
    if not histogram:
        return []
    total = sum(k * v for k, v in histogram.items())
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    bound = lower_bound(counts, capacity)
    best = best_fit(histogram, capacity)
    fewest = sum(p.times for p in best)
    stack, tried = [_State(counts)], 0
    while stack and fewest > bound and tried < nodes + 2 * capacity:
        state = stack.pop()
        tried += 1
        # fewer sequences than the best means at most this much waste in all
        if state.waste > (fewest - 1) * capacity - total:
            continue
        left = np.flatnonzero(state.counts)
        if len(left) == 0:
            fewest, best = sum(p.times for p in state.patterns), state.patterns
            continue
        head = int(left[-1])
        state.counts[head] -= 1
        options = fillings(capacity - head, state.counts)
        state.counts[head] += 1
        grown = []
        for filling in options:
            need: dict[int, int] = {head: 1}
            for x in filling:
                need[x] = need.get(x, 0) + 1
            times = int(min(state.counts[x] // n for x, n in need.items()))
            if times < 1:
                continue
            after = state.counts.copy()
            for x, n in need.items():
                after[x] -= n * times
            waste = state.waste + times * (capacity - sum(x * n for x, n in need.items()))
            grown.append(_State(after, waste, [*state.patterns, Pattern(sorted(need.items(), reverse=True), times)]))
        # the least waste is tried first; the stack is as deep as there are steps, WIDTH wide
        stack += grown[::-1]
    return best


# ---- places -------------------------------------------------------------------------------------


def _segments(patterns: list[Pattern], first: int) -> tuple[np.ndarray, ...]:
    """Where the pieces of each length go, by their number among the pieces of that length."""
    used: dict[int, int] = {}
    rows = []
    for p in patterns:
        offset = 0
        for length, n in p.items:
            start = used.get(length, 0)
            rows.append((length, start, n, first, offset))
            used[length] = start + n * p.times
            offset += n * length
        first += p.times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return tuple(table.T)


def place(cut: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces, in place of part and rank.

    The search sees only how many pieces there are of each length, at most ``capacity`` numbers whatever
    the input; equal lengths are interchangeable, so a piece's number among those of its length says which
    sequence it joins: its rank in its part, behind those of the parts before. The table of these bases has a row
    per length and part at most; within the broadcast bound the pieces are not shuffled. Full pieces are sequences of their own.
    """
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = materialise(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_base", F.coalesce(F.sum("_n").over(before), F.lit(0))), "bases")
    ranked = lookup_join(
        cut, bases.select("length", "part", "_base"), ["length", "part"], table_bytes=64 * bases.count())
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("rank")).drop("_base", "part", "rank")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    lengths, starts, each, first, offsets = _segments(bin_completion(histogram, capacity, nodes), full)
    shift = 1 << 48
    keys = lengths * shift + starts
    schema = T.StructType([
        *[f for f in ranked.schema.fields if f.name != "_rank"],
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column("length"), np.int64)
            rank = np.asarray(batch.column("_rank"), np.int64)
            sequence, offset = rank.copy(), np.zeros(len(rank), np.int64)
            part = np.flatnonzero(length < capacity)
            if len(part):
                at = np.searchsorted(keys, length[part] * shift + rank[part], "right") - 1
                inside = rank[part] - starts[at]
                sequence[part] = first[at] + inside // each[at]
                offset[part] = offsets[at] + inside % each[at] * length[part]
            held = [batch.column(n) for n in schema.names[:-2]]
            yield pa.RecordBatch.from_arrays([*held, pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(work, schema)


def pack(docs: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end: int = END, vocabulary: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken",
         keep_ids: bool = False) -> DataFrame:
    """Return (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one row per piece.

    Null and empty texts are the single id ``end``. Repeated rows and null ids are packed like any others;
    equal rows are interchangeable. Extra columns are ignored; no rows give no rows. Texts are encoded once;
    neither they nor their ids are shuffled.
    """
    cut = materialise(
        pieces(docs, id_column, text, capacity, end, vocabulary, ranks, keep_ids), "pieces")
    return place(cut, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, pieces): whole sequences from pieces packed with ``keep_ids``.

    ``pieces`` lists (doc_id, piece, start, length) in order; a sequence is bounded by its capacity.
    """
    part = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return rows.select(
        "sequence_id",
        F.flatten(F.col("parts.ids")).alias("ids"),
        F.transform("parts", lambda p: F.struct(
            p["doc_id"].alias("doc_id"), p["piece"].alias("piece"),
            p["start"].alias("start"), p["length"].alias("length"))).alias("pieces"),
    )
