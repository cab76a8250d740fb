"""Periodic runs of words: overlapping tiles per period octave, boundary Z-functions, stitched fragments."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from glyphgrove.llm.common import free_name, materialise, schema_of, slices

#: A run spans so many words and so many of its periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Octaves below this one (periods under 2^4) take one mask of equal words per period.
SMALL_OCTAVE = 4
#: Words of a tile's core. Up to the octave FIRST all periods share tiles; from there each octave has its own,
#: of STRETCH of its shortest periods at least.
CORE, FIRST, STRETCH = 1 << 14, 11, 16
#: Texts of at most so many characters have no more than CORE words: they are solved where they are read.
LONG_CHARS = 2 * CORE
#: Words of short texts that are solved at once.
TOGETHER = 1 << 18

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
RUNS = T.ArrayType(RUN)


def least_length(period):
    return np.maximum(LEAST_WORDS, LEAST_PERIODS * np.asarray(period))


def z_function(s: list) -> list[int]:
    """For each i the length of the longest prefix that ``s`` shares with itself from i on."""
    n = len(s)
    z = [0] * n
    z[:1] = [n] if n else []
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def _prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def _extent(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around the square at ``at`` that keeps ``period``: [start, end)."""
    low, step = at, 64
    while low > 0:
        a = max(0, low - step)
        bad = np.flatnonzero(words[a:low] != words[a + period : low + period])
        if len(bad):
            low = a + int(bad[-1]) + 1
            break
        low, step = a, step * 2
    high, step, n = at + period, 64, len(words)
    while high < n:
        b = min(n, high + step)
        bad = np.flatnonzero(words[high:b] != words[high - period : b - period])
        if len(bad):
            high += int(bad[0])
            break
        high, step = b, step * 2
    return low, high


def _small_periods(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all stretches with a smallest period below 2^SMALL_OCTAVE, long enough or cut."""
    out, n = [], len(words)
    for q in range(1, min(1 << SMALL_OCTAVE, n)):
        # the Z-values of all boundaries at once: how long words equal those q further
        equal = np.flatnonzero(words[:-q] == words[q:])
        first = np.flatnonzero(np.diff(equal, prepend=-2) != 1)
        start, same = equal[first], np.diff(np.append(first, len(equal)))
        long = np.flatnonzero(same >= max(LEAST_WORDS, LEAST_PERIODS * q) - q)
        for a, k in zip(start[long].tolist(), same[long].tolist(), strict=True):
            root = words[a : a + q]
            if not any(np.array_equal(root[d:], root[: q - d]) for d in {q // p for p in _prime_factors(q)}):
                out.append((a, a + k + q, q))
    return out


def _octave(words: np.ndarray, octave: int, covered: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs with a smallest period in [2^octave, 2^(octave + 1)).

    Boundaries stand every B = 2^octave words. A run of four periods q holds a boundary c with a period
    before it and two after it; so the word at c, and any around it, must equal the one q further. A few such words are
    compared for all boundaries and periods at once. What is left is settled by the Z-functions forward and
    backward from the boundary. Two periods of one octave at one boundary have a common shorter one.
    ``covered``: stretches of a known shorter period; no run of this octave has its boundary well inside.
    """
    size = 1 << octave
    rows = len(words) // size
    if rows < 3:
        return []
    grid = words[: rows * size].reshape(rows, size)
    # row i + 1, column r: the word B + r behind boundary i
    equal = grid[1:] == grid[:-1, :1]
    skip = np.zeros(rows + 1, np.int64)
    for a, b in covered:
        first, last = -(-(a + 2 * size) // size), (b - 4 * size) // size
        if last >= first:
            skip[first] += 1
            skip[min(last + 1, rows)] -= 1
    equal[np.cumsum(skip)[: rows - 1] > 0] = False
    pairs = np.flatnonzero(equal)
    at, period = pairs // size * size, pairs % size + size
    inside = (at >= period) & (at + 2 * period <= len(words))
    at, period = at[inside], period[inside]
    around = (1, -1, 2, -size // 2, size // 2, size - 1, -size, 3, 5, -3, 7, size // 3, -size // 3, size // 5)
    for step in (k for k in around if -size <= k < size):
        same = words[at + step] == words[at + step + period]
        at, period = at[same], period[same]
    out: list[tuple[int, int, int]] = []
    done: dict[int, None] = {}
    for c in np.unique(at).tolist():
        if c in done:
            continue
        forward = z_function(words[c : c + 4 * size].tolist())
        back = words[max(0, c - 2 * size) : c][::-1].tolist()
        around = words[max(0, c - 2 * size) : c + 2 * size][::-1].tolist()
        ahead = len(around) - len(back)
        backward = z_function([*back, -1, *around])[len(back) + 1 :]
        fits = [
            q for q in period[np.searchsorted(at, c, "left") : np.searchsorted(at, c, "right")].tolist()
            if forward[q] >= q and q <= ahead and backward[ahead - q] >= q
        ]
        if not fits:
            continue
        q = fits[0]
        primitive = len(fits) == 1 and not any(forward[d] >= q - d for d in {q // p for p in _prime_factors(q)})
        if primitive or len(fits) == 1:
            a, b = _extent(words, c, q)
            if primitive:
                out.append((a, b, q))
            reach = range(-(-(a + q) // size) * size, b - 2 * q + 1, size)
        else:
            a, b = _extent(words, c, math.gcd(*fits))
            reach = range(-(-(a + 2 * size) // size) * size, b - 4 * size + 1, size)
        done.update(dict.fromkeys(reach))
    return out


def solve(words: np.ndarray, octaves: range) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of ``words`` with a smallest period in the given octaves.

    Stretches of a tile that reach its edge are cut there; they still hold four periods around a boundary or, for
    the smallest periods, the least length.
    """
    out: list[tuple[int, int, int]] = []
    if octaves.start == 0:
        out += _small_periods(words)
    for octave in range(max(octaves.start, SMALL_OCTAVE), octaves.stop):
        if 3 << octave > len(words):
            break
        wide = [(a, b) for a, b, _ in out if b - a >= 6 << octave]
        out += _octave(words, octave, wide)
    return out


def _split(text: str | None) -> list[bytes]:
    """The words of a text: bytes are split at exactly space and \\t to \\r."""
    return (text or "").encode().split()


def _coded(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal exactly where the words are."""
    codes = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(codes.__getitem__, words), np.int32, len(words))


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words outside all runs or in the first period of those that hold them, joined by a space."""
    if not runs:
        return b" ".join(words).decode()
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k]).decode()


def _rows(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of those (start, end, period) that are long enough, by start, then period."""
    return sorted((a, b - a, q) for a, b, q in found if b - a >= max(LEAST_WORDS, LEAST_PERIODS * q))


def parts_of(batches: Iterator[pa.RecordBatch], text: str | int) -> Iterator[pa.RecordBatch]:
    """The same rows, some 2 MB of text at once: words as objects take ten times that."""
    for batch in batches:
        for at, part in slices(batch.column(text)):
            yield batch.slice(at, len(part))


def _answers(batch: pa.RecordBatch, text: str, words: list[list[bytes]], runs: list[list[tuple]], schema: T.StructType):
    listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs],
                      pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])))
    made = [pa.array([len(w) for w in words], pa.int64()), listed,
            pa.array([_kept(w, r) for w, r in zip(words, runs, strict=True)], pa.string())]
    return pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in schema[:-3]], *made], names=schema.names)


def _solve_short(text: str, schema: T.StructType):
    """Solve whole texts where they are read, many at once, a word of its own between any two."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, text):
            words = [_split(v) for v in batch.column(text).to_pylist()]
            runs: list[list[tuple]] = [[] for _ in words]
            group, size = [], 0
            for k, own in enumerate(words):
                if len(own) >= LEAST_WORDS:
                    group.append(k)
                    size += len(own) + 1
                if group and (size > TOGETHER or k + 1 == len(words)):
                    _solve_group(words, group, runs)
                    group, size = [], 0
            if group:
                _solve_group(words, group, runs)
            yield _answers(batch, text, words, [sorted(r) for r in runs], schema)

    return work


def _solve_group(words: list[list[bytes]], group: list[int], runs: list[list[tuple]]) -> None:
    parts, starts, place = [], [], 0
    for k in group:
        starts.append(place)
        # no word equals a mark, and no mark another
        parts += [_coded(words[k]), np.array([-2 - len(parts)], np.int32)]
        place += len(words[k]) + 1
    longest = max(len(words[k]) for k in group)
    found = _rows(solve(np.concatenate(parts), range(0, max(1, (longest // LEAST_PERIODS).bit_length()))))
    at = np.searchsorted(starts, [a for a, _, _ in found], "right") - 1
    for (a, length, q), i in zip(found, at.tolist(), strict=True):
        runs[group[i]].append((a - starts[i], length, q))


def tile_plan(n: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first octave, last octave + 1, core start, tile start, tile end) of all tiles of a text of ``n`` words.

    A core is followed by four longest periods and a word, and preceded by three, so that either a
    neighbour finds a run as well, or the tile itself sees the word that ends it.
    """
    top = max(1, (n // LEAST_PERIODS).bit_length())
    bands = [(0, min(FIRST, top))] + [(k, k + 1) for k in range(FIRST, top)]
    for low, high in bands:
        core, margin = _core(high), 1 << (high - 1)
        for start in range(0, max(n, 1), core):
            yield low, high, start, max(0, start - 6 * margin), min(n, start + core + 8 * margin + 1)


def _core(high: int) -> int:
    return max(CORE, STRETCH << (high - 1))


_TILE = schema_of(("key", T.StringType()), ("n", T.LongType()), ("low", T.IntegerType()), ("high", T.IntegerType()),
                  ("core", T.LongType()), ("start", T.LongType()), ("words", T.BinaryType()))
_FRAGMENT = schema_of(("key", T.StringType()), ("period", T.LongType()), ("start", T.LongType()), ("end", T.LongType()),
                      ("first", T.BooleanType()), ("last", T.BooleanType()), ("whole", T.BooleanType()))


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut each text into the tiles of all octaves, a tile a row."""
    for batch in parts_of(batches, 1):
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes = _coded(_split(value))
            for low, high, core, a, b in tile_plan(len(codes)):
                yield pa.RecordBatch.from_arrays([
                    pa.array([key]), pa.array([len(codes)], pa.int64()), pa.array([low], pa.int32()),
                    pa.array([high], pa.int32()), pa.array([core], pa.int64()), pa.array([a], pa.int64()),
                    pa.array([codes[a:b].tobytes()], pa.binary())], names=_TILE.names)


def tile_fragments(words: np.ndarray, n: int, low: int, high: int, home: int, start: int) -> Iterator[tuple]:
    """(period, start, end, first, last, whole) of the stretches that one tile sees, in words of the text.

    ``first`` and ``last`` say that the tile sees the word that ends the run there. A run that does not leave the
    tile in whose core it starts is ``whole`` and told by this tile only; pieces of all others are stitched.
    ``home`` is the start of the tile's core, ``start`` that of its words.
    """
    stop, core, margin = start + len(words), _core(high), 1 << (high - 1)
    for a, b, q in solve(words, range(low, high)):
        a, b = a + start, b + start
        first, last = a > start or start == 0, b < stop or stop == n
        owner = a // core * core
        inside = last and (b < owner + core + 8 * margin + 1 or owner + core + 8 * margin + 1 >= n)
        if not (first and inside):
            yield q, a, b, first, last, False
        elif owner == home:
            yield q, a, b, first, last, True


def _solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            r = {c: v[0].as_py() for c, v in zip(batch.schema.names, batch.slice(i, 1).columns, strict=True)}
            words = np.frombuffer(r["words"], np.int32)
            out += [(r["key"], *f) for f in tile_fragments(words, r["n"], r["low"], r["high"], r["core"], r["start"])]
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_FRAGMENT.names)


def stitch(fragments: DataFrame) -> DataFrame:
    """(key, start, length, period) of all runs that the fragments show from end to end.

    Pieces of one period that share that many words belong to one run, and only these do. A piece that no other
    completes belongs to a run that one tile has told as a whole. For one text and period there are a few pieces
    per tile at most.
    """
    pieces = fragments.where("not whole")
    order = W.partitionBy("key", "period").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") + F.col("period") > before), 1).otherwise(0)
    pieces = pieces.withColumn("_fresh", fresh)
    pieces = pieces.withColumn("_run", F.sum("_fresh").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    joined = pieces.groupBy("key", "period", "_run").agg(
        F.min(F.struct("start", (~F.col("first")).alias("cut"))).alias("a"),
        F.max(F.struct("end", "last")).alias("b"),
    ).where("not a.cut and b.last").select("key", F.col("a.start").alias("start"), F.col("b.end").alias("end"), "period")
    whole = fragments.where("whole").select("key", "start", "end", "period")
    length = F.col("end") - F.col("start")
    return whole.unionByName(joined).select("key", "start", length.alias("length"), "period").where(
        (F.col("length") >= LEAST_WORDS) & (F.col("length") >= LEAST_PERIODS * F.col("period"))).distinct()


def _solve_long(text: str, listed: str, schema: T.StructType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, text):
            words = [_split(v) for v in batch.column(text).to_pylist()]
            runs = [[(r["start"], r["length"], r["period"]) for r in own or ()] for own in batch.column(listed).to_pylist()]
            yield _answers(batch, text, words, runs, schema)

    return work


def find_runs(docs: DataFrame, text: str = "text", long_chars: int = LONG_CHARS) -> DataFrame:
    """``docs`` with n_words, the periodic runs of each text, and the text with each run cut to its first period.

    Words are what stands between white space (space, \\t to \\r), equal only when the same characters. A run is
    a stretch of words with smallest period q, of 6 words and 4 periods at least, that cannot be extended on either
    side with that period. ``runs`` lists (start, length, period) by start, then period; ``collapsed`` joins by one
    space the words that no run holds after its first period. A null or blank text has no words, no runs and an
    empty ``collapsed``. Each row is judged by its own text, so repeated rows and ids do no harm; columns
    that are already called n_words, runs or collapsed are replaced, all others stay; no rows give no rows.

    Texts of up to ``long_chars`` characters are solved where they are read. Longer ones are cut into overlapping
    tiles: one set for all periods up to 2,047 words, and one per octave beyond, with cores of 16,384 words or 16 of the
    octave's shortest periods. Tiles are shuffled and solved independently, the pieces they find are shuffled by
    text and period and stitched, and only the runs go back to the text. The tile of the longest octave is at most as
    long as its text.
    """
    docs = docs.drop("n_words", "runs", "collapsed").withColumn(text, F.col(text).cast("string"))
    added = [("n_words", T.LongType()), ("runs", RUNS), ("collapsed", T.StringType())]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in added]])
    is_long = F.length(F.coalesce(F.col(text), F.lit(""))) > long_chars
    short = docs.where(~is_long).mapInArrow(_solve_short(text, schema), schema)

    key, listed = free_name(docs, "_key"), free_name(docs, "_runs")
    long = docs.where(is_long).withColumn(key, F.sha2(F.col(text), 256))
    tiles = long.select(key, text).mapInArrow(_explode, _TILE)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = tiles.repartition(parts, "key", "low", "core")
    fragments = materialise(tiles.mapInArrow(_solve_tiles, _FRAGMENT), "fragments")
    found = stitch(fragments).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias(listed))
    joined = long.join(found.withColumnRenamed("key", key), key, "left").drop(key)
    return short.unionByName(joined.mapInArrow(_solve_long(text, listed, schema), schema))
