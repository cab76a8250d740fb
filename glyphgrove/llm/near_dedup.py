"""Near duplicates: one-permutation MinHash, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from glyphgrove.llm import minhash
from glyphgrove.llm.common import (
    distinct_sets, free_name, materialise, mix, schema_of, shingle_hashes, slices, word_hashes,
)
from glyphgrove.llm.components import components
from glyphgrove.llm.mixing import number_rows

#: 50 bands of 7 bins: a pair of similarity 0.8 shares no bucket with probability (1 - 0.8^7)^50 = 8e-6,
#: a pair of similarity 0.1 shares one with 5e-6.
BANDS, ROWS = 50, 7
#: Rounds of new stars, one for each bucket that still holds several components; the exact join takes the rest.
DRAWS = 4
#: Edges of one node that a round confirms at most, those most of its buckets give.
EDGES = 8
#: Shingles are ranked by counts in so many cells of their hash, 8 MB in all, packed by so many; a shingle's
#: members are joined in blocks of about so many.
CELLS, CELL_BLOCK, BLOCK = 1 << 20, 1 << 14, 4096
#: Columns of 64 bits that tell for each of so many cells whether an odd number of a set's shingles falls into it.
PARITIES = 8


def _list_array(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes, number per text) for slices of a column."""
    for at, part in slices(texts):
        yield at, *distinct_sets(*shingle_hashes(*word_hashes(part), shingle))


def _digests(sets: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.cumsum(sizes)
    raw = [
        hashlib.blake2b(sets[e - n : e].tobytes(), digest_size=16).digest() if n else None
        for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)
    ]
    return pa.array(raw, pa.binary())


def signatures(
    docs: DataFrame, id_column: str, text: str, shingle: int, bands: int = BANDS, rows: int = ROWS,
    number: Column | None = None,
) -> DataFrame:
    """(doc_id, row, n_shingles, node, bands): the identity of each shingle set and its band hashes.

    ``node`` is a 128-bit digest of the whole sorted set, null for a text without words; ``row`` is ``number``.
    """
    schema = schema_of(
        ("doc_id", T.LongType()), ("row", T.LongType()), ("n_shingles", T.LongType()), ("node", T.BinaryType()),
        ("bands", T.ArrayType(T.LongType())),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for at, sets, sizes in shingle_sets(batch.column("_text"), shingle):
                minima = minhash.densify(minhash.bin_minima(sets, sizes, bands * rows))
                cells = minima.reshape(len(sizes), bands, rows)
                folded = np.broadcast_to(salt, (len(sizes), bands)).copy()
                for j in range(rows):
                    folded = mix(folded * np.uint64(0x9FB21C651E98DF25) + cells[:, :, j])
                number = np.where(sizes > 0, bands, 0)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, len(sizes)),
                    batch.column("row").slice(at, len(sizes)),
                    pa.array(sizes),
                    _digests(sets, sizes),
                    _list_array(folded[sizes > 0].reshape(-1), number),
                ], names=schema.names)

    row = F.lit(None) if number is None else number
    narrow = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), row.cast("long").alias("row"), F.col(text).alias("_text"))
    return narrow.mapInArrow(work, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, text: str, id_column: str, shingle: int) -> DataFrame:
    """(node, set): the whole shingle sets of the documents ``wanted`` (doc_id, node) names."""
    schema = schema_of(("node", T.BinaryType()), ("set", T.ArrayType(T.LongType())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets, sizes in shingle_sets(batch.column("_text"), shingle):
                yield pa.RecordBatch.from_arrays(
                    [_digests(sets, sizes), _list_array(sets, sizes)], names=schema.names
                )

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    ids = wanted.select("doc_id").distinct()
    found = narrow.join(ids, F.coalesce(narrow.doc_id, F.lit(-1 << 63)) == F.coalesce(ids.doc_id, F.lit(-1 << 63)), "left_semi")
    # rows that share an id may hold different texts: the digest says which set is whose
    return found.mapInArrow(work, schema).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (u, v) whose whole sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("node").alias("u"), F.col("set").alias("_a"))
    b = sets.select(F.col("node").alias("v"), F.col("set").alias("_b"))
    both = edges.join(a, "u").join(b, "v")
    shared = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - shared
    return both.where(100 * shared >= percent * union).drop("_a", "_b")


def _drawn(bucket: W, turn: int, member: Column) -> Column:
    """One of each bucket's members, drawn by a hash of node, band and ``turn``."""
    ticket = F.struct(F.xxhash64("node", "band", F.lit(turn)).alias("h"), member.alias("m"))
    return F.min(ticket).over(bucket).getField("m")


def _pairs(stars: DataFrame, percent: int, *more: Column) -> DataFrame:
    """(u, v, ``more``) from (node, n, center): pairs whose sizes alone do not rule the similarity out."""
    near = 100 * F.least("n", "center.n") >= percent * F.greatest("n", "center.n")
    return stars.where((F.col("node") != F.col("center.node")) & near).select(
        F.greatest("node", "center.node").alias("u"), F.least("node", "center.node").alias("v"), *more)


def _set_slices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(all shingles of the sets of a batch, ends of the sets)."""
    lists = batch.column("set")
    sizes = np.asarray(lists.value_lengths(), np.int64)
    return np.asarray(lists.flatten()).view(np.uint64), np.cumsum(sizes)


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _parities(shingles: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each set PARITIES numbers of 64 bits: which cells hold an odd number of its shingles."""
    cells = 64 * PARITIES
    sets = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    cell = ((shingles >> np.uint64(17)) % np.uint64(cells)).astype(np.int64)
    odd = np.bincount(sets * cells + cell, minlength=len(ends) * cells) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(ends), cells), axis=1).view(np.int64)


def _frequencies(rest: DataFrame) -> np.ndarray:
    """How often the shingles of each cell are met in the sets of ``rest``: bounds each shingle's count."""
    part = schema_of(("block", T.IntegerType()), ("cell", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.LongType())))
    whole = schema_of(("block", T.IntegerType()), ("times", T.BinaryType()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            total += np.bincount(_cells(_set_slices(batch)[0]), minlength=CELLS)
        for block in range(CELLS // CELL_BLOCK):
            own = total[block * CELL_BLOCK : (block + 1) * CELL_BLOCK]
            met = np.flatnonzero(own)
            if len(met):
                yield pa.RecordBatch.from_pylist(
                    [{"block": block, "cell": met.tolist(), "times": own[met].tolist()}],
                    schema=pa.schema([("block", pa.int32()), ("cell", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]))

    def add(table: pa.Table) -> pa.Table:
        out = np.zeros(CELL_BLOCK, np.int64)
        for cell, times in zip(table.column("cell").to_pylist(), table.column("times").to_pylist(), strict=True):
            out[cell] += times
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "times": pa.array([out.tobytes()], pa.binary())})

    total = np.zeros(CELLS, np.int64)
    for r in rest.select("set").mapInArrow(count, part).groupBy("block").applyInArrow(add, whole).collect():
        total[r["block"] * CELL_BLOCK : (r["block"] + 1) * CELL_BLOCK] = np.frombuffer(r["times"], np.int64)
    return total


def _prefixes(rest: DataFrame, percent: int) -> DataFrame:
    """(token, at, n, node, root, p0..p7): the rarest shingles of each set that a linked set must share one of.

    In one order of all shingles, the first one that two linked sets share stands among the first
    n - ceil(n * percent / 100) + 1 of both. A shingle met once is shared by nobody and left out. The parities
    p0..p7 of two sets differ in no more cells than the sets differ in shingles.
    """
    schema = schema_of(("token", T.LongType()), ("at", T.LongType()), ("n", T.LongType()),
                       ("node", T.BinaryType()), ("root", T.BinaryType()),
                       *[(f"p{k}", T.LongType()) for k in range(PARITIES)])
    shared = rest.sparkSession.sparkContext.broadcast(_frequencies(rest))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles, ends = _set_slices(batch)
            times = shared.value[_cells(shingles)]
            tokens, places, sizes, rows, start = [], [], [], [], 0
            for row, end in enumerate(ends.tolist()):
                n = end - start
                order = np.lexsort((shingles[start:end], times[start:end]))[: n - (n * percent + 99) // 100 + 1]
                at = np.flatnonzero(times[start:end][order] > 1)
                tokens.append(shingles[start:end][order[at]])
                places.append(at)
                sizes.append(np.full(len(at), n))
                rows.append(np.full(len(at), row))
                start = end
            if tokens:
                row = pa.array(np.concatenate(rows))
                odd = _parities(shingles, ends)[np.concatenate(rows)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(places)),
                    pa.array(np.concatenate(sizes)), batch.column("node").take(row), batch.column("root").take(row),
                    *[pa.array(np.ascontiguousarray(odd[:, k])) for k in range(PARITIES)],
                ], names=schema.names)

    return rest.select("node", "root", "set").mapInArrow(work, schema)


def _unlinked(rest: DataFrame, percent: int) -> DataFrame:
    """(u, v, a, b): all pairs of ``rest`` (node, root, set) with unequal roots a, b that may be linked.

    None of the linked pairs is missing. A shingle held by many is joined as a grid of blocks.
    """
    prefix = materialise(_prefixes(rest, percent), "prefixes")
    held = prefix.groupBy("token").agg(
        F.count(F.lit(1)).alias("times"), F.min("root").alias("_a"), F.max("root").alias("_b"))
    held = held.where("_a <> _b").select("token", F.ceil(F.col("times") / BLOCK).cast("int").alias("blocks"))
    rows = prefix.join(held, "token").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    carried = ("at", "n", "node", "root", *[f"p{k}" for k in range(PARITIES)])
    x = rows.select("token", F.col("own").alias("p"), every.alias("q"), *[F.col(c).alias(f"x_{c}") for c in carried])
    y = rows.select("token", every.alias("p"), F.col("own").alias("q"), *[F.col(c).alias(f"y_{c}") for c in carried])
    # after the first shared shingle no more can be shared than either set has left
    left = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    enough = (100 + percent) * left >= percent * (F.col("x_n") + F.col("y_n"))
    # the sets differ in as many shingles as their parities at least: an exact bound of the similarity
    differ = sum((F.bit_count(F.col(f"x_p{k}").bitwiseXOR(F.col(f"y_p{k}"))) for k in range(PARITIES)), F.lit(0))
    enough = enough & ((100 + percent) * differ <= (100 - percent) * (F.col("x_n") + F.col("y_n")))
    apart = (F.col("x_node") > F.col("y_node")) & (F.col("x_root") != F.col("y_root"))
    return x.join(y, ["token", "p", "q"]).where(apart & enough).select(
        F.col("x_node").alias("u"), F.col("y_node").alias("v"),
        F.least("x_root", "y_root").alias("a"), F.greatest("x_root", "y_root").alias("b")).distinct()


def _merged(found: DataFrame, name: str) -> DataFrame:
    """(root, ``name``): what the components (a, b) of the links ``found`` come to when one is one node."""
    bridges = found.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    return components(bridges).select(F.col("node").alias("root"), F.col("root").alias(name))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5,
    percent: int = 80, bands: int = BANDS, rows: int = ROWS, draws: int = DRAWS,
) -> DataFrame:
    """Return (doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Words are runs without white space, A-Z lower-cased. A text's set holds its distinct windows of
    ``shingle`` words; a shorter text is one window; a null text or one without words has an empty set,
    is linked with nothing and is its own component. Two documents are linked when 100 * intersection
    >= ``percent`` * union of their whole sets. ``component_id`` is the least doc_id reachable, ``kept``
    is doc_id = component_id. Rows that share a doc_id are judged each by its own text. A null doc_id
    counts as larger than all others; a component without any other has a null component_id, and its
    rows are kept. Extra columns are ignored; no rows give no rows.

    Rows with the same set become one node, so groups of copies of any size cost one node. Nodes that
    share a band are candidates; a bucket gives stars, not pairs: all members with its least node and
    all members with a member drawn by hash. A node's most frequent edge is confirmed first. Then come rounds in
    which each bucket that still holds several components gives one new star, each node's most frequent edges into other
    components are confirmed, and linked components become one; they end after ``draws`` rounds or when fewer
    than one edge in twenty is a link. What then still shares a bucket with another component is joined
    exactly: by the rarest shingles of its set, of which a linked set must hold one, and by how many shingles
    either set has left after it. Sets are confirmed whole, so no false link is made. A link goes unseen only
    if its ends share no bucket and no chain of links joins them otherwise.
    """
    return _judged(docs, id_column, text, shingle, percent, bands, rows, draws).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _crossing(placed: DataFrame, percent: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Entries of the buckets that hold several components, and up to EDGES candidate edges for each of their nodes.

    Each bucket gives the star around a member drawn by hash; a node's edges are those that most of its buckets give
    and that lead into other components: (u, v, a, b) with the components a, b. So a round has no more edges than EDGES
    a node, however large the buckets. Buckets are added up before they are joined back, so that one of any size
    is spread over tasks.
    """
    member = F.struct("node", "n", "root")
    ticket = F.struct(F.xxhash64("node", "band", F.lit(turn)).alias("h"), member.alias("m"))
    several = placed.groupBy("band").agg(
        F.min("root").alias("_a"), F.max("root").alias("_b"), F.min(ticket).alias("_t")
    ).where("_a <> _b").select("band", F.col("_t.m").alias("center"))
    mixed = materialise(placed.join(several, "band"), "mixed")
    ends = (F.least("root", "center.root").alias("a"), F.greatest("root", "center.root").alias("b"))
    pairs = _pairs(mixed.where(F.col("root") != F.col("center.root")), percent, "node", *ends)
    often = pairs.groupBy("node", "u", "v", "a", "b").agg(F.count(F.lit(1)).alias("times"))
    # a node is in as many buckets as there are bands
    listed = F.sort_array(F.collect_list(F.struct("times", "u", "v", "a", "b")), asc=False)
    best = often.groupBy("node").agg(F.slice(listed, 1, EDGES).alias("e")).select(F.explode("e").alias("e"))
    return mixed.drop("center"), best.select("e.u", "e.v", "e.a", "e.b").distinct()


def _judged(
    docs: DataFrame, id_column: str, text: str, shingle: int, percent: int, bands: int = BANDS, rows: int = ROWS,
    draws: int = DRAWS, number: Column | None = None,
) -> DataFrame:
    """(doc_id, row, n_shingles, root, component_id): ``root`` names a row's component, null without words."""
    prints = materialise(signatures(docs, id_column, text, shingle, bands, rows, number), "signatures")
    nodes = prints.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n")
    )
    heads = prints.select("node", "doc_id", "n_shingles", "bands").join(
        nodes.select(F.col("node").alias("_node"), F.col("doc_id").alias("_id")),
        (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi",
    )
    entries = heads.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    bucket = W.partitionBy("band")
    stars = entries.select(
        "band", "node", "n", F.min(F.struct("node", "n")).over(bucket).alias("least"),
        F.max("node").over(bucket).alias("most"), _drawn(bucket, 0, F.struct("node", "n")).alias("drawn"),
    ).where("least.node <> most").drop("most").distinct()
    stars = materialise(stars, "buckets")
    pairs = stars.select("node", "n", F.explode(F.array("least", "drawn")).alias("center"))
    edges = _pairs(pairs, percent).groupBy("u", "v").agg(F.count(F.lit(1)).alias("times"))
    members = stars.select("node").distinct()
    wanted = nodes.select("node", "doc_id").join(members, "node", "left_semi")
    sets = materialise(full_sets(docs, wanted, text, id_column, shingle), "sets")

    ends = edges.select("times", "u", "v", F.explode(F.array("u", "v")).alias("node"))
    best = ends.groupBy("node").agg(F.max(F.struct("times", "u", "v")).alias("b"))
    first = materialise(best.select("b.u", "b.v").distinct(), "edges")
    roots = components(materialise(_confirm(first, sets, percent), "links"))

    # rounds of new stars in buckets that hold several components; from here on a component is one node: its root
    placed = stars.select("band", "node", "n").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    labelled = nodes.select("node", "doc_id").join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("root"), "doc_id")
    for turn in range(1, draws + 1):
        placed, crossing = _crossing(placed, percent, turn)
        crossing = materialise(crossing, "edges")
        links = materialise(_confirm(crossing, sets, percent), "links")
        tried, found = crossing.count(), links.count()
        if found:
            merged = materialise(_merged(links, "_merged"), "roots")
            new = F.coalesce("_merged", "root").alias("root")
            placed = placed.join(merged, "root", "left").select("band", "node", "n", new)
            labelled = labelled.join(merged, "root", "left").select("node", new, "doc_id")
        if 20 * found < tried or not found:
            break

    # the exact rest: all members of buckets that hold several components even now
    now = placed.select("band", "node", "root")
    bands_left = now.groupBy("band").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a <> _b")
    left = now.join(bands_left.select("band"), "band", "left_semi").select("node", "root").distinct()
    rest = materialise(left.join(sets, "node"), "rest")
    last = _merged(materialise(_confirm(_unlinked(rest, percent), sets, percent), "links"), "_last")

    labelled = labelled.join(last, "root", "left").select(
        "node", F.coalesce("_last", "root").alias("root"), "doc_id")
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = labelled.join(least, "root").select(F.col("node").alias("_node"), "root", "component_id")
    out = prints.select("doc_id", "row", "n_shingles", "node").join(labels, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row", "n_shingles", "root", component.alias("component_id"))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 5,
                percent: int = 80) -> DataFrame:
    """Keep one row of each group of near duplicates: one with the least id, nulls last, columns as given.

    Rows are told apart by a row number of their own, so rows that share an id, or have none, are judged each
    by its own text. Texts without words are linked with nothing and all stay.
    """
    name = free_name(docs, "_number")
    rows = number_rows(docs, name)
    found = materialise(
        _judged(rows, id_column, text, shingle, percent, number=F.col(name)).select("doc_id", "row", "root"), "judged")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    heads = found.where("root is not null").groupBy("root").agg(F.min(order).alias("head")).select("head.row")
    stay = heads.unionByName(found.where("root is null").select("row")).withColumnRenamed("row", name)
    return rows.join(stay, name, "left_semi").drop(name)
