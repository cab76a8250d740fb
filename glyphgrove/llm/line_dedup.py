"""Line dedup that can be undone: exact reference counts in shards, a cuckoo filter before each."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphgrove.llm.common import free_name, schema_of
from glyphgrove.runtime import materialise, scratch_path

#: A line goes when it stands in so many documents; keys of fewer code points never go.
MIN_DOCS, MIN_CHARS = 10, 1
#: A filter is planned for so many keys; with more on average the table is dealt to more shards.
SHARD_KEYS = 1 << 18
#: Tables of changes that a read adds up before they are merged into one.
DELTAS = 8
#: Filters and exact keys within this bound go to every task; beyond it lines are shuffled to the keys.
SMALL_BYTES = 32 << 20
#: Slots of a bucket, buckets that a key may push others through, share of the slots that is filled at most.
SLOTS, KICKS, LOAD = 4, 400, 0.85

REFS = schema_of(("key", T.BinaryType()), ("docs", T.LongType()))
FILTERS = schema_of(("shard", T.IntegerType()), ("keys", T.LongType()), ("slots", T.BinaryType()))
STATE = schema_of(
    ("version", T.LongType()), ("base", T.LongType()), ("shards", T.IntegerType()), ("min_docs", T.LongType()),
    ("min_chars", T.LongType()), ("hot_keys", T.LongType()), ("filter_bytes", T.LongType()), ("filters", T.LongType()),
)


def _raw(digests: list[bytes]) -> np.ndarray:
    """Digests of 16 bytes as two columns of unsigned 64-bit numbers."""
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; a key lives in one of two buckets, so it can be removed.

    Keys are 16-byte digests. Equal fingerprints are stored as often as keys have them, so the removal of
    one key never removes another. ``add`` returns False when no place is found: the filter must then be
    rebuilt from the exact keys with more buckets.
    """

    def __init__(self, slots: np.ndarray, keys: int = 0):
        self.slots, self.keys = slots, keys

    @classmethod
    def planned(cls, keys: int) -> CuckooFilter:
        buckets = 4
        while buckets * SLOTS * LOAD < keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, raw: bytes, keys: int) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy(), keys)

    @classmethod
    def holding(cls, digests: list[bytes]) -> CuckooFilter:
        room = max(len(digests), 1)
        while True:
            made = cls.planned(room)
            if all(made.add(d) for d in digests):
                return made
            room *= 2

    def _places(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.slots) - 1)
        prints = (raw[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (raw[:, 1] >> np.uint64(16)) & mask
        return prints, first, first ^ self._hop(prints, mask)

    @staticmethod
    def _hop(prints, mask: np.uint64):
        return (np.uint64(prints) * np.uint64(0x5BD1E995) >> np.uint64(3)) & mask

    def add(self, digest: bytes) -> bool:
        prints, first, second = self._places(_raw([digest]))
        held, at, mask = prints[0], int(first[0]), np.uint64(len(self.slots) - 1)
        for place in (at, int(second[0])):
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = held
                self.keys += 1
                return True
        for kick in range(KICKS):
            slot = kick % SLOTS
            held, self.slots[at, slot] = self.slots[at, slot], held
            at = at ^ int(self._hop(held, mask))
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = held
                self.keys += 1
                return True
        return False

    def remove(self, digest: bytes) -> bool:
        prints, first, second = self._places(_raw([digest]))
        for place in (int(first[0]), int(second[0])):
            found = np.flatnonzero(self.slots[place] == prints[0])
            if len(found):
                self.slots[place, found[0]] = 0
                self.keys -= 1
                return True
        return False

    def may_hold(self, raw: np.ndarray) -> np.ndarray:
        """False for no key that was added and not removed."""
        prints, first, second = self._places(raw)
        return ((self.slots[first.astype(np.int64)] == prints[:, None]).any(1)
                | (self.slots[second.astype(np.int64)] == prints[:, None]).any(1))


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def _digests(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """The 128-bit digest of each line's key; None where the key is too short to go.

    ``strip`` and ``lower`` of bytes know exactly space, \\t to \\r and A-Z.
    """
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip().lower()
        long = len(key) >= min_chars if min_chars <= 1 else len(key.decode()) >= min_chars
        out.append(hashlib.blake2b(key, digest_size=16).digest() if long and key else None)
    return out


def _counted(docs: DataFrame, text: str, min_chars: int, sign: int) -> DataFrame:
    """(key, docs): how many rows of ``docs`` hold each key, times ``sign``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: Counter[bytes] = Counter()
            for value in batch.column(0):
                met.update({d for d in _digests(_lines(value.as_py()), min_chars) if d})
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(met), pa.binary()), pa.array(list(met.values()), pa.int64())], names=REFS.names)

    found = docs.select(F.col(text).cast("string")).mapInArrow(work, REFS)
    return found.groupBy("key").agg((sign * F.sum("docs")).alias("docs"))


def _shard(shards: int):
    return F.pmod(F.conv(F.substring(F.hex("key"), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _shards_of(raw: np.ndarray, shards: int) -> np.ndarray:
    return ((raw[:, 0] >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


class _Probe:
    """Filters of some shards and, if given, the exact keys behind them, as a task uses them."""

    def __init__(self, shards: int, filters: dict[int, tuple[bytes, int]], exact: list[bytes] | None):
        self.shards = shards
        self.filters = {s: CuckooFilter.read(raw, n) for s, (raw, n) in filters.items()}
        self.exact = None
        if exact is not None:
            raw = _raw(exact)
            self.exact = raw[np.lexsort((raw[:, 1], raw[:, 0]))]

    def positive(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw), bool)
        at = _shards_of(raw, self.shards)
        for s in np.unique(at).tolist():
            if s in self.filters:
                rows = np.flatnonzero(at == s)
                out[rows] = self.filters[s].may_hold(raw[rows])
        return out

    def confirmed(self, raw: np.ndarray) -> np.ndarray:
        out = self.positive(raw)
        for row in np.flatnonzero(out).tolist():
            high, low = raw[row]
            a, b = np.searchsorted(self.exact[:, 0], [high], "left")[0], np.searchsorted(self.exact[:, 0], [high], "right")[0]
            out[row] = low in self.exact[a:b, 1]
        return out


class LineIndex:
    """Reference counts of all lines of a changing set of documents, kept in a folder.

    A line's key is the line without white space at its ends (space, \\t to \\r), A-Z lower-cased. A
    document counts once for each key it holds, every row being a document of its own; a null text is one
    empty line, and keys of fewer than ``min_chars`` code points never go. ``insert`` and ``delete`` write a table of
    changes (key, +-documents); reads add up at most ``DELTAS`` of them, then they are merged, so a small
    batch does not rewrite the counts. Keys that stand in ``min_docs`` documents or more are in their
    shard's cuckoo filter; keys that cross the limit are added to it or removed from it. Deleting what was
    inserted restores counts and decisions. A version counts from the moment its row of ``state`` is
    written: what a failed job leaves behind is never read.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def create(cls, spark: SparkSession, folder: str | None = None, min_docs: int = MIN_DOCS,
               min_chars: int = MIN_CHARS, shards: int = 16) -> LineIndex:
        index = cls(spark, folder or scratch_path(spark, "lines"))
        index._commit(dict(version=0, base=1, shards=shards, min_docs=min_docs, min_chars=min_chars,
                           hot_keys=0, filter_bytes=0, filters=0))
        return index

    def _commit(self, state: dict) -> None:
        row = self.spark.createDataFrame([tuple(state[f] for f in STATE.names)], STATE).coalesce(1)
        row.write.mode("append").parquet(f"{self.folder}/state")

    def state(self) -> dict:
        rows = self.spark.read.schema(STATE).parquet(f"{self.folder}/state")
        return rows.orderBy(F.desc("version")).first().asDict()

    def _table(self, schema: T.StructType, kind: str, versions: list[int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{kind}-{v}" for v in versions])

    def counts(self, state: dict | None = None) -> DataFrame:
        """(key, docs): the exact table, keys without documents left out."""
        state = state or self.state()
        parts = self._table(REFS, "refs", list(range(state["base"], state["version"] + 1)))
        if state["base"] == state["version"]:
            return parts.where("docs <> 0")
        return parts.groupBy("key").agg(F.sum("docs").alias("docs")).where("docs <> 0")

    def hot(self, state: dict | None = None) -> DataFrame:
        """(key): the keys whose lines go."""
        state = state or self.state()
        return self.counts(state).where(F.col("docs") >= state["min_docs"]).select("key")

    def filters(self, state: dict) -> DataFrame:
        return self._table(FILTERS, "filters", [state["filters"]] if state["filters"] else [])

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._change(docs, text, 1)

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        """Take documents away again; raises, and changes nothing, if they hold lines that were never inserted."""
        return self._change(docs, text, -1)

    def _change(self, docs: DataFrame, text: str, sign: int) -> LineIndex:
        state = self.state()
        version, limit = state["version"] + 1, state["min_docs"]
        path = f"{self.folder}/refs-{version}"
        _counted(docs, text, state["min_chars"], sign).write.mode("overwrite").parquet(path)
        change = self._table(REFS, "refs", [version])
        new = {**state, "version": version}
        if state["version"] >= state["base"]:
            before = self.counts(state).join(change.select("key"), "key", "left_semi")
            both = change.withColumnRenamed("docs", "step").join(before, "key", "left").select(
                "key", F.coalesce("docs", F.lit(0)).alias("was"), (F.coalesce("docs", F.lit(0)) + F.col("step")).alias("now"))
        else:
            both = change.select("key", F.lit(0).cast("long").alias("was"), F.col("docs").alias("now"))
        if sign < 0 and not both.where("now < 0").isEmpty():
            raise ValueError("documents to delete hold lines that no inserted document has")
        crossed = materialise(both.where((F.col("was") >= limit) != (F.col("now") >= limit)).select(
            _shard(state["shards"]).alias("shard"), "key", (F.col("now") >= limit).alias("added")), "crossed")
        crowded = state["hot_keys"] + crossed.where("added").count() > state["shards"] * SHARD_KEYS
        if crowded or version - state["base"] >= DELTAS:
            new = self._merge(new)
        else:
            new = self._update(new, state, crossed)
        self._commit(new)
        return self

    def _update(self, new: dict, old: dict, crossed: DataFrame) -> dict:
        """Filters after some keys were added or removed; shards without room are rebuilt from the exact keys."""

        def work(key: tuple, changes: pa.Table, filters: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            if filters.num_rows:
                held = CuckooFilter.read(filters.column("slots")[0].as_py(), filters.column("keys")[0].as_py())
            else:
                held = CuckooFilter.planned(max(changes.num_rows, 1))
            fits = True
            for digest, added in zip(changes.column("key").to_pylist(), changes.column("added").to_pylist(), strict=True):
                fits = fits and (held.add(digest) if added else held.remove(digest))
            # no slots: to be rebuilt
            slots = held.slots.tobytes() if fits else None
            return pa.table({"shard": pa.array([shard], pa.int32()), "keys": pa.array([held.keys], pa.int64()),
                             "slots": pa.array([slots], pa.binary())})

        path = f"{self.folder}/changed-{new['version']}"
        crossed.groupBy("shard").cogroup(self.filters(old).groupBy("shard")).applyInArrow(work, FILTERS).write.mode(
            "overwrite").parquet(path)
        changed = self.spark.read.schema(FILTERS).parquet(path)
        full = changed.where("slots is null").select("shard")
        out = changed.where("slots is not null")
        if not full.isEmpty():
            out = out.unionByName(self._built(self.hot(new).withColumn("shard", _shard(new["shards"])).join(
                F.broadcast(full), "shard", "left_semi")))
        return self._written(new, out)

    def _built(self, keys: DataFrame) -> DataFrame:
        def work(key: tuple, keys: pa.Table) -> pa.Table:
            held = CuckooFilter.holding(keys.column("key").to_pylist())
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([held.keys], pa.int64()),
                             "slots": pa.array([held.slots.tobytes()], pa.binary())})

        return keys.groupBy("shard").applyInArrow(work, FILTERS)

    def _written(self, new: dict, filters: DataFrame) -> dict:
        filters.write.mode("overwrite").parquet(f"{self.folder}/filters-{new['version']}")
        new = {**new, "filters": new["version"]}
        total = self.filters(new).agg(
            F.sum("keys").alias("k"), F.sum(F.length("slots")).alias("b")).first()
        return {**new, "hot_keys": total["k"] or 0, "filter_bytes": total["b"] or 0}

    def _merge(self, new: dict) -> dict:
        """Add up all tables of changes into one, deal it to more shards if the filters have grown too large."""
        whole = new["version"] + 1
        self.counts(new).write.mode("overwrite").parquet(f"{self.folder}/refs-{whole}")
        shards = new["shards"]
        merged = {**new, "version": whole, "base": whole}
        hot = self.hot(merged)
        while hot.count() > shards * SHARD_KEYS:
            shards *= 2
        merged["shards"] = shards
        return self._written(merged, self._built(hot.withColumn("shard", _shard(shards))))

    def drop_lines(self, docs: DataFrame, text: str = "text", small_bytes: int = SMALL_BYTES) -> DataFrame:
        """``docs`` with the lines that go taken out of ``text``, and new columns n_lines and n_dropped (long).

        Other lines stay as they are, joined by \\n. A null text gives an empty one (one line, none dropped),
        no rows give no rows; a column that is already called n_lines or n_dropped is replaced, all others
        stay. A line is first looked up in its shard's filter; only if that says yes, in the exact keys.
        Within ``small_bytes`` both go to all tasks. Beyond, each text's positive lines are joined with
        the exact table, and the result with the texts; filters go to the tasks in groups of shards within the bound.
        """
        state = self.state()
        docs = docs.drop("n_lines", "n_dropped")
        if state["hot_keys"] * 16 + state["filter_bytes"] <= small_bytes:
            filters = {r["shard"]: (bytes(r["slots"]), r["keys"]) for r in self.filters(state).collect()}
            exact = [bytes(r["key"]) for r in self.hot(state).collect()]
            shared = self.spark.sparkContext.broadcast((state["shards"], filters, exact))
            return _cleaned(docs, text, state["min_chars"], shared, None)
        return self._dropped_by_join(docs, text, state, small_bytes)

    def _dropped_by_join(self, docs: DataFrame, text: str, state: dict, small_bytes: int) -> DataFrame:
        digest, gone = free_name(docs, "_digest"), free_name(docs, "_gone")
        keyed = docs.withColumn(digest, F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
        lines = materialise(keyed.select(digest, F.col(text).cast("string")).mapInArrow(
            _line_rows(state["min_chars"], state["shards"]), "digest string, shard int, key binary"), "lines")
        sizes = self.filters(state).select("shard", F.length("slots").alias("b")).orderBy("shard").collect()
        groups: list[list[int]] = [[]]
        room = small_bytes
        for r in sizes:
            if groups[-1] and r["b"] > room:
                groups.append([])
                room = small_bytes
            groups[-1].append(r["shard"])
            room -= r["b"]
        positive = None
        for group in groups:
            own = self.filters(state).where(F.col("shard").isin(group))
            filters = {r["shard"]: (bytes(r["slots"]), r["keys"]) for r in own.collect()}
            shared = self.spark.sparkContext.broadcast((state["shards"], filters))
            some = lines.where(F.col("shard").isin(group)).mapInArrow(_positives(shared), lines.schema)
            positive = some if positive is None else positive.unionByName(some)
        found = positive.join(self.hot(state), "key").groupBy("digest").agg(F.collect_set("key").alias(gone))
        joined = keyed.join(found.withColumnRenamed("digest", digest), digest, "left").drop(digest)
        return _cleaned(joined, text, state["min_chars"], None, gone)


def _line_rows(min_chars: int, shards: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, keys = [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {d for d in _digests(_lines(value), min_chars) if d}
                names += [name] * len(own)
                keys += sorted(own)
            raw = _raw(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(_shards_of(raw, shards), pa.int32()), pa.array(keys, pa.binary())],
                names=["digest", "shard", "key"])

    return work


def _positives(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = _Probe(*shared.value, None)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(probe.positive(_raw(batch.column("key").to_pylist()))))

    return work


def _cleaned(docs: DataFrame, text: str, min_chars: int, shared, gone: str | None) -> DataFrame:
    """Rebuild the texts; what goes is looked up in ``shared`` or listed in the column ``gone``."""
    schema = T.StructType([
        T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema if f.name != gone
    ] + [T.StructField(n, T.LongType()) for n in ("n_lines", "n_dropped")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = None if shared is None else _Probe(*shared.value)
        for batch in batches:
            texts, totals, dropped = [], [], []
            listed = batch.column(gone).to_pylist() if gone else [None] * batch.num_rows
            lines = [_lines(v) for v in batch.column(text).to_pylist()]
            digests = [_digests(x, min_chars) for x in lines]
            if probe is None:
                go = [[d in set(own or ()) for d in ds] for ds, own in zip(digests, listed, strict=True)]
            else:
                distinct = list({d for ds in digests for d in ds if d})
                found = probe.confirmed(_raw(distinct)) if distinct else []
                hot = {d for d, f in zip(distinct, found, strict=True) if f}
                go = [[d in hot for d in ds] for ds in digests]
            for own, drop in zip(lines, go, strict=True):
                totals.append(len(own))
                dropped.append(sum(drop))
                texts.append(b"\n".join([x for x, d in zip(own, drop, strict=True) if not d]).decode())
            columns = [pa.array(texts, pa.string()) if f.name == text else batch.column(f.name) for f in schema[:-2]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], names=schema.names)

    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(work, schema)


ORACLE = """
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM texts),
keyed AS (
  SELECT rid, doc_id, line, i,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
gone AS (
  SELECT k FROM (SELECT DISTINCT rid, k FROM keyed WHERE length(k) >= 1) GROUP BY k HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(gone.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN gone ON keyed.k = gone.k
GROUP BY rid, doc_id
"""
