"""A table that grows by batches: a segment per batch, merged level by level, named by one manifest."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Segments of one level that are merged into one of the next.
FANOUT = 8

MANIFEST = T.StructType([
    T.StructField("batch", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("level", T.IntegerType()),
])


class Manifest(NamedTuple):
    """The last batch that counts, and the segments (name, level) that hold everything up to it."""

    version: int
    batch: int
    segments: list[tuple[str, int]]


class SegmentLog:
    """Rows kept under ``folder`` in segments that are each sorted by ``order``.

    A batch writes one small segment; ``FANOUT`` segments of a level become one of the next by ``merge``, so
    a row is rewritten once per level and the cost of a batch does not depend on what is stored. A batch
    counts from the moment its manifest is written. One that is replayed counts once: its number is in the
    manifest already, or its segment is overwritten. Segments that neither the last manifest nor the one before names
    are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, order: list[str],
                 merge: Callable[[DataFrame], DataFrame] | None = None, fanout: int = FANOUT):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.order, self.merge, self.fanout = order, merge or (lambda rows: rows), fanout

    def _files(self, folder: str):
        """The file system of the log, and the names in one of its folders."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        found = system.listStatus(path) if system.exists(path) else []
        return system, [s.getPath().getName() for s in found]

    def manifest(self) -> Manifest:
        system, names = self._files(f"{self.folder}/manifest")
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path
        for version in sorted((int(n[2:]) for n in names if n.startswith("v=")), reverse=True):
            path = f"{self.folder}/manifest/v={version}"
            if system.exists(jpath(f"{path}/_SUCCESS")):
                rows = self.spark.read.schema(MANIFEST).parquet(path).collect()
                named = sorted((r["name"], r["level"]) for r in rows if r["name"] is not None)
                return Manifest(version, rows[0]["batch"], named)
        return Manifest(0, -1, [])

    def read(self, manifest: Manifest | None = None) -> DataFrame:
        manifest = manifest or self.manifest()
        return self._rows([name for name, _ in manifest.segments])

    def _rows(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{n}" for n in names])

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.select(*self.schema.fieldNames()).orderBy(*self.order).write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def append(self, batch: int, rows: DataFrame) -> Manifest:
        """Add the rows of a batch; batches come in ascending order, a number that counts already changes nothing."""
        now = self.manifest()
        if batch <= now.batch:
            return now
        self._write(rows, f"segment-0-{batch}")
        segments, level = [*now.segments, (f"segment-0-{batch}", 0)], 0
        while sum(own == level for _, own in segments) >= self.fanout:
            old = [name for name, own in segments if own == level]
            merged = f"segment-{level + 1}-{batch}"
            self._write(self.merge(self._rows(old)), merged)
            segments = [s for s in segments if s[1] != level] + [(merged, level + 1)]
            level += 1
        new = Manifest(now.version + 1, batch, segments)
        listed = [(batch, name, level) for name, level in segments] or [(batch, None, None)]
        self.spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/manifest/v={new.version}")
        self._forget(now, new)
        return new

    def _forget(self, before: Manifest, now: Manifest) -> None:
        """Delete what neither of the last two manifests names."""
        live = {name for name, _ in [*before.segments, *now.segments]}
        system, names = self._files(self.folder)
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in names:
            if name.startswith("segment-") and name not in live:
                system.delete(jpath(f"{self.folder}/{name}"), True)
        for name in self._files(f"{self.folder}/manifest")[1]:
            if name.startswith("v=") and int(name[2:]) < before.version:
                system.delete(jpath(f"{self.folder}/manifest/{name}"), True)
