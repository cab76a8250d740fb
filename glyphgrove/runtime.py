"""Session, scratch tables and the join helper shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side we ask Spark to broadcast; beyond it the join is shuffled and salted.
BROADCAST_BYTES = 64 << 20

#: Ways a hot key is split in a shuffled lookup.
SALTS = 16


def session(app: str = "glyphgrove", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are designed for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # per-call stack capture of the Python API; it only serves error messages
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master gets a folder of its own when the setting is missing: a machine-local
    folder would be invisible to the other hosts of a cluster.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="glyphgrove-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return scratch_root(spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


#: Lists of scratch tables, the innermost collector last.
_collectors: list[list[str]] = []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives executor loss, gives statistics."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    if _collectors:
        _collectors[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


@contextlib.contextmanager
def collecting(paths: list[str]) -> Iterator[list[str]]:
    """Note in ``paths`` the scratch tables that are written inside, so that their owner can delete them."""
    _collectors.append(paths)
    try:
        yield paths
    finally:
        _collectors.pop()


def delete_scratch(spark: SparkSession, paths: list[str]) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        target = jpath(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def release(table: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote; nothing may read it any more."""
    delete_scratch(table.sparkSession, [table._scratch])


def pin(df: DataFrame, rows: int, row_bytes: int, label: str) -> DataFrame:
    """Fix the content of a table known to hold at most ``rows`` rows of ``row_bytes`` each.

    A table within the broadcast bound becomes a local relation, a larger one a written table.
    """
    if rows * row_bytes <= BROADCAST_BYTES // 4:
        return df.sparkSession.createDataFrame(df.toArrow(), schema=df.schema)
    return materialise(df, label)


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "inner",
    table_bytes: int | None = None,
    hot: bool = False,
    salts: int = SALTS,
) -> DataFrame:
    """Join many ``rows`` to a ``table`` that is unique on ``on``.

    ``table_bytes`` is a proven bound of the table: within ``BROADCAST_BYTES`` it is broadcast.
    ``hot`` says that one key may hold a large share of the rows and that the table is much smaller
    than they are: it is repeated once per salt, every row goes to one salt, and so a hot key is
    spread over ``salts`` tasks. Otherwise the adaptive skew split repeats only what turns out to be skewed.
    A table without a bound is never sent to all: Catalyst would go by the size of its compressed file or by the
    rows before they are repeated, and the driver would hold many times that.
    """
    if table_bytes is not None and table_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), on, how)
    if not hot:
        return shuffled(rows).join(table, on, how)
    repeated = table.withColumn("_salt", F.explode(F.lit(list(range(salts)))))
    spread = [c for c in rows.columns if c not in on] or on
    # a hash of the row, not a random number: a retried task must send its rows to the same place
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return shuffled(salted).join(repeated, [*on, "_salt"], how).drop("_salt")


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` whose next join shuffles and sorts both sides, whatever Catalyst takes their sizes to be."""
    return rows.hint("merge")


def vector_bytes(dimension: int) -> int:
    """Upper bound of the size of one array value of this length."""
    return 64 + 8 * dimension
