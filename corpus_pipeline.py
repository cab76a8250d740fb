"""From raw documents to packed training sequences: toxicity, near duplicates, secrets, mixing, packing."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphgrove.llm import mixing, near_dedup, packing, secret_scan, toxicity
from glyphgrove.llm.common import materialise, read
from glyphgrove.runtime import collecting, delete_scratch, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of rows that a stage sends to a Python worker at once. Whole texts are long: the rows Spark sends by default
#: come to tens of MB, which the executor and its worker hold several times over.
BATCH_BYTES = 8 << 20

#: Scratch tables of the last stage of each session. They go when the next stage begins, whose input is written by then.
_left: dict[str, list[str]] = {}


def _stage(work: Stage) -> Stage:
    """A stage that owns the scratch tables it writes, and bounds what Python workers are sent at once.

    Tables that the plan of its input still reads are left alone: then the input was not written in between.
    """

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        # stays set: the rows of the stage are worked out when they are written
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        own = _left.setdefault(spark.sparkContext.applicationId, [])
        used = docs.inputFiles() if own else []
        gone = [path for path in own if not any(path.split(":")[-1] in f for f in used)]
        delete_scratch(spark, gone)
        own[:] = [path for path in own if path not in gone]
        with collecting(own):
            return work(spark, docs, sf_dir)

    return run_stage


@_stage
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.deduplicate(docs, shingle=5, percent=80)


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return secret_scan.redact(docs, secret_scan.train(docs))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of documents, in number by the target weights of their sources."""
    return mixing.mixture(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with the sequence they are packed into and their place in it."""
    return packing.pack(docs, keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("near duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: The stages train models and approximate nothing that SQL could restate.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and read again."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, "stage")
            if written is not None:
                release(written)
            written = docs
    return docs
