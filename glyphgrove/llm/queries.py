"""Queries over the given tables, one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrove.llm import (
    chat, fingerprints, hilbert, lexical_search, license_scan, line_dedup, line_quality, mixing, near_dedup, packing,
    periodic_runs, secret_scan, toxicity,
)
from glyphgrove.llm.common import read


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_probe(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.REJECT, 1).otherwise(0).alias("predicted"),
        "n_tokens",
        "passages",
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.build_index(docs))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(added)))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.amounts(read(spark, sf_dir, "documents"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_documents(read(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), shingle=2, percent=80)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(read(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return secret_scan.findings(docs, secret_scan.train(docs))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_periods(read(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listing = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.withColumn("_best", best)
    start, length, period = -F.col("_best.start"), F.col("_best.length"), -F.col("_best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(listing, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """The texts to be searched: where crc32(doc_id) ends in 0, the words from some place on repeat with some period."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in periodic_runs.parts_of(batches, "text"):
            texts = batch.column("text").to_pylist()
            for k, h in enumerate(batch.column("h").to_pylist()):
                if h is not None and h % 10 == 0 and (words := (texts[k] or "").encode().split()):
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[k] = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    hashed = docs.select("doc_id", F.col("text").cast("string"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    return hashed.mapInArrow(work, "doc_id long, text string")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    index = line_dedup.LineIndex.create(spark, min_docs=10, min_chars=1).insert(docs)
    return index.drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build(read(spark, sf_dir, "documents"))
    return lexical_search.search(index, read(spark, sf_dir, "benchmark"), top=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_chat": op4_chat,
    "op5_mixing": op5_mixing,
    "op6_hilbert_shards": op6_hilbert_shards,
    "op7_near_dedup": op7_near_dedup,
    "op8_packing": op8_packing,
    "op9_line_quality": op9_line_quality,
    "op10_secret_scan": op10_secret_scan,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_line_dedup": op12_line_dedup,
    "op13_lexical_search": op13_lexical_search,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op9_line_quality": line_quality.ORACLE,
    "op12_line_dedup": line_dedup.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
