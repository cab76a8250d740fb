"""Saved clusterings: JSON with a list of id lists, and parquet assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Ids in one written document.
DOCUMENT_ROWS = 100_000


def read_clusters_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``(cluster, id)`` of objects ``{"clusters": [[ids], ...]}``, one per line.

    ``multi_line`` reads files that hold one object spread over several lines.
    """
    reader = spark.read.schema("clusters array<array<bigint>>")
    raw = reader.option("multiLine", multi_line).json(path)
    return raw.select(F.posexplode("clusters").alias("cluster", "ids")).select(
        "cluster", F.explode("ids").alias("id")
    )


def write_clusters_json(
    assignment: DataFrame, path: str, k: int, document_rows: int = DOCUMENT_ROWS
) -> None:
    """The same form; the ids are spread over documents of about ``document_rows`` ids each."""
    total = assignment.agg(F.count(F.lit(1)).alias("n")).scalar()
    documents = F.greatest(F.ceil(total / document_rows), F.lit(1)).cast("bigint")
    lists = (
        assignment.withColumn("document", F.pmod(F.xxhash64("id"), documents))
        .groupBy("document", "pos")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .groupBy("document")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "ids"))).alias("_m"))
    )
    every = F.sequence(F.lit(0), F.lit(k - 1))
    empty = F.array().cast("array<bigint>")
    filled = F.transform(every, lambda p: F.coalesce(F.try_element_at("_m", p), empty))
    lists.select(filled.alias("clusters")).write.json(path)


def write_assignment(assignment: DataFrame, path: str) -> None:
    assignment.write.partitionBy("node_id").parquet(path)


def read_assignment(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
