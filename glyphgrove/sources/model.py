"""A trained vocabulary as parquet tables: levels, nodes, members, words, weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrove.operators.tree import Tree, children, level_vectors, words


@dataclass
class Model:
    levels: DataFrame
    nodes: DataFrame
    children: DataFrame
    words: DataFrame
    weights: DataFrame
    depth: int


TABLES = ["levels", "nodes", "children", "words", "weights"]


def build_model(tree: Tree, weights: DataFrame, words_: DataFrame | None = None) -> Model:
    return Model(
        level_vectors(tree), tree.nodes, children(tree), words_ or words(tree), weights, tree.depth
    )


def write_model(model: Model, path: str) -> None:
    for table in TABLES:
        getattr(model, table).write.mode("overwrite").parquet(f"{path}/{table}")


def read_model(spark: SparkSession, path: str) -> Model:
    tables = {table: spark.read.parquet(f"{path}/{table}") for table in TABLES}
    depth = tables["nodes"].agg(F.max("depth")).first()[0]
    return Model(**tables, depth=depth)
