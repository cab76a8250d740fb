"""Vocabulary text: a header, then ``a b v0 ... vn c d`` per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens before and after the vector on each line.
LEAD = 2
TRAIL = 2


def read_vocabulary(
    spark: SparkSession, path: str, dimension: int | None = 32, dedup: bool = False
) -> DataFrame:
    """``(vector)`` rows, each vector once with ``dedup``. ``dense_ids`` gives them numbers.

    The header is recognised by its four tokens, so files can be split freely; blank lines are passed
    over. ``dimension=None`` accepts any line with at least one vector element. Any other line raises an
    error when the rows are read: none is left out in silence.
    """
    tokens = F.split("value", " ", -1)
    width = F.size("tokens") - LEAD - TRAIL
    fits = width == dimension if dimension else width > 0
    skipped = (F.size("tokens") == LEAD + TRAIL) | (F.trim("value") == "")
    wrong = F.raise_error(F.concat(F.lit("bad vocabulary line: "), F.col("value"))).cast("boolean")
    valid = F.when(fits, True).when(skipped, False).otherwise(wrong)
    vectors = (
        spark.read.text(path)
        .select("value", tokens.alias("tokens"))
        .filter(valid)
        .select(
            F.transform(
                F.slice("tokens", F.lit(LEAD + 1), width), lambda t: t.cast("int")
            ).alias("vector")
        )
    )
    return vectors.distinct() if dedup else vectors


def write_vocabulary(df: DataFrame, path: str, header: str = "10 6 0 0") -> None:
    """The text form of ``(vector)`` rows, one header line per file part."""
    lines = df.select(
        F.concat_ws(
            " ", F.lit("0"), F.lit("1"), F.transform("vector", lambda x: x.cast("string")),
            F.lit(""), F.lit("0.5"),
        ).alias("value")
    )
    head = df.sparkSession.createDataFrame([(header,)], "value string")
    head.unionByName(lines).write.text(path)
