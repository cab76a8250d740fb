import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrove.functions import vectors
from glyphgrove.operators import bow
from glyphgrove.plans import inputs
from glyphgrove.plans.queries import CATALOGUE

SIZE = 7


@pytest.fixture(scope="module")
def weighted(spark):
    """Every word, one without a weight, one of weight zero, a word twice in a row's frame, a row without a word."""
    rows = [(w // 3, w % 3, w, w / 8) for w in range(SIZE)]
    rows += [(9, 0, 2, None), (9, 1, 2, 0.5), (9, 1, 2, 0.5), (9, 2, None, 0.5), (None, 3, 6, -0.0)]
    rows += [(10, 0, 5, float("nan"))]
    return spark.createDataFrame(rows, "frame_id bigint, pos int, word_index bigint, weight double").repartition(3)


def listed(frame):
    rows = [tuple("nan" if v != v else v for v in r) for r in frame.collect()]
    return sorted(rows, key=str)


@pytest.mark.parametrize("block_bytes", [1, 8 * SIZE * 2, 1 << 20])
def test_words_as_the_column_form_gives_them(weighted, block_bytes):
    hot = vectors.one_hot(F.col("word_index"), F.coalesce("weight", F.lit(1.0)), SIZE)
    want = weighted.withColumn("hot", hot).select(
        "frame_id", "pos", "word_index", vectors.count_nonzero(F.col("hot")).alias("nonzero"),
        F.element_at("hot", (F.col("word_index") + 1).cast("int")).alias("weight"))
    got = bow.one_hot_words(weighted, SIZE, block_bytes)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    # of a row without a word, Spark would read whatever it keeps for null
    assert listed(got.filter("word_index is not null")) == listed(want.filter("word_index is not null"))
    assert listed(got.filter("word_index is null")) == [(9, 2, None, 0, None)]


def test_numpy_vectors_are_those_of_the_columns(spark):
    index, weight = np.array([0, 3, -1, 9]), np.array([2.5, 0.0, 1.0, 1.0])
    block = vectors.one_hot(index, weight, 5)
    rows = spark.createDataFrame([(int(i), float(w)) for i, w in zip(index, weight)], "i long, w double")
    hot = rows.select(vectors.one_hot(F.col("i"), F.col("w"), 5).alias("hot"))
    assert block.tolist() == [r.hot for r in hot.collect()]
    counted = [r[0] for r in hot.select(vectors.count_nonzero(F.col("hot"))).collect()]
    assert vectors.count_nonzero(block).tolist() == counted == [1, 0, 0, 0]
    assert vectors.count_nonzero(np.array([[1, 0, 4], [0, 0, 0], [np.nan, -0.0, -2]])).tolist() == [2, 0, 2]


def test_no_array_lambda_over_vectors_as_long_as_the_vocabulary(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 16)).astype(np.float32))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = CATALOGUE["word_onehot"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
    words = {r.word_id: r.word_index for r in inputs.tree_vocabulary(spark, str(tmp_path))[1].collect()}
    quantised = inputs.tree_words(spark, str(tmp_path)).collect()
    used = [words[r.word_id] for r in quantised]
    assert listed(found) == sorted(
        [(r.frame_id, r.pos, w, 1, round(used.count(w) / 200, 6)) for r, w in zip(quantised, used)], key=str)
