import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrove.functions import metrics, paths, vectors


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(rng.integers(0, 256, 32).tolist(), rng.integers(0, 256, 32).tolist()) for _ in range(20)]
    rows.append((rows[0][0], rows[0][0]))
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    got = df.select(
        "a", "b", metrics.hamming(a, b).alias("h"), metrics.l1(a, b).alias("l1"),
        metrics.l2sq(a, b).alias("sq"), metrics.l2(a, b).alias("l2"),
        metrics.percent_equal(a, b).alias("p"),
    ).collect()
    for r in got:
        x, y = np.array(r.a), np.array(r.b)
        assert r.h == (x != y).sum()
        assert r.l1 == np.abs(x - y).sum()
        assert r.sq == ((x - y) ** 2).sum()
        assert r.l2 == pytest.approx(np.linalg.norm(x - y))
        assert r.p == pytest.approx(100 * (x == y).mean())


def test_small_types_do_not_wrap(spark):
    df = spark.sql("select array(cast(-100 as tinyint)) a, array(cast(100 as tinyint)) b")
    assert df.select(metrics.l1(F.col("a"), F.col("b"))).first()[0] == 200


def test_unknown_metric():
    with pytest.raises(ValueError, match="unknown metric"):
        metrics.resolve("cosine")


def test_registry_takes_custom_metrics():
    metrics.register(metrics.custom("chebyshev-ish", metrics.l1))
    assert metrics.resolve("chebyshev-ish").additive is None


def test_paths(spark):
    df = spark.createDataFrame([("3-0-7",), ("3",), ("12-4",)], "p string")
    p = F.col("p")
    got = [
        tuple(r)
        for r in df.select(
            paths.ancestor(p), paths.ancestor(p, 2), paths.prefixes(p), paths.steps(p),
            paths.child(p, F.lit(5)),
        ).collect()
    ]
    assert got == [
        ("3-0", "3", ["root", "3", "3-0"], [3, 0, 7], "3-0-7-5"),
        ("root", "root", ["root"], [3], "3-5"),
        ("12", "root", ["root", "12"], [12, 4], "12-4-5"),
    ]
    assert spark.range(1).select(paths.child(F.lit("root"), F.lit(2))).first()[0] == "2"


def test_vector_helpers(spark):
    df = spark.sql("select array(1, 0, 4) v, map(1, 0.5D) m")
    row = df.select(
        vectors.to_key(F.col("v")), vectors.from_key(vectors.to_key(F.col("v"))),
        vectors.count_nonzero(F.col("v")), vectors.root(F.col("v")),
        vectors.one_hot(F.lit(1), F.lit(0.25), 3), vectors.dense(F.col("m"), 3),
        vectors.floor_cents(F.lit(0.567)),
    ).first()
    assert tuple(row) == (
        "1.0.4", [1, 0, 4], 2, [1.0, 0.0, 2.0], [0.0, 0.25, 0.0], [0.0, 0.5, 0.0], 0.56
    )
