from pyspark.sql import functions as F

from glyphgrove import runtime
from glyphgrove.functions import vectors


def test_scratch_tables_are_noted_and_deleted(spark):
    def there(path):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)

    outer = runtime.materialise(spark.range(3), "outer")
    with runtime.collecting([]) as paths:
        a = runtime.materialise(spark.range(5), "a")
        with runtime.collecting([]) as inner:
            b = runtime.materialise(spark.range(6), "b")
    c = runtime.materialise(spark.range(7), "c")
    assert len(paths) == len(inner) == 1 and a.count() == 5 and b.count() == 6
    runtime.delete_scratch(spark, paths)
    assert not there(paths[0]) and there(inner[0])
    assert outer.count() == 3 and c.count() == 7
    runtime.release(c)
    assert not there(c._scratch)


def test_unbounded_tables_are_not_sent_to_all(spark):
    rows = spark.createDataFrame([(k % 3, k) for k in range(30)], "word long, n long")
    table = spark.createDataFrame([(k, f"w{k}") for k in range(3)], "word long, name string")
    for options in ({}, {"hot": True}):
        met = runtime.lookup_join(rows, table, ["word"], **options)
        assert sorted(map(tuple, met.select("n", "name").collect())) == [(k, f"w{k % 3}") for k in range(30)]
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    small = runtime.lookup_join(rows, table, ["word"], table_bytes=100)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()


def test_one_hot_keeps_long_vectors_out_of_the_plan(spark):
    rows = spark.createDataFrame([(0,), (3,), (None,), (9,)], "i long")
    hot = [vectors.one_hot(F.col("i"), F.lit(2.5), size).alias("hot") for size in (5, 100_000)]
    want = [[2.5 if j == i else 0.0 for j in range(5)] for i in (0, 3, None, 9)]
    assert [r["hot"] for r in rows.select(hot[0]).collect()] == want
    assert len(rows.select(hot[1])._jdf.queryExecution().optimizedPlan().toString()) < 2_000
