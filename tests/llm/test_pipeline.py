import corpus_pipeline
from glyphgrove.llm import toxicity
from glyphgrove.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import shingles

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near duplicates", "secrets", "mixing", "packing"]
    docs, seen = documents, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow(), documents.schema)
        assert docs.columns == documents.columns
        seen.append(docs.collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(documents, toxicity.train(documents, labels)).collect()}
    assert {r["doc_id"] for r in seen[0]} == {i for i, s in scores.items() if s < toxicity.REJECT}
    # no two documents left are near duplicates, and each one that went has a partner
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in seen[0]}
    left = [r["doc_id"] for r in seen[1]]
    linked = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    assert not any(sets[a] and linked(sets[a], sets[b]) for k, a in enumerate(left) for b in left[:k])
    gone = set(sets) - set(left)
    assert all(any(linked(sets[g], sets[o]) for o in sets if o != g) for g in gone)
    assert {r["doc_id"] for r in seen[2]} == set(left)


def test_run_gives_packed_pieces(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(len(r["ids"]) == r["length"] <= 1024 for r in rows)


def test_catalogue():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_a_stage_deletes_the_scratch_tables_of_the_one_before(spark, documents):
    own = lambda: list(corpus_pipeline._left[spark.sparkContext.applicationId])

    def there(path):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)

    small = documents.limit(40)
    first = corpus_pipeline.near_duplicates(spark, small, SF)
    left = own()
    assert left and all(map(there, left))
    # its result was not written: the next stage still reads some of these tables, which stay
    corpus_pipeline.mix(spark, first, SF).count()
    kept = [p for p in left if there(p)]
    assert kept and set(kept) <= set(own())
    written = spark.createDataFrame(small.toArrow(), documents.schema)
    corpus_pipeline.mix(spark, written, SF)
    assert not any(map(there, left))


def test_a_stage_sends_workers_few_bytes_at_once(spark):
    texts = spark.range(4000, numPartitions=1).selectExpr("id doc_id", "repeat('lorem ipsum ', 1000) text")
    corpus_pipeline.mix(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)

    def count(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    most = max(r["n"] for r in texts.mapInArrow(count, "n long").collect())
    assert most < 2 * corpus_pipeline.BATCH_BYTES
