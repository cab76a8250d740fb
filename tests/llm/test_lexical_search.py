import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glyphgrove.llm import lexical_search as S
from tests.llm.conftest import LOWER, ODD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, top):
    """(query, rank, doc_id, score) in plain integers."""
    held = [Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in held for t in c)
    out = []
    for k, (_, text) in enumerate(queries):
        found = []
        for (doc_id, _), c, size in zip(docs, held, sizes, strict=True):
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    m = 100 - 25 + (25 * size * n) // total
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(k, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:top])]
    return out


def searched(spark, docs, queries, top=20, parts=3):
    index = S.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts))
    items = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(queries)], "item_id long, text string")
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in S.search(index, items, top).collect())


def corpus(seed, n=400, vocabulary=300):
    rng = random.Random(seed)
    word = lambda: f"t{int(vocabulary * rng.random() ** 3)}"
    docs = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 5, 60, 900])))) for k in range(n)]
    docs += [(n + k, docs[k % 7][1]) for k in range(60)]
    queries = [(k, ", ".join(word() for _ in range(rng.randrange(1, 30)))) for k in range(15)]
    return docs, queries


@pytest.mark.parametrize("top", [1, 20])
def test_results_equal_brute_force(spark, top):
    docs, queries = corpus(top)
    assert searched(spark, docs, queries, top) == brute(docs, queries, top)


def test_partitions_and_query_blocks_change_nothing(spark, monkeypatch):
    docs, queries = corpus(3, 150)
    want = brute(docs, queries, 5)
    monkeypatch.setattr(S, "QUERY_BYTES", 200)
    assert searched(spark, docs, queries, 5, 1) == want == searched(spark, docs, queries, 5, 13)


def test_bounds_hold_and_spare_most_documents(spark):
    docs, queries = corpus(4, 800, 3000)
    index = S.build(spark.createDataFrame(docs, "doc_id long, text string"))
    table = index.rows.toArrow().combine_chunks()
    batch = table.to_batches()[0]
    for row, sketch in zip(batch.to_pylist(), batch.column("sketch").to_pylist(), strict=True):
        cells = np.frombuffer(sketch, np.uint8)
        if row["terms"]:
            own = np.array(row["terms"], np.int64).view(np.uint64)
            for at in S._cells_of(own, len(cells)):
                assert (cells[at].astype(np.int64) * S.STEP >= row["impacts"]).all()
            assert len(cells) >= min(S.MOST, S.CELLS * len(own))
        else:
            assert len(cells) == 0
    made = []
    for _, text in queries:
        words, times = np.unique(S.token_hashes(pa.array([text]))[0], return_counts=True)
        made.append(S._Query(words, times * 1000))
    best = [S._Best(5) for _ in made]
    scored = S._search_batch(batch, made, best)
    assert scored < 0.5 * len(docs) * len(queries)


def test_ties_repeats_and_odd_texts(spark):
    docs = [(5, "a b"), (5, "a b"), (None, "a b"), (2, "a b"), (9, ""), (8, None), (7, "A! b? ünï"), (1, "c c c")]
    queries = [(0, "a a"), (1, ""), (2, None), (3, "nowhere"), (4, "ÜNÏ ünï"), (5, "c " * 3)]
    assert searched(spark, docs, queries, 4) == brute(docs, queries, 4)


def test_odd_rows(spark, odd, nothing):
    index = S.build(odd)
    items = spark.createDataFrame([(1, "words seven", 1), (1, "words seven", 2), (None, "text", 3)], "item_id int, text string, rank int")
    rows = S.search(index, items).collect()
    want = brute([(o[0], o[1]) for o in ODD], [(0, "words seven"), (1, "words seven"), (2, "text")], 20)
    assert sorted((r["score"], r["rank"]) for r in rows) == sorted((s, k) for _, k, _, s in want)
    assert {r["item_id"] for r in rows} == {1, None}
    assert S.search(index, items.limit(0)).count() == 0
    assert S.search(S.build(nothing), items).count() == 0
