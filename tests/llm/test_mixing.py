from collections import defaultdict

import numpy as np
import pytest

from glyphgrove.llm import mixing
from tests.llm.conftest import ODD, words


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000])
def test_permutation_and_its_inverse(n):
    for key in (0, 5, 2**63):
        keys = np.full(n, key, np.uint64)
        order = mixing.permute(np.arange(n), np.full(n, n), keys)
        assert sorted(order.tolist()) == list(range(n))
        assert order[mixing._position(n, np.array([key], np.uint64))] == n - 1


def goals(sizes, weights=(3, 1, 2), share=1.5, passes=2):
    """Targets by filling up step by step."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= passes * sizes[s]}
        if not full:
            out |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            out[s] = passes * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    want = goals(sizes)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append((r["source"], len(words(r["text"]))))
    found = mixing.amounts(docs).collect()
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for r in found:
        source, size = by_id[r["doc_id"]][0]
        assert r["size"] == size and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source]) and 0 <= r["taken"] <= 2 * size
        taken[source] += r["taken"]
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= 0.5 + 1e-6
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(found, key=key) == sorted(mixing.amounts(docs.repartition(5)).collect(), key=key)
    return sum(taken.values())


def test_amounts_meet_their_targets(documents):
    check(documents)


def test_mixture_holds_the_words_taken(documents):
    total = sum(r["taken"] for r in mixing.amounts(documents).collect())
    found = mixing.mixture(documents)
    assert found.columns == documents.columns
    originals = {r["doc_id"]: r["text"] for r in documents.collect()}
    count = 0
    for r in found.collect():
        assert r["text"] in originals[r["doc_id"]] and r["n_chars"] == len(r["text"])
        count += len(words(r["text"]))
    assert count == total


def test_odd_rows(odd, nothing):
    check(odd)
    found = mixing.mixture(odd)
    assert found.columns == odd.columns
    assert {r["doc_id"] for r in found.collect()} <= {o[0] for o in ODD if words(o[1])}
    assert mixing.amounts(nothing).count() == 0 and mixing.mixture(nothing).count() == 0


def test_slots_of_every_shard_are_numbered_without_gaps(documents):
    sources = mixing.targets(mixing.number_rows(documents.selectExpr("doc_id", "source", "n_chars as size")))
    keyed = sources.selectExpr("xxhash64(source) as key", "source_size as size", "target")
    rows = mixing.slots(keyed, block=64, shard_slots=50).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["key"]].append(r)
    for r in keyed.collect():
        own = by[r["key"]]
        assert sorted(x["slot"] for x in own) == list(range(len(own)))
        assert abs(sum(x["words"] for x in own) - r["target"]) <= 0.5 + 1e-6
        assert len({(x["pass"], x["block"]) for x in own}) == len(own)
    assert len({r["shard"] for r in rows}) > 1


def test_shards_have_their_fixed_size_and_mix_all_sources(spark):
    sizes = {1: 64_000, 2: 128_000, 3: 32_000}
    keyed = spark.createDataFrame([(k, n, float(n)) for k, n in sizes.items()], "key long, size long, target double")
    rows = mixing.slots(keyed, block=64, shard_slots=500).collect()
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    assert sorted(shards) == list(range(7))
    assert all(len(shards[k]) == 500 for k in range(7))
    assert all(sorted(x["place"] for x in v) == list(range(500)) for v in shards.values())
    # counts of a source in a shard: drawn without replacement, so near 500 times its share
    for key, n in sizes.items():
        p = n / sum(sizes.values())
        counts = [sum(x["key"] == key for x in v) for v in shards.values()]
        assert len(set(counts)) > 1 and all(abs(c - 500 * p) < 5 * (500 * p * (1 - p)) ** 0.5 for c in counts)
        assert sum(counts) == n // 64


def test_chunks_change_nothing(spark, monkeypatch):
    keyed = spark.createDataFrame([(5, 9_999, 12_345.0), (9, 700, 60.0)], "key long, size long, target double")
    whole = sorted(map(tuple, mixing.slots(keyed, block=16, shard_slots=100).collect()))
    monkeypatch.setattr(mixing, "CHUNK", 7)
    assert sorted(map(tuple, mixing.slots(keyed, block=16, shard_slots=100).collect())) == whole
