import random
from collections import Counter

import pytest

from glyphgrove.llm import line_dedup as L
from tests.llm.conftest import LOWER, ODD

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(WHITE).translate(LOWER)


def brute(texts, min_docs, min_chars=1):
    held = Counter()
    for t in texts:
        held.update({k for k in map(key, (t or "").split("\n")) if len(k) >= min_chars and k})
    hot = {k for k, n in held.items() if n >= min_docs}
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        keep = [x for x in lines if key(x) not in hot]
        out.append(("\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def found(index, docs, **more):
    rows = index.drop_lines(docs, **more).collect()
    return [(r["text"], r["n_lines"], r["n_dropped"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def some_texts(seed, n=60):
    rng = random.Random(seed)
    lines = [f"line {k}" for k in range(30)] + ["", "  ", "Common Line", " common line\t", "É line", "é line", "\x85 x"]
    return [None if k == 7 else "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))) for k in range(n)]


def test_filter_holds_what_was_added_and_forgets_what_was_removed():
    rng = random.Random(1)
    digests = [rng.randbytes(16) for _ in range(3000)]
    held = L.CuckooFilter.holding(digests)
    raw = L._raw(digests)
    assert held.may_hold(raw).all() and held.keys == 3000
    others = L._raw([rng.randbytes(16) for _ in range(3000)])
    assert held.may_hold(others).mean() < 0.01
    for d in digests[:1500]:
        assert held.remove(d)
    assert held.may_hold(raw[1500:]).all() and held.may_hold(raw[:1500]).mean() < 0.01
    again = L.CuckooFilter.read(held.slots.tobytes(), held.keys)
    assert (again.may_hold(raw) == held.may_hold(raw)).all()
    for d in digests[1500:]:
        assert held.remove(d)
    assert not held.slots.any() and held.keys == 0
    # a filter that is full says so
    small = L.CuckooFilter.planned(1)
    assert not all(small.add(d) for d in digests[:100])


def test_decisions_equal_brute_force(spark):
    texts = some_texts(2)
    docs = frame(spark, texts)
    for min_docs, min_chars in ((10, 1), (3, 6), (1, 1)):
        index = L.LineIndex.create(spark, min_docs=min_docs, min_chars=min_chars, shards=3).insert(docs)
        assert found(index, docs) == brute(texts, min_docs, min_chars)
        # the same with nothing small enough to send, one shard a round
        assert found(index, docs, small_bytes=1) == brute(texts, min_docs, min_chars)


def test_inserts_and_deletes_are_reversible(spark, monkeypatch):
    monkeypatch.setattr(L, "DELTAS", 3)
    parts = [some_texts(k, 12) for k in range(6)]
    index = L.LineIndex.create(spark, min_docs=6, shards=2)
    for part in parts:
        index.insert(frame(spark, part))
    everything = [t for p in parts for t in p]
    docs = frame(spark, everything)
    assert found(index, docs) == brute(everything, 6)
    before = {bytes(r["key"]): r["docs"] for r in index.counts().collect()}
    extra = some_texts(99, 40)
    index.insert(frame(spark, extra))
    assert found(index, frame(spark, everything + extra)) == brute(everything + extra, 6)
    index.delete(frame(spark, extra))
    assert {bytes(r["key"]): r["docs"] for r in index.counts().collect()} == before
    assert found(index, docs) == brute(everything, 6)
    index.delete(frame(spark, parts[0])).delete(frame(spark, parts[3]))
    left = [t for k, p in enumerate(parts) if k not in (0, 3) for t in p]
    assert found(index, frame(spark, left)) == brute(left, 6)
    held = sum(r["keys"] for r in index.filters(index.state()).collect())
    assert held == index.hot().count() == index.state()["hot_keys"]
    for k in (1, 2, 4, 5):
        index.delete(frame(spark, parts[k]))
    assert index.counts().isEmpty() and index.state()["hot_keys"] == 0


def test_a_wrong_delete_changes_nothing(spark):
    index = L.LineIndex.create(spark, min_docs=1).insert(frame(spark, ["a\nb"]))
    with pytest.raises(ValueError):
        index.delete(frame(spark, ["a\nc"]))
    assert index.counts().count() == 2
    # another session of the same folder sees the same
    assert found(L.LineIndex(spark, index.folder), frame(spark, ["b\nd"])) == [("d", 2, 1)]


def test_shards_grow_with_the_keys(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 8)
    texts = [f"line {k}" for k in range(100)]
    index = L.LineIndex.create(spark, min_docs=1, shards=1).insert(frame(spark, texts[:50]))
    assert index.state()["shards"] >= 6
    index.insert(frame(spark, texts))
    assert found(index, frame(spark, texts)) == brute(texts, 1)


def test_odd_rows(spark, odd, nothing):
    texts = [o[1] for o in ODD]
    index = L.LineIndex.create(spark, min_docs=2).insert(odd)
    rows = index.drop_lines(odd.withColumnRenamed("_row", "n_lines")).collect()
    assert sorted((r["text"], r["n_lines"], r["n_dropped"]) for r in rows) == sorted(brute(texts, 2))
    assert index.drop_lines(nothing).count() == 0
    empty = L.LineIndex.create(spark).insert(nothing)
    assert empty.drop_lines(odd).count() == len(ODD) and empty.counts().isEmpty()
