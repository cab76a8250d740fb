import hashlib
import random
import zlib

import numpy as np
import pytest

from glyphgrove.llm import periodic_runs as P
from glyphgrove.llm.queries import op11_periodic_runs
from tests.llm.conftest import ODD


def brute(words):
    """All runs by comparing the words of every period."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(6, 4 * q) and not any(
                all(words[x] == words[x + d] for x in range(start, start + length - d)) for d in range(1, q)
            ):
                out.add((start, length, q))
            i = j + 1
    return sorted(out)


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def some_text(rng, kinds):
    n = rng.choice([0, 3, 6, 7, 40, 200, 700])
    words = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 20:
            a = rng.randrange(n - 10)
            p = 1 + rng.randrange(max(1, (n - a) // 4))
            for i in range(a + p, min(n, a + p * rng.randrange(3, 9) + rng.randrange(p))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("kinds", [1, 2, 3, 50])
def test_runs_of_random_texts_equal_brute_force(kinds):
    rng = random.Random(kinds)
    texts = [[w.encode() for w in some_text(rng, kinds)] for _ in range(40)]
    runs = [[] for _ in texts]
    P._solve_group(texts, list(range(len(texts))), runs)
    for words, found in zip(texts, runs, strict=True):
        assert sorted(found) == brute(words)


def test_nested_and_touching_runs():
    inner = ["a", "b"] * 4 + ["c"]
    words = ["x"] * 7 + inner * 5 + ["y"] * 2 + ["z q".split()[0]] * 6
    codes = P._coded([w.encode() for w in words])
    assert P._rows(P.solve(codes, range(0, 5))) == brute(words)


def small_tiles(monkeypatch):
    monkeypatch.setattr(P, "CORE", 64)
    monkeypatch.setattr(P, "FIRST", 3)
    monkeypatch.setattr(P, "STRETCH", 4)
    monkeypatch.setattr(P, "SMALL_OCTAVE", 2)


@pytest.mark.parametrize("kinds", [1, 2, 4])
def test_tiles_show_every_run_once(monkeypatch, kinds):
    """Each run is told whole by one tile, or its pieces meet."""
    small_tiles(monkeypatch)
    rng = random.Random(10 + kinds)
    for _ in range(25):
        words = [w.encode() for w in some_text(rng, kinds)]
        codes, whole, pieces = P._coded(words), [], {}
        for low, high, core, a, b in P.tile_plan(len(codes)):
            for q, s, e, first, last, is_whole in P.tile_fragments(codes[a:b], len(codes), low, high, core, a):
                if is_whole:
                    whole.append((s, e, q))
                else:
                    pieces.setdefault(q, []).append((s, e, first, last))
        assert len(whole) == len(set(whole))
        for q, own in pieces.items():
            group = None
            for s, e, first, last in [*sorted(own), (1 << 60, 1 << 60, True, True)]:
                if group and s + q <= group[1]:
                    group = (group[0], *max((group[1], group[3]), (e, last))[:1], group[2],
                             max((group[1], group[3]), (e, last))[1])
                    continue
                if group and group[2] and group[3]:
                    whole.append((group[0], group[1], q))
                group = (s, e, first, last)
        assert P._rows(set(whole)) == brute(words)


def test_long_texts_are_stitched(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(150_000)]
    for a, p, times in ((10_000, 30_000, 4), (135_000, 1, 9_000), (2_000, 700, 9)):
        for i in range(a + p, min(len(base), a + p * times + 3)):
            base[i] = base[i - p]
    texts = [" ".join(base), " ".join(base), "one two " * 70_000, "plain"]  # the first two are copies
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    long = {r["doc_id"]: r for r in P.find_runs(docs).collect()}
    short = {r["doc_id"]: r for r in P.find_runs(docs, long_chars=1 << 30).collect()}
    assert long == short and len(long) == 4
    assert [tuple(r) for r in long[2]["runs"]] == [(0, 140_000, 2)] and long[2]["collapsed"] == "one two"
    assert {r["period"] for r in long[0]["runs"]} >= {700, 1, 30_000}


def test_query_equals_brute_force(spark):
    rows = {r["doc_id"]: r for r in op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        codes = P._coded(words)
        runs = []
        for q in range(1, n // 4 + 1):
            same = np.flatnonzero(codes[:-q] == codes[q:])
            first = np.flatnonzero(np.diff(same, prepend=-2) != 1)
            for s, k in zip(same[first].tolist(), np.diff(np.append(first, len(same))).tolist(), strict=True):
                stretch = codes[s : s + k + q]
                if len(stretch) >= max(6, 4 * q) and not any(
                    np.array_equal(stretch[d:], stretch[:-d]) for d in range(1, q)
                ):
                    runs.append((s, len(stretch), q))
        runs.sort()
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        got = rows[doc_id]
        assert got["n_runs"] == len(runs)
        if best:
            assert (got["start"], got["length"], got["period"]) == best
            assert got["exponent_milli"] == 1000 * best[1] // best[2]
        else:
            assert got["start"] is got["length"] is got["period"] is got["exponent_milli"] is None
        listing = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        assert got["runs_sha256"] == hashlib.sha256(listing.encode()).hexdigest()
        assert got["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()


def test_odd_rows(spark, odd, nothing):
    found = P.find_runs(odd.withColumnRenamed("_row", "runs"))
    assert found.columns[-3:] == ["n_words", "runs", "collapsed"] and found.count() == len(ODD)
    for r in found.collect():
        words = [o[1] for o in ODD if o[0] == r["doc_id"]][0]
        words = (words or "").encode().split()
        assert r["n_words"] == len(words)
        if r["doc_id"] == 7:
            assert [tuple(x) for x in r["runs"]] == [(0, 80_000, 2)] and r["collapsed"] == "long words"
        else:
            assert r["runs"] == [] and r["collapsed"] == b" ".join(words).decode()
    assert P.find_runs(nothing).count() == 0


def test_batches_are_solved_in_parts():
    """A batch of many texts goes through a few megabytes at a time; the rows are the same."""
    import pyarrow as pa
    from pyspark.sql import types as T

    texts = [None, "", *(f"a{k} b c " * 4_000 for k in range(200))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()),
        T.StructField("runs", P.RUNS), T.StructField("collapsed", T.StringType())])
    parts = list(P._solve_short("text", schema)(iter([batch])))
    assert len(parts) > 2
    got = [r for p in parts for r in p.to_pylist()]
    assert [r["id"] for r in got] == list(range(len(texts)))
    assert got[0]["n_words"] == got[1]["n_words"] == 0
    for r in got[2:]:
        assert r["n_words"] == 12_000 and r["collapsed"].endswith("b c")
        assert r["runs"] == [{"start": 0, "length": 12_000, "period": 3}]
