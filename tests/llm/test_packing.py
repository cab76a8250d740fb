import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glyphgrove.llm import packing
from tests.llm.conftest import ODD


def fewest(lengths, capacity):
    """The least number of sequences, by brute force."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] >= lengths[k] and bins[i] not in bins[:i]:
                go(k + 1, bins[:i] + [bins[i] - lengths[k]] + bins[i + 1 :])
        go(k + 1, [*bins, capacity - lengths[k]])

    go(0, [])
    return best


def counted(patterns):
    out = defaultdict(int)
    for p in patterns:
        for x, n in p.items:
            out[x] += n * p.times
    return dict(out)


@pytest.mark.parametrize("seed", range(25))
def test_bin_completion_finds_the_optimum_of_small_problems(seed):
    rng = random.Random(seed)
    capacity = 50
    lengths = [rng.randint(5, 45) for _ in range(rng.randint(1, 11))]
    histogram = {x: lengths.count(x) for x in lengths}
    found = packing.bin_completion(histogram, capacity)
    assert counted(found) == histogram
    assert all(sum(x * n for x, n in p.items) <= capacity for p in found)
    counts = np.zeros(capacity + 1, int)
    for x, n in histogram.items():
        counts[x] = n
    least = fewest(lengths, capacity)
    assert packing.lower_bound(counts, capacity) <= least == sum(p.times for p in found)


def test_large_histograms_come_close_to_the_bound():
    rng = np.random.default_rng(1)
    histogram = {k: int(n) for k, n in enumerate(rng.integers(0, 5000, 1023), 1)}
    found = packing.bin_completion(histogram)
    counts = np.array([0, *histogram.values(), 0])
    bound = packing.lower_bound(counts, 1024)
    assert counted(found) == {k: n for k, n in histogram.items() if n}
    assert bound <= sum(p.times for p in found) <= bound * 1.005 + 1
    assert packing.bin_completion({}) == []


SLOW = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", [
    "", " ", "plain words, and 123 numbers!", "x" * 5000, "\n\n \t", "it's we'll", "naïve Ünïcode été", "Привет мир",
    "日本語 テキスト", "مرحبا", "emoji 😀 👩‍🚀", "a<|endoftext|>b", "   wide", "ab1" * 4000, "\x00\x1c"])
def test_ids_are_those_of_tokenizers(text):
    got = packing.encode([text], "byte_bpe_50k.json", "byte_bpe_50k.tiktoken")[0]
    assert got.tolist() == SLOW.encode(text, add_special_tokens=False).ids


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    found = packing.pack(docs, keep_ids=True)
    pieces = found.collect()
    by_sequence = defaultdict(list)
    for p in pieces:
        assert 1 <= p["length"] <= 1024 and len(p["ids"]) == p["length"]
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    want = defaultdict(list)
    for r in rows:
        want[r["doc_id"]].append([*SLOW.encode(r["text"] or "", add_special_tokens=False).ids, 2])
    got = defaultdict(list)
    for p in pieces:
        got[p["doc_id"]].append(p)
    for name, texts in want.items():
        own = sorted(got[name], key=lambda p: p["piece"])
        assert sum(p["length"] for p in own) == sum(map(len, texts))
        if len(texts) == 1:
            ids, at = [], 0
            for k, p in enumerate(own):
                assert p["piece"] == k and p["start"] == at and (k == 0 or p["length"] == 1024)
                at += p["length"]
                ids += p["ids"]
            assert ids == texts[0]
    whole = packing.sequences(found).collect()
    assert len(whole) == len(by_sequence)
    assert sum(len(s["ids"]) for s in whole) == sum(p["length"] for p in pieces)
    return len(by_sequence), sum(p["length"] for p in pieces)


def test_documents_are_packed(documents):
    sequences, tokens = check(documents)
    assert sequences <= -(-tokens // 1024) * 1.02 + 2


def test_odd_rows(odd, nothing):
    check(odd)
    assert len(ODD) <= packing.pack(odd).count()
    assert packing.pack(nothing).count() == 0
