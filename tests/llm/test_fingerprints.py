import hashlib

import numpy as np
import pyarrow as pa
import pytest

from glyphgrove.llm import fingerprints, minhash
from glyphgrove.llm.common import distinct_sets, shingle_hashes, word_hashes
from tests.llm.conftest import ODD, shingles, words


def test_word_and_shingle_hashes_follow_the_word_rule():
    texts = ["One  two\tONE", "", " \n", "two", None, "É é"]
    hashes, counts = word_hashes(pa.array([t or "" for t in texts]))
    assert counts.tolist() == [len(words(t)) for t in texts]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and hashes[4] != hashes[5]
    for size in (1, 2, 5):
        sets, sizes = distinct_sets(*shingle_hashes(hashes, counts, size))
        assert sizes.tolist() == [len(shingles(t, size)) for t in texts]


def test_every_bin_is_filled_and_equal_sets_agree():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 100, 5000):
        one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        minima = minhash.densify(minhash.bin_minima(np.concatenate([one, one]), np.array([len(one)] * 2), 64))
        assert (minima != minhash.EMPTY).all() and (minima[0] == minima[1]).all()
    empty = minhash.densify(minhash.bin_minima(np.zeros(0, np.uint64), np.array([0]), 64))
    assert (empty == minhash.EMPTY).all()


def test_bits_survive_packing():
    values = np.arange(64, dtype=np.uint64).reshape(2, 32)
    for bits in (1, 2, 4, 8):
        packed = minhash.pack_bits(values, bits)
        assert packed.shape == (2, 32 * bits // 8)
        assert (minhash.unpack_bits(packed, bits) == values % (1 << bits)).all()


@pytest.mark.parametrize("share", [0.0, 0.3, 0.8, 1.0])
@pytest.mark.parametrize("size", [12, 60, 2000])
def test_likeness_is_unbiased(share, size):
    rng = np.random.default_rng(int(share * 10) + size)
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 1 << 62, 2 * size).astype(np.uint64) * np.uint64(4)
        both = int(share * size)
        a, b = np.unique(pool[:size]), np.unique(np.concatenate([pool[:both], pool[size : 2 * size - both]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        rows = [minhash.pack_bits(minhash.per_bin(minhash.densify(
            minhash.bin_minima(s, np.array([len(s)]), 512))), 4) for s in (a, b)]
        errors.append(minhash.likeness(*rows, 4)[0] - true)
    assert abs(np.mean(errors)) < 0.04 and np.abs(errors).max() < 0.35


def expect(rows):
    """doc_id, text of every row, and the next document's least text."""
    ids = sorted({r[0] for r in rows}, key=lambda x: (x is not None, x or 0))
    least = {i: min((r[1] or "" for r in rows if r[0] == i), key=lambda t: t.encode()) for i in ids}
    after = {i: least[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)}
    out = []
    for r in rows:
        text, cut = r[1] or "", len(r[1] or "") // 4
        edited = text[: len(text) - cut] + after[r[0]][:cut]
        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, after[r[0]]))
    return out


def agrees(found, wanted):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    found = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r) for r in found), key=key)
    wanted = sorted(wanted, key=key)
    assert [f[:3] for f in found] == [w[:3] for w in wanted]
    by_text = {}
    for (_, _, _, r), (_, _, _, text, edited, after) in zip(found, wanted, strict=True):
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        for near, other in ((r["near_edited"], edited), (r["near_next"], after)):
            a, b = shingles(text, 5), shingles(other, 5)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - true) < 0.2, (near, true, text[:80], other[:80])


def test_edit_probe_equals_brute_force(documents):
    rows = [tuple(r) for r in documents.collect()]
    agrees(fingerprints.edit_probe(documents).collect(), expect(rows))


def test_edit_probe_on_odd_rows(odd, nothing):
    agrees(fingerprints.edit_probe(odd).collect(), expect(ODD))
    assert fingerprints.edit_probe(nothing).count() == 0
    one = odd.where("doc_id = 5")
    assert fingerprints.edit_probe(one).count() == 1


def test_fingerprint_column(odd):
    found = fingerprints.fingerprint(odd, out="_row").collect()
    assert len(found) == len(ODD) and all(len(r["_row"]) == 256 for r in found)
    assert len({bytes(r["_row"]) for r in found if r["doc_id"] in (1, 5)}) == 1
