from glyphgrove.llm import near_dedup
from glyphgrove.llm.components import components as graph_components
from tests.llm.conftest import ODD, components, shingles


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (7, 7)]
    found = {r["node"]: r["root"] for r in graph_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}
    assert graph_components(spark.createDataFrame([], "u long, v long")).count() == 0


def check(docs, shingle):
    rows = docs.select("doc_id", "text").collect()
    want = components([r["doc_id"] for r in rows], [shingles(r["text"], shingle) for r in rows])
    found = near_dedup.near_duplicates(docs, shingle=shingle).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    sizes = {r["doc_id"]: len(shingles(r["text"], shingle)) for r in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_equal_brute_force(documents):
    check(documents, 2)


def test_groups_of_edited_copies(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 40):
        changed = list(base)
        for j in range(k % 5):
            changed[(k * 7 + j * 29) % 120] = f"new{k}_{j}"
        rows.append((k, " ".join(changed)))
    rows += [(100 + k, f"tiny text {k % 3}") for k in range(9)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 2)


def test_odd_rows(odd, nothing):
    found = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])
             for r in near_dedup.near_duplicates(odd).collect()]
    assert len(found) == len(ODD)
    assert found.count((1, 3, 1, True)) == 2 and (5, 3, 1, False) in found
    assert {f for f in found if f[0] in (2, 3, 4)} == {(2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True)}
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_deduplicate_keeps_one_of_each_group(odd, nothing):
    kept = near_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is not None, x))
    assert ids == [None, 1, 2, 3, 4, 6, 7, 8]
    assert near_dedup.deduplicate(nothing).count() == 0


def test_unlinked_members_of_a_large_group_are_joined_exactly(spark):
    """Without any drawn centre only the exact join can find links between members that are not centres."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(60):
        pair = list(base)
        # each pair of documents shares edits that part it from all others; its two members differ by a little
        for j in range(26):
            pair[(k * 3 + j * 7) % 200] = f"pair{k}_{j}"
        other = list(pair)
        other[(k * 5) % 200], other[(k * 5 + 90) % 200] = f"x{k}", f"y{k}"
        rows += [(2 * k, " ".join(pair)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = components([r[0] for r in rows], [shingles(r[1], 1) for r in rows])
    assert len(set(want.values())) == 60
    # one-row bands make every member share buckets with all others, so stars see few of the true links
    for draws in (0, 4):
        found = near_dedup.near_duplicates(docs, shingle=1, bands=4, rows=1, draws=draws).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == want


def test_deduplicate_goes_by_row_not_by_id(spark):
    first, second, third = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(None, first), (None, second), (None, third), (None, third), (5, second + " more"), (5, "own words only here"),
            (6, first), (6, "words of another text"), (None, "")]
    kept = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([
        (0, third), (5, second + " more"), (5, "own words only here"), (6, first), (6, "words of another text"), (0, "")])


def test_parities_never_differ_in_more_cells_than_the_sets_in_shingles():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = []
    for n in (0, 1, 5, 130, 130, 700, 5000):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for part in (0, 0.02, 0.2):
            gone = rng.random(len(base)) < part
            sets.append(np.unique(np.concatenate([base[~gone], rng.integers(0, 1 << 63, int(gone.sum()), dtype=np.uint64)])))
    ends = np.cumsum([len(s) for s in sets])
    odd = near_dedup._parities(np.concatenate(sets), ends)
    assert odd.shape == (len(sets), near_dedup.PARITIES)
    for a, x in zip(sets, odd, strict=True):
        for b, y in zip(sets, odd, strict=True):
            cells = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
            assert cells <= len(set(a.tolist()) ^ set(b.tolist()))
