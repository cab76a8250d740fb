import zlib
from collections import defaultdict

import numpy as np
import pytest

from glyphgrove.llm import hilbert
from tests.llm.conftest import ODD


@pytest.mark.parametrize(("bits", "dims"), [(1, 2), (3, 2), (2, 3), (2, 4), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(bits, dims):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    at = hilbert.curve_index(grid, bits)
    assert sorted(at.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def check(docs, shards):
    rows = docs.select("doc_id", "text").collect()
    found = hilbert.shard_documents(docs, shards=shards).collect()
    assert len(found) == len(rows)
    facts = sorted((str(r["doc_id"]), len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == facts
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    counts = [len(slots[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return found


def test_rows_law_and_order(documents):
    found = sorted(check(documents, 40), key=lambda r: (r["shard"], r["slot"]))
    curve = [r["curve"] for r in found]
    assert curve == sorted(curve)
    # equal texts lie side by side
    crcs = [r["text_crc32"] for r in found]
    runs = [c for k, c in enumerate(crcs) if k == 0 or crcs[k - 1] != c]
    assert len(runs) == len(set(crcs))


def test_odd_rows(odd, nothing):
    check(odd, 3)
    check(odd, 40)
    assert hilbert.shard_documents(nothing).count() == 0
    assert len(ODD) == hilbert.shard_documents(odd).count()


def test_manifest_and_files(documents, tmp_path, spark):
    found = hilbert.shard_documents(documents, shards=8)
    rows = hilbert.manifest(found, ["lang", "source", "size"]).collect()
    assert sum(r["rows"] for r in rows) == documents.count()
    # a reader of one language may skip shards
    assert sum("fr" in r["values_lang"] for r in rows) < 8
    hilbert.write_shards(found, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == documents.count()


def test_cells_keep_the_order_of_values(spark):
    rows = [(k, s, n) for k, (s, n) in enumerate([("b", 1), ("a", 2), (None, 3), ("d", None), ("c", 9)] * 20 + [("a", 5)] * 60)]
    df = spark.createDataFrame(rows, "id long, name string, n long")
    found, cells = hilbert.quantised(df, ["name", "n"], 4)
    got = {(r["name"], r["n"]): (r["x"], r["y"]) for r in found.select("name", "n", cells[0].alias("x"), cells[1].alias("y")).collect()}
    names = {k[0]: v[0] for k, v in got.items()}
    assert names[None] == 0 < names["a"] < names["b"] < names["c"] < names["d"] < 16
    assert all(v[1] == 0 for k, v in got.items() if k[1] is None)
    numbers = sorted((k[1], v[1]) for k, v in got.items() if k[1] is not None)
    assert [c for _, c in numbers] == sorted(c for _, c in numbers)


def test_least_and_greatest_values_prune_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = hilbert.manifest(hilbert.shard_documents(docs), ["lang", "source", "size"]).collect()
    for column, share in (("lang", 0.6), ("source", 0.6)):
        values = [r[column] for r in docs.select(column).distinct().collect() if r[column] is not None]
        read = sum(r[f"least_{column}"] <= v <= r[f"most_{column}"] for r in rows for v in values)
        assert read <= share * len(rows) * len(values), (column, read / len(rows) / len(values))
