"""The k-means baseline of the catalogue: its size and what holds for any clustering."""

from glyphgrove.plans import inputs
from glyphgrove.plans.queries import CATALOGUE

SF = "/root/testdata/sf0.001"


def test_kmeans_baseline_has_its_own_size(spark):
    rows = inputs.bytes_(spark, SF)
    found = CATALOGUE["kmeans_baseline"](spark, SF).collect()
    assert sum(r["members"] for r in found) == rows.count()
    assert len({r["cluster"] for r in found}) == len(found)
    assert 16 < len(found) <= min(1024, rows.select("vector").distinct().count())
