"""Time the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` a
comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from glyphgrove.plans import inputs
from glyphgrove.plans.queries import CATALOGUE
from glyphgrove.runtime import session

HEADLINE = [
    "src_vocab_text", "vocab_dedup", "src_dense_id", "dist_metrics", "match_bruteforce",
    "seed_farthest", "kmedoids_assign", "cluster_population", "medoid_cost", "medoid_cost_l1",
    "medoid_cost_l2sq", "kmedoids_update", "kmedoids_fit", "root_mean_descriptor",
    "kmeans_baseline", "tree_build", "tree_quantise", "word_weights", "bow_frames",
    "bow_similarity", "inverted_index", "retrieve_best", "frame_lag", "motion_cumulative",
    "keyframes", "match_candidates", "match_consensus", "loop_islands", "loop_closure",
    "kalman_track", "stream_keyframes", "stream_kalman",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    times = {}
    if names == HEADLINE:
        # the vocabulary that many queries share is trained first and timed on its own
        inputs.forget()
        start = time.perf_counter()
        inputs.bags(spark, sf_dir).count()
        times["vocabulary_training"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        CATALOGUE[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
