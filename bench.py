"""Headline queries, timed on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "w1_delayer", "a1_array_correlation", "w4_row_index", "w4_interpolate", "w20_halo", "j5_lanczos", "j5_lanczos_rectify",
    "j14_context_windows", "e2_mean_pool", "e6_scene_features", "m9_block_permutation", "m10_timeshift", "a3_p_from_null_two_sided",
    "a4_fdr_bh", "a6_parcels", "j8_overlap", "j9_combine", "p10_dm_am_regressor", "s12_regressor_lines", "s1_transcript",
    "w3_context_strings", "j1_word_vectors", "j2_phonemes", "e4_context_vector", "a12_entropy", "a13_relative_entropy", "t1_topn",
    "a16_model_statistics", "m13_silhouette", "a24_box", "a26_corr_matrix", "a28_density", "m2_banded", "m5_fit_encoding",
    "m6_pca", "st1_sliding",
    # these grow with the number of users
    "m1_user_targets", "st5_lagged",
]


def main() -> None:
    from sigframe.session import local_session
    from sigframe.workload import load

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    names = sys.argv[1:] or HEADLINE
    # start the JVM paths and the Python workers before timing
    for warm in ("w1_delayer", "e3_batched_encoder"):
        queries[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        took = []
        for _ in range(runs):
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        seconds[name] = round(statistics.median(took), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
