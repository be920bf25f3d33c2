"""Headline queries timed at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from casebook import QUERIES  # noqa: E402

HEADLINE = [
    "a1_votes_tall_to_wide", "j1_returns_on_units", "a3_district_demo_vap", "a4_district_returns", "a15_population_deviation",
    "j17_district_opportunity", "a5_plan_metrics", "a6_ensemble_distribution", "a6_ensemble_distribution_share",
    "a8_plan_vs_ensemble", "j16_share_of_draws_at_most", "w6_ecdf_positions", "g1_overlay_boxes", "g1_overlay_polygons",
    "g2_assign_by_area", "g3_interpolated_counts", "g7_adjacency", "g8_cut_edges", "m21_inference_design", "m22_support_draws",
    "m23_projected_draws", "a21_posterior_summary", "a22_split_rhat", "a18_pearson", "a19_spearman", "p24_describe",
    "m5_kmeans", "m7_cluster_scores", "m7_linear_silhouette", "m7_euclidean_silhouette", "m13_cross_validation",
    "m14_best_threshold", "m19_influence", "m6_k_search", "m16_coefficients", "m20_mixture_membership", "j20_draws_by_blocks",
    "x1_input_build", "x2_staged_analysis",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shuffles = str(max(8, int(cpus))) if cpus.isdigit() else "8"
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", shuffles).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["p24_shape"](spark, sf_dir).collect()               # start the session and its workers
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
