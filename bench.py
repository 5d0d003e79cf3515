"""Runs the headline queries and prints one JSON line of seconds."""

import importlib.util
import json
import os
import sys
import time

HEADLINE = [
    "transition_matrix", "traj_segments", "trajectory_steps", "traj_ab_segments", "lineage_mindist", "unique_trajectories", "msd", "tcf", "pair_rdf", "motility",
    "signal_contributions", "path_entropy", "committor", "predicted_fc", "knn_topk", "assign_nearest_center", "segment_concat", "mesh_average", "linear_coef",
    "op1_best_fit_packing", "op2_embedding_near_dedup", "op3_token_planes", "op4_quality_neighbours", "op5_simhash_near_dedup", "op6_trie_bpe",
    "op7_ordinal_toxicity", "op8_url_filter", "op9_exact_dedup", "op10_license_scan",
]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    path = os.path.join(os.path.dirname(os.path.abspath(__file__)), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("__spark_entry__", path)
    entry = importlib.util.module_from_spec(spec)
    sys.path.insert(0, os.path.dirname(path))
    spec.loader.exec_module(entry)
    queries = entry.queries()
    queries["transition_matrix"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the engine
    took = {}
    for name in [n for n in HEADLINE if n in queries]:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
