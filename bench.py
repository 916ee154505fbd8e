"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the
timed runs per query (the median counts, after one warm run; 1 by default), ``BENCH_QUERIES=all`` widens
the list to every registered query. Results are fully computed and then thrown away.
The two ``prepare_*`` entries time the stored tables that the other queries read.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "scan_action_context", "scan_valid_latents", "delta_window_source", "future_action_mean", "action_window_sum",
    "progress_context", "past_future_pairs", "cutoff_whole_episode", "cutoff_first_n_valid", "scatter_labels_join",
    "write_labeled_dataset", "float_feature_stats", "numeric_summary", "slot_norm_summary", "exact_unique_rows",
    "rounded_unique_rows", "id_sequence_counts", "usage_lookup_join", "mutual_information", "bucket_action_stats",
    "variance_explained", "bucket_context_summary", "action_to_latent_summary", "spcfc_cosine", "spcfc_summary",
    "spcfc_by_episode", "reconstruction_metrics", "nearest_codebook_join", "apply_condition_losses",
    "loss_condition_summary", "loss_vs_baseline", "synthetic_labels", "apply_labeler", "episode_split", "row_split",
    "standardize", "one_hot_ids", "histogram",
]
FITS = ["kmeans_latent_buckets", "ridge_probe", "nonlinear_probe", "pca_scatter_table"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))

    from framelens.queries import registered
    from framelens.session import local_session
    from framelens.sources import tables

    spark = local_session(cpus)
    queries = registered()[0]

    def complete(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    work = {
        "prepare_labeled_frames": lambda: tables.build_labeled_frames(spark, sf_dir),
        "prepare_valid_frames": lambda: tables.build_valid_frames(spark, sf_dir),
    }
    names = list(queries) if os.environ.get("BENCH_QUERIES") == "all" else [*HEADLINE, *FITS]
    for name in names:
        work[name] = lambda fn=queries[name]: fn(spark, sf_dir)

    times: dict[str, float] = {}
    for name, build in work.items():
        seen = []
        for i in range((1 if name in FITS else runs) + 1):
            start = time.perf_counter()
            complete(build())
            seen.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seen[1:]), 4)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    base = os.path.basename(os.path.normpath(sf_dir))
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "sf": float(base[2:]) if base.startswith("sf") else base,
    }))


if __name__ == "__main__":
    main()
