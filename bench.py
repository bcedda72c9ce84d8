"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR   folder of the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names (default HEADLINE)
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402

from sigspark.functions import kernels  # noqa: E402
from sigspark.operators import activity  # noqa: E402
from sigspark.plans import registry  # noqa: E402
from sigspark.session import local_session  # noqa: E402

HEADLINE = ["group_auc_bootstrap", "group_auc_permutation", "paired_auc_difference", "balanced_accuracy_by_group", "auc_by_event_type", "best_single_feature", "spearman", "exact_quantiles",
            "group_kfold", "split_digest", "time_blocks", "kofn_onsets", "interval_union_occupancy", "gapfree_runs", "content_duplicates", "interval_overlap", "index_problems", "claim_problems",
            "status_cube", "signal_windows", "dft_power", "spectrogram", "noise_floor", "bursts", "emitters", "rf_tile_features", "mfcc_features", "knn_one_class", "stream_decisions"]


def kernel_times() -> dict[str, float]:
    """Milliseconds per decision on one thread, at the sizes the published figures use."""
    rng = np.random.default_rng(0)
    audio, tile = rng.normal(size=(16, 48_000)), rng.normal(size=(32, 10_000)) + 1j * rng.normal(size=(32, 10_000))
    window = rng.normal(size=10_000_000) + 1j * rng.normal(size=10_000_000)

    def best(f, rows: int, times: int = 3) -> float:
        spent = []
        for _ in range(times):
            t = time.perf_counter()
            f()
            spent.append(time.perf_counter() - t)
        return round(1000 * min(spent) / rows, 3)

    def analyse():
        power = kernels.power_cells(window[None], kernels.blackman_harris(512))[0].astype(np.float32)
        floor = activity.floor_of(power)
        activity.find_bursts(power, floor, activity.on_cells(power, floor, 1e-3, 1, 256), 512 / 100e6, 100e6 / 512)

    return {"audio_window_41_features_ms": best(lambda: kernels.audio_features(audio, 48_000), 16), "audio_window_26_mfcc_ms": best(lambda: kernels.mfcc_features(audio, 48_000), 16),
            "rf_tile_24_features_ms": best(lambda: kernels.tile_features(tile, 40e6), 32), "rf_100ms_activity_ms": best(analyse, 1, 2)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries, spent = registry.queries(), {}
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()                       # start-up is not a query
    for name in names:
        t = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "kernels_ms": kernel_times()}))


if __name__ == "__main__":
    main()
