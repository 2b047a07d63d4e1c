"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), BENCH_RUNS timed runs (median,
default 3) after one warm-up. Results are computed in full and dropped.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatch.catalog import QUERIES  # noqa: E402
from tidewatch.session import local_session  # noqa: E402

HEADLINE = [
    "event_early_warnings",
    "joint_signal_metrics",
    "burstiness_rolling",
    "similarity_to_recent_events",
    "group_pairwise_similarity",
    "dictionary_scores",
    "sentiment_scores",
    "passive_voice_ratio",
    "consecutive_document_similarity",
    "text_vectors_hashed",
    "page_fields",
    "registry_append",
    "registry_lookup",
    "correlations_pairwise",
    "icc_by_supplier",
    "principal_component_scores",
    "forecast_skill_by_dimension",
    "cross_map_skill_by_size",
    "unit_measures",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "tidewatch-bench")
    times, rows = {}, {}
    for name in names:
        taken = []
        for i in range(runs + 1):
            start = time.perf_counter()
            df = QUERIES[name](spark, sf_dir)
            if i == 0:
                rows[name] = df.count()
                continue
            df.write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name}: {times[name]}s, {rows[name]} rows", file=sys.stderr, flush=True)
    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "rows": rows,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "spark": spark.version,
    }
    spark.stop()
    print(json.dumps(line), flush=True)


main()
