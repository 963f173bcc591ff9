"""Headline queries, timed.  Prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seqloom.plans.registry import QUERIES  # noqa: E402
from seqloom.session import local_session  # noqa: E402

HEADLINE = [
    "aac",
    "dpc",
    "tpc",
    "cksaap",
    "moran",
    "socnumber",
    "asdc",
    "featurize_selected",
    "join_blocks",
    "dense_vectors",
    "all_blocks",
    "leakage_check",
    "stratified_folds",
    "auroc",
    "mutation_matrix",
    "pearson_matrix",
    "nmi_matrix",
    "sampled_attribution",
    "permutation_importance",
    "lof_score",
    "elite",
    "generation_log",
    "score_candidates",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    # start executors and code generation before the clock
    QUERIES["count_features"](spark, "/root/testdata/sf0.001").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
