"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is built and fully executed (every row and column) into a no-op sink.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from workload.queries import QUERIES  # noqa: E402

HEADLINES = [
    "corpus_scan",
    "senti_vocab",
    "antonym_all_both",
    "antonym_paper_both_senti",
    "similar_all_both",
    "blankout",
    "blankout_senti",
    "blankout_sweep",
    "undersample",
    "oversample",
    "sample_exact_n",
    "set_antonym_over",
    "set_blankout_both_senti_under",
    "nb_model",
    "nb_predict",
    "denoise_with_original",
    "cv_nb",
    "cv_svm1",
    "augmented_export",
    "suite_imbalance",
    "suite_similar_fair",
    "suite_blankout_bias",
    "suite_bias_other",
    "suite_svm",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    with contextlib.redirect_stdout(sys.stderr):
        run("class_counts")  # start-up
        for name in HEADLINES:
            start = time.perf_counter()
            run(name)
            times[name] = round(time.perf_counter() - start, 3)
            print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(sf_dir).removeprefix("sf") or 0),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
