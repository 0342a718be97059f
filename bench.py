"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the number of local
executor threads, ``BENCH_RUNS`` how often each query runs; the best run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from keydrift.session import RECOMMENDED  # noqa: E402
from registry.queries import QUERIES  # noqa: E402

HEADLINES = (
    "diff_a",
    "diff_b",
    "diff_composite_key",
    "diff_raw_full_outer",
    "diff_fingerprint",
    "diff_presence",
    "diff_repeated",
    "diff_summary",
    "dedup_last",
    "normalize_b",
    "norm_list_documents",
    "scan_tsv",
    "scan_glob_union",
    "sink_diff_csv",
    "gen_after",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("keydrift-bench")
    local = {
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for name, value in {**RECOMMENDED, **local}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    names = sys.argv[1:] or HEADLINES
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        seconds[name] = round(min(taken), 3)
    report = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }
    print(json.dumps(report))


if __name__ == "__main__":
    main()
