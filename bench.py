"""Time the headline queries: prints one JSON line.

Each query is written to a no-op sink, so every row and column is computed and nothing is
collected. One warm-up query starts the Python workers before the clock runs. The documents come as one file of
one row group, which no setting lets several tasks read, so they are stored in several files first, as a
large table is; the other tables are read as they are.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from lintlake.queries import Q
from lintlake.session import local_session

QUERIES = [
    "r1_analyze",
    "m13_file_metrics",
    "c8_estimates",
    "c15_file_summary",
    "v7_findings",
    "v5_line_findings_text",
    "f5_features",
    "f3_rough",
    "f8_clean",
    "m10_volume_text",
    "m1_line_counts_text",
    "a3_walk",
    "a7_variables",
    "t4_token_statistics",
    "t1_tokenize",
    "t6_mean_pooled",
    "d1_splits",
    "e6_metrics",
    "e2_random_forest",
    "r6_summary_stats",
    "r10_analyze_stream",
    "l1_submission_labels",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def in_several_files(spark, folder: str, scratch: str, cores: int) -> str:
    """The tables at ``folder`` under a new folder, the documents in as many files as there are cores."""
    made = os.path.join(scratch, "tables")
    os.makedirs(made)
    for name in os.listdir(folder):
        if name == "documents.parquet":
            spark.read.parquet(os.path.join(folder, name)).repartition(cores).write.parquet(os.path.join(made, name))
        else:
            os.symlink(os.path.abspath(os.path.join(folder, name)), os.path.join(made, name))
    return made


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores, scratch = os.environ.get("BENCH_CPUS", "8"), tempfile.mkdtemp(prefix="run-")
    spark = local_session(cores, "bench", scratch)
    spark.sparkContext.setLogLevel("ERROR")
    run(Q["r1_analyze"](spark, os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")))
    tables = in_several_files(spark, folder, scratch, int(cores) if cores.isdigit() else 8)
    times = {}
    for name in QUERIES:
        start = time.perf_counter()
        run(Q[name](spark, tables))
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(os.path.basename(folder.rstrip("/"))[2:]),
            }
        )
    )


if __name__ == "__main__":
    main()
