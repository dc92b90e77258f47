"""Times the headline queries; prints one JSON line.

Each query runs once to warm up and then three times; the median counts.  All
rows of the result are produced (noop sink).
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexisweep.registered import QUERIES  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3
HEADLINE = (
    "count_substring",
    "count_whole_word",
    "search_hits",
    "search_stats",
    "search_response",
    "search_response_all",
    "partial_stats",
    "search_batch",
    "search_batch_stats",
    "strip_links",
    "prepare",
    "is_word_char",
    "read_dump",
    "rechunk",
    "rechunk_by_bytes",
    "split_rows",
    "read_chunks",
    "dataset_head",
)


def seconds(query, spark):
    start = time.perf_counter()
    query(spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    times = {}
    for name in chosen:
        seconds(QUERIES[name], spark)
        runs = [seconds(QUERIES[name], spark) for _ in range(RUNS)]
        times[name] = round(statistics.median(runs), 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
