"""Operators on a log of runs ``(query, mode, input_size, time_us)``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.functions import metrics


def run_metrics(log: DataFrame) -> DataFrame:
    """Add the time in milliseconds and the bandwidth of each run."""
    return log.withColumn("time_taken_ms", metrics.time_taken_ms("time_us")).withColumn(
        "bandwidth", metrics.bandwidth("input_size", "time_us")
    )


def speedup(log: DataFrame, slow: str, fast: str) -> DataFrame:
    """For each query run in both modes, how many times faster ``fast`` is."""
    times = (
        log.filter(F.col("mode").isin(slow, fast))
        .groupBy("query")
        .pivot("mode", [slow, fast])
        .agg(F.max("time_us"))
    )
    return times.na.drop().select(
        "query",
        F.col(slow).alias("slow_us"),
        F.col(fast).alias("fast_us"),
        metrics.time_ratio(slow, fast).alias("speedup"),
    )
