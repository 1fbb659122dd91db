"""Counts and sketches of a job's days, so that questions over many jobs don't read their entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import seconds_between

#: Fields whose different values are counted, and the sketches' log2 of registers: an error of some 1.6 in 100.
COUNTED, REGISTERS = ("logger", "thread", "source", "hostname"), 12


def rollup(entries: DataFrame) -> DataFrame:
    """A row for each job and day: counts, first and last time, and a sketch of each counted field."""
    return entries.groupBy("job_id", F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("total_entries"),
        F.count_if(F.col("has_error")).alias("error_count"),
        F.count_if(F.col("level") == "WARN").alias("warning_count"),
        F.count_if(F.col("has_stack_trace")).alias("stack_trace_count"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        *[F.hll_sketch_agg(c, F.lit(REGISTERS)).alias(f"{c}_sketch") for c in COUNTED],
    )


def merged(rollups: DataFrame) -> DataFrame:
    """One row, like that of `summary`: counts are exact, numbers of different values estimates from the merged sketches."""
    sums = ("total_entries", "error_count", "warning_count", "stack_trace_count")
    out = rollups.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"{c}_sketch")), F.lit(0)).cast("long").alias(f"unique_{c}s") for c in COUNTED],
    )
    return out.withColumn("time_span_seconds", seconds_between(F.col("start_time"), F.col("end_time")))
