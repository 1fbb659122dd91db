"""Counts by time, without gaps between the first and the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import CALENDAR_INTERVALS, FIXED_INTERVALS, interval


def bucket_start(ts: Column, every: str) -> Column:
    if every in CALENDAR_INTERVALS:
        return F.date_trunc(CALENDAR_INTERVALS[every], ts).cast("timestamp_ntz")
    return F.window(ts, FIXED_INTERVALS[every])["start"]


#: Buckets that one row of the coarse step stands for.
FINE = 4096


def all_buckets(counts: DataFrame, every: str) -> DataFrame:
    """Every bucket from the first to the last of `counts` (bucket_start, ...).

    They are numbered in coarse steps, dealt out, and then in fine ones, so no row or task holds the whole range.  The
    number of parts is given, as the few coarse rows would else be brought together in one.
    """
    number, unit = (FIXED_INTERVALS.get(every) or f"1 {CALENDAR_INTERVALS[every]}").upper().removesuffix("S").split()
    ends = counts.agg(F.min("bucket_start").alias("a"), F.max("bucket_start").alias("b")).where("a is not null")
    ends = ends.withColumn("n", F.floor(F.expr(f"timestampdiff({unit}, a, b)") / int(number)).cast("long"))
    coarse = ends.select("a", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / FINE))).alias("k")).repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k")
    fine = coarse.select("a", F.explode(F.sequence(F.col("k") * FINE, F.least(F.col("n"), (F.col("k") + 1) * FINE - 1))).alias("i"))
    return fine.select((F.col("a") + F.expr(f"INTERVAL '{number}' {unit}") * F.col("i")).alias("bucket_start"))


def timeline(entries: DataFrame, every: str | None = "1h") -> DataFrame:
    """(bucket_start, count, error_count, warning_count); entries without a timestamp don't count."""
    every = interval(every)
    start = bucket_start(F.col("timestamp"), every)
    level = lambda v: F.count_if(F.col("level") == v)
    counts = entries.where("timestamp is not null").select(start.alias("bucket_start"), "level").groupBy("bucket_start").agg(F.count("*").alias("count"), level("ERROR").alias("error_count"), level("WARN").alias("warning_count"))
    full = all_buckets(counts, every).join(counts, "bucket_start", "left")
    return full.select("bucket_start", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("count", "error_count", "warning_count")])


def timeline_levels(entries: DataFrame, every: str | None = "1h") -> DataFrame:
    """(bucket_start, level, count), for the levels that a bucket has."""
    start = bucket_start(F.col("timestamp"), interval(every))
    return entries.where("timestamp is not null and level is not null").select(start.alias("bucket_start"), "level").groupBy("bucket_start", "level").agg(F.count("*").alias("count"))


def envelope(buckets: DataFrame) -> DataFrame:
    """One row: the first and the last bucket's start, and all counts."""
    return buckets.agg(F.min("bucket_start").alias("start_time"), F.max("bucket_start").alias("end_time"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_count"))
