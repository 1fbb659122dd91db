"""Counts and facets of a job's entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import keyword_field
from ..schema import LEVELS

TOP = 10


def top_values(entries: DataFrame, field: str, limit: int = TOP) -> DataFrame:
    """(value, count) of a keyword field, most frequent first, then by value; entries without one don't count."""
    c = keyword_field(field)
    counts = entries.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "value").limit(limit)


def facets(entries: DataFrame, fields: tuple[str, ...], limit: int) -> DataFrame:
    """(field, value, count): the top values of several fields, from one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(keyword_field(f)).alias("value")) for f in fields])).alias("p")
    counts = entries.select(pairs).where("p.value is not null").groupBy("p.field", "p.value").agg(F.count("*").alias("count"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "value"))), 1, limit)
    ranked = _leading(counts, limit) if limit else counts
    return ranked.groupBy("field").agg(best.alias("best")).select("field", F.explode("best").alias("b")).select("field", F.col("b.value").alias("value"), (-F.col("b.order")).alias("count"))


def _leading(counts: DataFrame, limit: int, parts: int = 64) -> DataFrame:
    """At most limit * parts values of each field, among them all that lead: the leaders of hashed parts."""
    from pyspark.sql import Window

    part = Window.partitionBy("field", F.pmod(F.xxhash64("value"), F.lit(parts))).orderBy(F.desc("count"), "value")
    return counts.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= limit).drop("_rank")


def seconds_between(first: Column, last: Column) -> Column:
    return F.timestamp_diff("SECOND", first, last).cast("long")


def summary(entries: DataFrame) -> DataFrame:
    """One row: counts, time span and numbers of different values."""
    out = entries.agg(
        F.count("*").alias("total_entries"),
        F.count_if(F.col("has_error")).alias("error_count"),
        F.count_if(F.col("level") == "WARN").alias("warning_count"),
        F.count_if(F.col("has_stack_trace")).alias("stack_trace_count"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        *[F.count_distinct(c).alias(f"unique_{c}s") for c in ("logger", "thread", "source", "hostname")],
    )
    return out.withColumn("time_span_seconds", seconds_between(F.col("start_time"), F.col("end_time")))


def approximate_summary(entries: DataFrame, error: float = 0.02) -> DataFrame:
    """The numbers of different values by sketches of fixed size, for jobs where exact ones cost too much."""
    return entries.agg(*[F.approx_count_distinct(c, error).alias(f"unique_{c}s") for c in ("logger", "thread", "source", "hostname")])


def job_statistics(entries: DataFrame) -> DataFrame:
    """(name, count): all entries, those with errors, and each standard level that occurs."""
    row = entries.agg(F.count("*").alias("total"), F.count_if(F.col("has_error")).alias("errors"), *[F.count_if(F.col("level") == v).alias(v) for v in LEVELS])
    names = ["total", "errors", *LEVELS]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("count")) for n in names])).alias("p")
    return row.select(pairs).select("p.*").where((F.col("count") > 0) | F.col("name").isin("total", "errors"))


def line_accounting(status: DataFrame) -> DataFrame:
    """One row: lines by what became of them, and the share that succeeded."""
    is_ = lambda *s: F.count_if(F.col("parse_status").isin(*s))
    out = status.agg(F.count("*").alias("total_lines"), is_("SUCCESS", "BUFFERED").alias("successful_lines"), is_("FAILED").alias("failed_lines"), is_("SKIPPED").alias("skipped_lines"), is_("CONTINUATION").alias("continuation_lines"))
    return out.withColumn("success_rate", F.when(F.col("total_lines") > 0, F.col("successful_lines") * 100.0 / F.col("total_lines")).otherwise(0.0))


def errors_per_logger(entries: DataFrame) -> DataFrame:
    return entries.where("level = 'ERROR'").groupBy(F.coalesce("logger", F.lit("unknown")).alias("logger")).agg(F.count("*").alias("count"))


def top_error_messages(entries: DataFrame, limit: int = TOP) -> DataFrame:
    counts = entries.where("has_error and message is not null").groupBy("message").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "message").limit(limit)
