"""Logs as streams: an extension beyond batch files, for JSON lines and counts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.jsonlog import parse_json
from ..options import FIXED_INTERVALS, ParseOptions


def stream_json(spark: SparkSession, folder: str, opts: ParseOptions) -> DataFrame:
    """Entries of JSON lines in files that appear in a folder.  A stream has no line numbers; the id is the line's digest."""
    lines = spark.readStream.text(folder).select(F.col("_metadata.file_name").alias("file_name"), F.lit(None).cast("long").alias("line_number"), F.col("value").alias("line"))
    return parse_json(lines, opts).withColumn("id", F.sha2(F.concat_ws("|", "job_id", "file_name", "raw_line"), 256))


def stream_timeline(entries: DataFrame, every: str = "5m", late: str = "10 minutes") -> DataFrame:
    """(bucket_start, level, count), each bucket once it is older than what may still come late."""
    events = entries.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    return events.groupBy(F.window("timestamp", FIXED_INTERVALS[every]), "level").agg(F.count("*").alias("count")).select(F.col("window.start").alias("bucket_start"), "level", "count")


def append_to(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return entries.writeStream.partitionBy("job_id").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="parquet", outputMode="append")
