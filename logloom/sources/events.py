"""Driver tables as log entries, and as the lines of log files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import conform


def events_as_logs(events: DataFrame, *more: str) -> DataFrame:
    """`events` (event_id, ts, user_id, event_type, value, props) in the record's schema, one job, and `more` of their columns."""
    kind, user = F.col("event_type"), F.col("user_id")
    level = F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").when(kind == "view", "DEBUG").otherwise("INFO")
    out = events.select(
        F.sha2(F.concat_ws("|", F.lit("events"), F.lit("events.log"), F.col("event_id") + 1), 256).alias("id"),
        F.lit("events").alias("job_id"),
        F.lit("events.log").alias("file_name"),
        (F.col("event_id") + 1).alias("line_number"),
        F.date_trunc("MILLISECOND", "ts").cast("timestamp_ntz").alias("timestamp"),
        level.alias("level"),
        F.concat(F.lit("com.shop."), kind).alias("logger"),
        kind.alias("source"),
        F.concat(F.lit("worker-"), (user % 8).cast("string")).alias("thread"),
        F.concat(F.lit("host-"), (user % 5).cast("string")).alias("hostname"),
        F.lit("shop").alias("application"),
        F.when(user % 2 == 0, "prod").otherwise("dev").alias("environment"),
        F.concat(kind, F.lit(" user="), user.cast("string"), F.lit(" props="), F.col("props")).alias("message"),
        F.when(kind.isin("error", "signup"), level == "ERROR").alias("has_error"),
        F.when((kind == "error") & (user % 3 == 0), F.lit(True)).alias("has_stack_trace"),
        F.when(user % 10 == 0, F.array(F.lit("important"))).alias("tags"),
        *more,
    )
    head = F.concat(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" ["), F.col("thread"), F.lit("] "), F.col("level"))
    return conform(out.withColumn("raw_line", F.concat(head, F.lit(" "), F.col("logger"), F.lit(" - "), F.col("message"))), more)


def as_lines(rows: DataFrame, number, line) -> DataFrame:
    return rows.select(F.lit("events.log").alias("file_name"), number.cast("long").alias("line_number"), line.alias("line"))
