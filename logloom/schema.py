"""The one record that every parser makes and every query reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("logger", T.StringType()),
        T.StructField("thread", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("raw_line", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("stack_trace", T.StringType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("application", T.StringType()),
        T.StructField("environment", T.StringType()),
        T.StructField("indexed_at", T.TimestampType()),
        T.StructField("has_error", T.BooleanType()),
        T.StructField("has_stack_trace", T.BooleanType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("timestamp_inferred", T.BooleanType()),
    ]
)

SORTABLE = ("timestamp", "line_number", "level", "logger", "thread", "source", "hostname", "application", "indexed_at")
KEYWORDS = ("job_id", "level", "logger", "thread", "source", "file_name", "hostname", "application", "environment")
TEXTS = ("message", "raw_line", "stack_trace")
LEVELS = ("ERROR", "WARN", "INFO", "DEBUG", "TRACE")

#: Names that requests and exports may use instead of the columns'.
CAMEL = {"jobId": "job_id", "lineNumber": "line_number", "rawLine": "raw_line", "fileName": "file_name", "stackTrace": "stack_trace", "indexedAt": "indexed_at", "hasError": "has_error", "hasStackTrace": "has_stack_trace"}


def column_name(name: str) -> str:
    return CAMEL.get(name, name)


#: What a parser tells of a line, or of the lines that one entry has, beside the entry: what became of it, why it failed, the number of
#: lines, and of the parts of its stack trace.
STATUS = ("parse_status", "error_message", "lines", "parts")
#: The statuses of rows that have an entry.
HAS_ENTRY = ("SUCCESS", "BUFFERED")


def conform(df: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The record's columns in order and type, those that `df` lacks null, and `more` of `df`'s."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG_ENTRY_SCHEMA], *more)


def entries_of(records: DataFrame) -> DataFrame:
    """The entries among a parser's records."""
    return conform(records.where(F.col("parse_status").isin(*HAS_ENTRY)))
