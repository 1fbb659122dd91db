"""JSON logs, one object a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import normal_level
from ..functions.texts import source_of, trim
from ..functions.times import checked_pattern, json_time
from ..options import ParseOptions
from ..schema import entries_of
from .textlog import finish

#: The keys of each field, in the order in which they are looked up.
KEYS = {
    "timestamp": ("timestamp", "time", "@timestamp", "datetime", "date", "ts", "log_time", "logTime"),
    "level": ("level", "severity", "log_level", "logLevel", "loglevel", "levelname"),
    "message": ("message", "msg", "text", "log_message", "logMessage", "description"),
    "logger": ("logger", "logger_name", "loggerName", "class", "category", "name"),
    "thread": ("thread", "thread_name", "threadName", "thread_id", "threadId"),
    "stack_trace": ("stack_trace", "stackTrace", "stack", "exception", "error_stack", "errorStack"),
    "hostname": ("hostname", "host", "server", "instance", "machine", "node"),
    "application": ("application", "app", "service", "service_name", "serviceName", "app_name", "appName"),
    "environment": ("environment", "env", "stage", "deployment"),
}


def field(name: str) -> Column:
    return F.coalesce(*[F.try_element_at("_map", F.lit(k)) for k in KEYS[name]])


def json_lines(lines: DataFrame) -> DataFrame:
    """`lines` with parse_status, error_message and _map, the object's values as text (null for an array)."""
    s = trim(F.coalesce("line", F.lit("")))
    shaped = (s.startswith("{") & s.endswith("}")) | (s.startswith("[") & s.endswith("]"))
    lines = lines.withColumn("_map", F.when(s.startswith("{"), F.from_json(s, "map<string,string>", {"mode": "PERMISSIVE"})))
    valid = F.when(s.startswith("["), F.try_parse_json(s).isNotNull()).otherwise(F.col("_map").isNotNull())
    status = F.when(s == "", "SKIPPED").when(shaped & valid, "SUCCESS").otherwise("FAILED")
    error = F.when((s != "") & ~shaped, "Not valid JSON").when((s != "") & ~valid, "JSON parse error")
    return lines.withColumns({"parse_status": status, "error_message": error})


def json_status(lines: DataFrame) -> DataFrame:
    return json_lines(lines).select("file_name", "line_number", "line", "parse_status", "error_message")


def parse_json(lines: DataFrame, opts: ParseOptions) -> DataFrame:
    """Entries of the lines that parse; an array gives one without fields.  Keys that no field could take go to metadata."""
    return entries_of(json_records(lines, opts))


def json_records(lines: DataFrame, opts: ParseOptions) -> DataFrame:
    """A row for each line, with its entry if it parses."""
    rows = json_lines(lines).withColumns({"lines": F.lit(1).cast("long"), "parts": F.lit(1).cast("long")})
    level, stack, logger = normal_level(field("level")), field("stack_trace"), field("logger")
    taken = sorted({k for keys in KEYS.values() for k in keys} | {"tags"})
    # A key that only differs in case from a field's is one that no field takes.
    spare = F.map_filter("_map", lambda k, v: v.isNotNull() & ~k.isin(*taken))
    tags = F.from_json(F.try_element_at("_map", F.lit("tags")), "array<string>")
    metadata = F.when(tags.isNull() & F.try_element_at("_map", F.lit("tags")).isNotNull(), F.map_concat(spare, F.create_map(F.lit("tags"), F.try_element_at("_map", F.lit("tags"))))).otherwise(spare)
    has_error = F.coalesce(F.when(level.isNotNull(), level == "ERROR"), F.when(stack.isNotNull(), F.lit(True)))
    rows = rows.withColumn("_time", trim(field("timestamp")))
    return finish(
        rows.withColumns(
            {
                "_stamp": json_time(F.col("_time"), checked_pattern(lines.sparkSession, opts.timestamp_format), opts.year),
                "level": level,
                "message": field("message"),
                "logger": logger,
                "source": source_of(logger),
                "thread": field("thread"),
                "stack_trace": stack,
                "hostname": field("hostname"),
                "application": field("application"),
                "environment": field("environment"),
                "has_error": has_error,
                "has_stack_trace": F.when(stack.isNotNull(), F.lit(True)),
                "tags": tags,
                "metadata": F.when(F.size(metadata) > 0, metadata),
            }
        ),
        opts,
    )
