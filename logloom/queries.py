"""Registered queries of the engine over the driver's tables, and SQL that gives the same rows.

`events` are the log: as entries, or as the lines of a log file that the parsers read.  All queries run over the
whole table; limits are those of pages and top lists.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.metadata import address, as_metadata, line_entries, link, request_id
from .functions.texts import tokens
from .operators.aggregates import errors_per_logger, facets, job_statistics, line_accounting, summary, top_error_messages, top_values
from .operators.csvlog import parse_csv
from .operators.export import export_rows, write_export
from .operators.filters import apply_filters
from .operators.fulltext import edits, query_words, swaps
from .operators.heavy import heavy_values
from .operators.highlight import highlights
from .operators.jsonlog import json_status, parse_json
from .operators.page import context_query, cursor_of, page_after, page_of, project
from .operators.textlog import parse_text, text_status
from .operators.timeline import envelope, timeline, timeline_levels
from .options import ExportOptions, LogQuery, ParseOptions
from .plans.engine import LogEngine
from .plans.rollup import merged, rollup
from .sources.detect import Registry, sample_text
from .sources.events import as_lines, events_as_logs
from .sources.scratch import fresh_folder

Query = Callable[[SparkSession, str], DataFrame]
OPTS = ParseOptions(job_id="events", file_name="events.log", ingest_ts=datetime(2024, 6, 1), default_year=2024)

LOGS = """logs AS MATERIALIZED (
  SELECT sha256('events|events.log|' || (event_id + 1)) AS id, 'events' AS job_id, event_id + 1 AS line_number, 'events.log' AS file_name,
         date_trunc('millisecond', ts)::TIMESTAMP AS timestamp,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
         'com.shop.' || event_type AS logger, event_type AS source, 'worker-' || (user_id % 8) AS thread, 'host-' || (user_id % 5) AS hostname,
         'shop' AS application, CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'dev' END AS environment,
         event_type || ' user=' || user_id || ' props=' || props AS message,
         CASE WHEN event_type IN ('error', 'signup') THEN event_type = 'error' END AS has_error,
         CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN true END AS has_stack_trace,
         CASE WHEN user_id % 10 = 0 THEN ['important'] END AS tags, event_id, user_id, event_type, value, props
  FROM events),
lines AS (SELECT *, strftime(timestamp, '%Y-%m-%d %H:%M:%S.%g') || ' [' || thread || '] ' || level || ' ' || logger || ' - ' || message AS raw_line FROM logs)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def logs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return events_as_logs(events(spark, sf_dir), *more)


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = f"WITH {LOGS} {sql}"


# ---------------------------------------------------------------- filters


def _search(name: str, where: str, **filters) -> None:
    q = LogQuery("events", **filters)
    register(name, lambda s, d: apply_filters(logs(s, d), q).select("line_number", "timestamp", "level", "message"), f"SELECT line_number, timestamp, level, message FROM lines WHERE {where}")


_search("search_levels", "level IN ('ERROR', 'WARN')", levels=("error", "WARN"))
_search("search_keyword", "logger = 'com.shop.error' AND hostname = 'host-3'", logger="com.shop.error", hostname="host-3")
_search("search_wildcard", r"logger LIKE 'com.shop.%' AND source LIKE '_lick' AND thread LIKE 'worker-_'", logger="com.shop.*", source="?lick", thread="worker-?")
_search("search_flags", "has_error = false", has_error=False)
_search("search_stack_traces", "has_stack_trace = true AND environment = 'prod'", has_stack_trace=True, environment="prod")
_search("search_tags", "list_has_any(tags, ['important', 'urgent'])", tags=("important", "urgent"))
_search("search_dates", "timestamp BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-15 23:59:59'", start_date="2024-01-10T00:00:00", end_date="2024-01-15T23:59:59")
_search("search_lines", "line_number BETWEEN 100 AND 900", min_line=100, max_line=900)
_search("search_combined", "level = 'ERROR' AND source LIKE 'err%' AND timestamp >= TIMESTAMP '2024-01-05' AND environment = 'dev' AND application = 'shop' AND file_name = 'events.log'", levels=("ERROR",), source="err*", start_date="2024-01-05T00:00:00", environment="dev", application="shop", file_name="events.log")


def _page(q: LogQuery) -> Query:
    return lambda s, d: page_of(apply_filters(logs(s, d), q), q).select("line_number", "timestamp", "level", "thread")


register("search_page", _page(LogQuery("events", levels=("ERROR",), page=2, size=50)), "SELECT line_number, timestamp, level, thread FROM lines WHERE level = 'ERROR' ORDER BY timestamp DESC NULLS LAST, line_number, id LIMIT 50 OFFSET 100")
register("search_page_ascending", _page(LogQuery("events", sort_by="thread", sort_direction="ASC", page=1, size=200)), "SELECT line_number, timestamp, level, thread FROM lines ORDER BY thread NULLS LAST, line_number, id LIMIT 200 OFFSET 200")
register("search_projection", lambda s, d: project(logs(s, d), LogQuery("events", include_fields=("lineNumber", "level", "logger", "nothing"), exclude_fields=("logger",))), "SELECT level, line_number FROM lines")
register("context_lines", lambda s, d: page_of(apply_filters(logs(s, d), q := context_query("events", 42)), q).select("line_number", "raw_line"), "SELECT line_number, raw_line FROM lines WHERE line_number BETWEEN 37 AND 47")


def _cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pages in a row, each from where the one before ends."""
    q, cursor, pages = LogQuery("events", levels=("ERROR", "WARN"), sort_by="thread", sort_direction="asc", size=100), None, []
    for number in range(5):
        page = page_after(apply_filters(logs(spark, sf_dir), q), q, cursor)
        pages.append(page.select(F.lit(number).alias("page"), "line_number", "thread", "timestamp"))
        cursor = cursor_of(page, q)
        if cursor is None:
            break
    return reduce(DataFrame.unionByName, pages)


register(
    "search_cursor",
    _cursor,
    "SELECT ((row_number() OVER (ORDER BY thread, line_number, id) - 1) // 100)::INTEGER AS page, line_number, thread, timestamp FROM lines WHERE level IN ('ERROR', 'WARN') QUALIFY row_number() OVER (ORDER BY thread, line_number, id) <= 500",
)
register("count_query", lambda s, d: apply_filters(logs(s, d), LogQuery("events", has_error=True)).agg(F.count("*").alias("total")), "SELECT count(*) AS total FROM lines WHERE has_error")

# ---------------------------------------------------------------- full text

SQL_TOKEN = r"[\p{L}\p{N}_]+(?:[''.][\p{L}_]+|[.,]\p{N}+)*"


def _sql_word(word: str) -> str:
    k, once = edits(word), swaps(word)
    if k == 0:
        return f"t = '{word}'"
    parts = [f"levenshtein(t, '{word}') <= {k}", *[f"t = '{s}'" for s in once]]
    if k == 2:
        parts += [f"levenshtein(t, '{s}') <= 1" for s in once] + [f"t = '{b}'" for b in sorted({b for s in once for b in swaps(s)})]
    return f"length(t) BETWEEN {len(word) - k} AND {len(word) + k} AND ({' OR '.join(parts)})"


def _sql_text(column: str, text: str) -> str:
    found = f"regexp_extract_all(lower(coalesce({column}, '')), '{SQL_TOKEN}')"
    return " AND ".join(f"len(list_filter({found}, lambda t: {_sql_word(w)})) > 0" for w in query_words(text))


_search("fulltext_exact", f"({_sql_text('message', 'error user')}) OR ({_sql_text('raw_line', 'error user')})", search_text="error user")
_search("fulltext_fuzzy", _sql_text("message", "pruchase usr"), search_text="pruchase usr", search_fields=("message",))
_search("fulltext_keyword_field", "logger = 'com.shop.click'", search_text="com.shop.click", search_fields=("logger", "nothing"))


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.lit("documents").alias("job_id"), F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("line_number"), F.col("text").alias("message"), F.lit(None).cast("string").alias("raw_line"), F.lit(None).cast("string").alias("stack_trace"))


register("fulltext_documents", lambda s, d: apply_filters(document_entries(s, d), LogQuery("documents", search_text="worthless idoit", search_fields=("message",))).select("line_number"), f"SELECT doc_id AS line_number FROM documents WHERE {_sql_text('text', 'worthless idoit')}")


def _highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = LogQuery("events", search_text="error", search_fields=("message",), highlight=True)
    found = highlights(apply_filters(logs(spark, sf_dir), q), q)
    return found.select("id", F.element_at("highlights", "message")[0].alias("fragment"))


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sentences, of which four have a word of the query; the first of those with one word only gives way."""
    q = LogQuery("events", search_text="failed host", search_fields=("message",), highlight=True)
    said = F.concat(F.lit("It failed at once. Nothing else happened! The "), "source", F.lit(" failed on a host.\nThen "), "thread", F.lit(" failed on that host? At last the host was gone"))
    found = highlights(apply_filters(logs(spark, sf_dir).withColumn("message", said), q), q)
    return found.select("id", F.posexplode(F.element_at("highlights", "message")).alias("place", "passage"))


register(
    "highlight_passages",
    _passages,
    """SELECT id, place::INTEGER AS place, replace(replace(passage, 'failed', '<em class="highlight">failed</em>'), ' host', ' <em class="highlight">host</em>') AS passage FROM lines, (SELECT unnest([0, 1, 2]) AS place),
    LATERAL (SELECT ['It failed at once. ', 'The ' || source || ' failed on a host.' || chr(10), 'Then ' || thread || ' failed on that host? '][place + 1] AS passage)""",
)
register("highlight", _highlight, """SELECT id, replace(message, 'error', '<em class="highlight">error</em>') AS fragment FROM lines WHERE event_type = 'error'""")

# ---------------------------------------------------------------- aggregations

_top = lambda field, n=10: f"SELECT {field} AS value, count(*) AS count FROM lines WHERE {field} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n}"
for _name, _field in (("level_distribution", "level"), ("top_loggers", "logger"), ("top_threads", "thread"), ("top_sources", "source"), ("top_hostnames", "hostname"), ("facet_environment", "environment")):
    register(_name, lambda s, d, f=_field: top_values(logs(s, d), f), _top(_field))
HEAVY = {"user": "thread", "logger": "logger", "message": "message"}
register(
    "heavy_values",
    lambda s, d: heavy_values(logs(s, d), (), 7, columns=HEAVY),
    "SELECT * FROM (" + " UNION ALL ".join(f"(SELECT '{n}' AS field, {c} AS value, count(*) AS count FROM lines GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 7)" for n, c in HEAVY.items()) + ")",
)
register(
    "rollup_summary",
    lambda s, d: merged(rollup(logs(s, d)).where("day between '2024-01-05' and '2024-01-20'")),
    """SELECT count(*) AS total_entries, count(*) FILTER (has_error) AS error_count, count(*) FILTER (level = 'WARN') AS warning_count, count(*) FILTER (has_stack_trace) AS stack_trace_count,
    min(timestamp) AS start_time, max(timestamp) AS end_time, count(DISTINCT logger) AS unique_loggers, count(DISTINCT thread) AS unique_threads, count(DISTINCT source) AS unique_sources,
    count(DISTINCT hostname) AS unique_hostnames, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 1000000 AS time_span_seconds FROM lines WHERE timestamp::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
)
FACETS = ("logger", "thread", "source", "hostname", "application")
register("available_fields", lambda s, d: facets(logs(s, d), FACETS, 100), "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, count(*) AS count FROM lines GROUP BY {f}" for f in FACETS) + ")")
register(
    "summary",
    lambda s, d: summary(logs(s, d)),
    """SELECT count(*) AS total_entries, count(*) FILTER (has_error) AS error_count, count(*) FILTER (level = 'WARN') AS warning_count, count(*) FILTER (has_stack_trace) AS stack_trace_count,
    min(timestamp) AS start_time, max(timestamp) AS end_time, count(DISTINCT logger) AS unique_loggers, count(DISTINCT thread) AS unique_threads, count(DISTINCT source) AS unique_sources,
    count(DISTINCT hostname) AS unique_hostnames, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) // 1000000 AS time_span_seconds FROM lines""",
)
register("job_statistics", lambda s, d: job_statistics(logs(s, d)), "SELECT 'total' AS name, count(*) AS count FROM lines UNION ALL SELECT 'errors', count(*) FROM lines WHERE has_error UNION ALL SELECT level, count(*) FROM lines GROUP BY level")
register("errors_per_logger", lambda s, d: errors_per_logger(logs(s, d)), "SELECT coalesce(logger, 'unknown') AS logger, count(*) AS count FROM lines WHERE level = 'ERROR' GROUP BY 1")
register("top_error_messages", lambda s, d: top_error_messages(logs(s, d)), "SELECT message, count(*) AS count FROM lines WHERE has_error GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")


def _timeline_sql(every: str) -> str:
    unit = {"1m": "minute", "1h": "hour", "1d": "day", "1w": "week", "1M": "month"}.get(every)
    step = f"INTERVAL 1 {unit}" if unit else f"INTERVAL {every[:-1]} {'second' if every[-1] == 's' else 'minute'}"
    start = f"date_trunc('{unit}', timestamp)::TIMESTAMP" if unit else f"time_bucket({step}, timestamp)"
    return f""", c AS (SELECT {start} AS bucket_start, count(*) AS n, count(*) FILTER (level = 'ERROR') AS e, count(*) FILTER (level = 'WARN') AS w FROM lines GROUP BY 1),
b AS (SELECT unnest(generate_series((SELECT min(bucket_start) FROM c), (SELECT max(bucket_start) FROM c), {step})) AS bucket_start)
SELECT bucket_start, coalesce(n, 0) AS count, coalesce(e, 0) AS error_count, coalesce(w, 0) AS warning_count FROM b LEFT JOIN c USING (bucket_start)"""


for _every in ("1m", "5m", "15m", "30m", "1h", "1d", "1w", "1M"):
    register("timeline_month" if _every == "1M" else f"timeline_{_every}", lambda s, d, e=_every: timeline(logs(s, d), e), _timeline_sql(_every))
register(
    "timeline_1s",
    lambda s, d: timeline(logs(s, d), "1s").groupBy(F.date_trunc("HOUR", "bucket_start").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("buckets"), F.sum("count").alias("count"), F.sum("error_count").alias("error_count"), F.max("count").alias("most")),
    "SELECT date_trunc('hour', bucket_start)::TIMESTAMP AS hour, count(*) AS buckets, sum(count)::BIGINT AS count, sum(error_count)::BIGINT AS error_count, max(count) AS most FROM (" + _timeline_sql("1s").replace(", c AS", "WITH c AS", 1) + ") GROUP BY 1",
)
register(
    "timeline_outlier",
    lambda s, d: envelope(timeline(logs(s, d).withColumn("timestamp", F.when(F.col("line_number") == 1, F.lit("3024-01-01 00:00:30").cast("timestamp_ntz")).otherwise(F.col("timestamp"))), "15m")),
    "SELECT min(time_bucket(INTERVAL 15 MINUTE, t)) AS start_time, max(time_bucket(INTERVAL 15 MINUTE, t)) AS end_time, count(*)::BIGINT AS total_count FROM (SELECT CASE WHEN line_number = 1 THEN TIMESTAMP '3024-01-01 00:00:30' ELSE timestamp END AS t FROM lines)",
)
register("timeline_levels", lambda s, d: timeline_levels(logs(s, d), "1d"), "SELECT date_trunc('day', timestamp)::TIMESTAMP AS bucket_start, level, count(*) AS count FROM lines GROUP BY ALL")
register("timeline_envelope", lambda s, d: envelope(timeline(logs(s, d), "1h")), "SELECT min(date_trunc('hour', timestamp))::TIMESTAMP AS start_time, max(date_trunc('hour', timestamp))::TIMESTAMP AS end_time, count(*)::BIGINT AS total_count FROM lines")

# ---------------------------------------------------------------- parsers

CORE = ("line_number", "timestamp", "level", "message", "logger", "thread", "source", "has_error")


def event_lines(spark: SparkSession, sf_dir: str, line: Column) -> DataFrame:
    return as_lines(logs(spark, sf_dir), F.col("line_number"), line)


register("parse_text", lambda s, d: parse_text(event_lines(s, d, F.col("raw_line")), OPTS).select(*CORE, F.element_at("metadata", "user").alias("user")), "SELECT line_number, timestamp, level, trim(message) AS message, logger, thread, source, level = 'ERROR' AS has_error, user_id::VARCHAR AS user FROM lines")
register(
    "parse_spring_boot",
    lambda s, d: parse_text(event_lines(s, d, F.concat(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("  "), F.col("level"), F.lit(" 42 --- ["), F.col("thread"), F.lit("] "), F.col("logger"), F.lit(" : "), F.col("message"))), OPTS).select(*CORE),
    "SELECT line_number, timestamp, level, trim(message) AS message, logger, thread, source, level = 'ERROR' AS has_error FROM lines",
)
register(
    "parse_iso",
    lambda s, d: parse_text(event_lines(s, d, F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z "), F.col("level"), F.lit("  "), F.col("source"))), OPTS).select("line_number", "timestamp", "level", "message"),
    "SELECT line_number, timestamp, level, source AS message FROM lines",
)
register(
    "parse_simple",
    lambda s, d: parse_text(event_lines(s, d, F.concat(F.lit("["), F.date_format("timestamp", "yyyy/MM/dd HH:mm:ss"), F.lit("] "), F.lower("level"), F.lit(": at work"))), OPTS).select("line_number", "timestamp", "level", "message"),
    "SELECT line_number, date_trunc('second', timestamp)::TIMESTAMP AS timestamp, level, 'at work' AS message FROM lines",
)


def _parse_apache(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = logs(spark, sf_dir, "user_id")
    status = F.when(F.col("level") == "ERROR", "503").when(F.col("level") == "WARN", "404").otherwise("200")
    line = F.concat(F.lit("10.0.0."), F.col("user_id") % 256, F.lit(" - user"), F.col("user_id"), F.lit(" ["), F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), F.col("source"), F.lit(' HTTP/1.1" '), status, F.lit(" "), F.col("line_number"), F.lit(' "-" "agent"'))
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    return parse_text(as_lines(e, F.col("line_number"), line), OPTS).select("line_number", "timestamp", "level", "message", "has_error", meta("client_ip").alias("client_ip"), meta("user").alias("user"), meta("http_status").alias("http_status"), meta("bytes").alias("bytes"), meta("referer").alias("referer"), meta("user_agent").alias("user_agent"))


register(
    "parse_access_log",
    _parse_apache,
    """SELECT line_number, date_trunc('second', timestamp)::TIMESTAMP AS timestamp, CASE level WHEN 'ERROR' THEN 'ERROR' WHEN 'WARN' THEN 'WARN' ELSE 'INFO' END AS level,
    'GET /' || source || ' HTTP/1.1 ' || CASE level WHEN 'ERROR' THEN '503' WHEN 'WARN' THEN '404' ELSE '200' END AS message, CASE WHEN level = 'ERROR' THEN true END AS has_error,
    '10.0.0.' || (user_id % 256) AS client_ip, 'user' || user_id AS user, CASE level WHEN 'ERROR' THEN '503' WHEN 'WARN' THEN '404' ELSE '200' END AS http_status, line_number::VARCHAR AS bytes,
    NULL::VARCHAR AS referer, 'agent' AS user_agent FROM lines""",
)
register(
    "parse_syslog",
    lambda s, d: parse_text(event_lines(s, d, F.concat(F.date_format("timestamp", "MMM d HH:mm:ss"), F.lit(" "), F.col("hostname"), F.lit(" "), F.col("source"), F.lit("["), F.col("line_number"), F.lit("]: "), F.col("thread"))), OPTS).select("line_number", "timestamp", "level", "message", "logger", "hostname", "has_error", F.element_at("metadata", "pid").alias("pid")),
    "SELECT line_number, date_trunc('second', timestamp)::TIMESTAMP AS timestamp, 'INFO' AS level, thread AS message, source AS logger, hostname, NULL::BOOLEAN AS has_error, line_number::VARCHAR AS pid FROM lines",
)


def _json_line() -> Column:
    return F.to_json(F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("@timestamp"), F.lower("level").alias("severity"), F.col("message").alias("msg"), F.col("logger"), F.col("thread").alias("thread_name"), F.col("hostname").alias("host"), F.col("application").alias("service"), F.col("environment").alias("env"), F.col("line_number").alias("seq"), F.col("tags")))


register(
    "parse_json",
    lambda s, d: parse_json(event_lines(s, d, _json_line()), OPTS).select(*CORE, "hostname", "application", "environment", F.element_at("metadata", "seq").alias("seq"), F.element_at("tags", 1).alias("tag")),
    "SELECT line_number, timestamp, level, message, logger, thread, source, level = 'ERROR' AS has_error, hostname, application, environment, line_number::VARCHAR AS seq, tags[1] AS tag FROM lines",
)
register(
    "parse_json_epoch",
    lambda s, d: parse_json(event_lines(s, d, F.concat(F.lit('{"time":'), F.unix_millis(F.col("timestamp").cast("timestamp")).cast("string"), F.lit(',"level":30,"exception":"X"}'))), OPTS).select("line_number", "timestamp", "level", "stack_trace", "has_error", "has_stack_trace"),
    "SELECT line_number, timestamp, '30' AS level, 'X' AS stack_trace, false AS has_error, true AS has_stack_trace FROM lines",
)


def _parse_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = logs(spark, sf_dir)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    rows = as_lines(e, F.col("line_number") + 1, F.concat_ws(",", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS"), F.lower("level"), quoted("message"), F.col("logger"), F.col("thread"), F.col("line_number").cast("string")))
    head = spark.createDataFrame([("events.log", 1, "ts,severity,msg,logger,thread,seq")], rows.schema)
    return parse_csv(head.unionByName(rows), OPTS).select((F.col("line_number") - 1).alias("line_number"), "timestamp", "level", "message", "logger", "thread", "source", "has_error", F.element_at("metadata", "seq").alias("seq"))


register("parse_csv", _parse_csv, "SELECT line_number, timestamp, level, message, logger, thread, NULL::VARCHAR AS source, level = 'ERROR' AS has_error, line_number::VARCHAR AS seq FROM lines")


def _parse_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files, by the users' numbers: one with a header, one with another order of columns and delimiter, one without header."""
    e = logs(spark, sf_dir, "user_id")
    at, kind = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS"), F.col("user_id") % 3
    line = F.when(kind == 0, F.concat_ws(",", at, "level", "source", "thread")).when(kind == 1, F.concat_ws(";", "source", "thread", at, "level")).otherwise(F.concat_ws("\t", at, "level", "source", F.lit("7")))
    rows = e.select(F.concat(F.lit("f"), kind).alias("file_name"), (F.col("line_number") + 1).alias("line_number"), line.alias("line"))
    heads = spark.createDataFrame([("f0", 1, "ts,severity,msg,thread"), ("f1", 1, "description;shelf;time;priority")], rows.schema)
    found = parse_csv(heads.unionByName(rows), replace(OPTS, file_name=None))
    return found.select("file_name", (F.col("line_number") - 1).alias("line_number"), "timestamp", "level", "message", "thread", F.try_element_at("metadata", F.lit("shelf")).alias("shelf"), F.try_element_at("metadata", F.lit("column_3")).alias("spare"))


register(
    "parse_csv_files",
    _parse_csv_files,
    """SELECT 'f' || (user_id % 3) AS file_name, line_number, timestamp, level, source AS message, CASE WHEN user_id % 3 = 0 THEN thread END AS thread, CASE WHEN user_id % 3 = 1 THEN thread END AS shelf,
    CASE WHEN user_id % 3 = 2 THEN '7' END AS spare FROM lines""",
)
register(
    "json_metadata_case",
    lambda s, d: parse_json(event_lines(s, d, F.to_json(F.struct(F.col("level").alias("LEVEL"), F.col("source").alias("Msg"), F.col("thread").alias("Shelf"), F.col("line_number").alias("seq")))), OPTS).select("line_number", "level", "message", F.element_at("metadata", "Shelf").alias("shelf"), F.size("metadata").alias("kept")),
    "SELECT line_number, NULL::VARCHAR AS level, NULL::VARCHAR AS message, thread AS shelf, 4 AS kept FROM lines",
)

# ---------------------------------------------------------------- files


#: Lines of a log file; logs with more go on in further files, so no task sorts or writes a whole log.
FILE_LINES = 250_000


def in_files(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` in their order, dealt out so that a task has the lines of one file, or of the end of a log and the beginning of the next."""
    return rows.repartitionByRange(max(4, -(-rows.count() // FILE_LINES)), *order).sortWithinPartitions(*order)


def log_files(spark: SparkSession, sf_dir: str, line: Column, suffix: str, head: str | None = None) -> str:
    """Events as log files under the folder that the cluster shares, four logs, by the users' numbers; the folder."""
    path = fresh_folder(spark, "logs", suffix)
    e = logs(spark, sf_dir, "user_id")
    rows = e.select((F.col("user_id") % 4).alias("part"), "line_number", line.alias("value"))
    if head:
        rows = rows.unionByName(spark.range(4).select(F.col("id").alias("part"), F.lit(0).cast("long").alias("line_number"), F.lit(head).alias("value")))
    in_files(rows, "part", "line_number").drop("line_number").write.partitionBy("part").text(path)
    return path


def _ingested(spark: SparkSession, path: str) -> tuple[LogEngine, str]:
    engine = LogEngine(spark, f"{path.rpartition('/')[0]}/store-{uuid.uuid4().hex}")
    return engine, engine.ingest(path, options=replace(OPTS, file_name=None), rotated=True).job_id


def _entries_of(spark: SparkSession, path: str) -> DataFrame:
    engine, job = _ingested(spark, path)
    part = F.regexp_extract("file_name", r"part=(\d)", 1).cast("long").alias("part")
    return engine.entries(job).select(part, "line_number", "timestamp", "level", "message", "logger", "thread")


NUMBERED = ", numbered AS (SELECT *, user_id % 4 AS part, row_number() OVER (PARTITION BY user_id % 4 ORDER BY line_number) AS n FROM lines)"
register("ingest_text", lambda s, d: _entries_of(s, log_files(s, d, F.col("raw_line"), ".log")), NUMBERED + " SELECT part, n AS line_number, timestamp, level, trim(message) AS message, logger, thread FROM numbered")
register("ingest_json", lambda s, d: _entries_of(s, log_files(s, d, _json_line(), ".json")), NUMBERED + " SELECT part, n AS line_number, timestamp, level, message, logger, thread FROM numbered")
register(
    "ingest_csv",
    lambda s, d: _entries_of(s, log_files(s, d, F.concat_ws(",", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS"), "level", "source", "logger", "thread"), ".csv", "time,level,msg,logger,thread")),
    NUMBERED + " SELECT part, n + 1 AS line_number, timestamp, level, source AS message, logger, thread FROM numbered",
)


def _job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that a job of CSV files has, of which some lines are torn and some blank."""
    line = F.when(F.col("level") == "WARN", F.lit('2024-01-01,"open')).when(F.col("level") == "DEBUG", F.lit(" ")).otherwise(F.concat_ws(",", F.lit("2024-01-01 00:00:00"), "level"))
    engine, job_id = _ingested(spark, log_files(spark, sf_dir, line, ".csv", "time,level"))
    job = engine.job_status(job_id)
    return spark.createDataFrame([(job.status, job.total_lines, job.successful_lines, job.failed_lines)], "status string, total_lines long, successful_lines long, failed_lines long")


register("ingest_accounting", _job_counts, "SELECT 'COMPLETED' AS status, count(*) + 4 AS total_lines, count(*) FILTER (level NOT IN ('WARN', 'DEBUG')) AS successful_lines, count(*) FILTER (level = 'WARN') AS failed_lines FROM lines")


def _charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four logs, one in each charset, with the byte order mark that its files begin with, read as one job."""
    path = fresh_folder(spark, "charsets", ".log")
    e = logs(spark, sf_dir, "user_id")
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of a task's rows, which make a file
    for part, (charset, mark) in enumerate((("UTF-8", b""), ("UTF-8", b"\xef\xbb\xbf"), ("UTF-16BE", b"\xfe\xff"), ("UTF-16LE", b"\xff\xfe"))):
        rows = in_files(e.where(F.col("user_id") % 4 == part).select("line_number", F.encode("raw_line", charset).alias("line")), "line_number")
        line = F.concat(F.when(first, F.lit(mark)).otherwise(F.lit(b"")), "line")
        writer = rows.select(line.cast("string").alias("value")).write
        (writer if charset == "UTF-8" else writer.option("encoding", charset).option("lineSep", "\n")).text(f"{path}/part={part}")
    return _entries_of(spark, path)


register("ingest_charsets", _charsets, NUMBERED + " SELECT part, n AS line_number, timestamp, level, trim(message) AS message, logger, thread FROM numbered")


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a job of text files with stack traces, blank and loose lines tells of itself, as observed while it wrote its entries."""
    path = fresh_folder(spark, "traces", ".log")
    rows = trace_lines(spark, sf_dir, (F.col("user_id") % 4).alias("part"))
    in_files(rows, "part", "line_number").select("part", F.col("line").alias("value")).write.partitionBy("part").text(path)
    engine, job_id = _ingested(spark, path)
    job = engine.job_status(job_id)
    names = ("total_lines", "processed_lines", "successful_lines", "failed_lines", "skipped_lines", "continuation_lines", "success_rate", "bytes_read", "total_entries", "saved_entries", "failed_entries", "batches", "error_count", "inferred_timestamps", "split_traces")
    kinds = ", ".join(f"{n} {'double' if n == 'success_rate' else 'long'}" for n in names)
    return spark.createDataFrame([tuple(getattr(job, n) for n in names)], kinds)


STATISTICS = """, of_files AS (SELECT *, max(CASE WHEN class IN ('B', 'E', 'I', 'M') THEN n END) OVER (PARTITION BY user_id % 4 ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_in_file FROM five),
told AS (SELECT m.*, CASE WHEN m.class IN ('S', 'U') AND l.class IN ('E', 'I') THEN m.last_in_file ELSE m.n END AS own_head FROM of_files m LEFT JOIN five l ON l.n = m.last_in_file),
counted AS (SELECT count(*) AS total_lines, count(*) FILTER (class <> 'B' AND own_head = n) AS good, count(*) FILTER (class = 'B') AS blank, count(*) FILTER (own_head <> n) AS more, sum(strlen(line) + 1)::BIGINT AS bytes_read,
  count(*) FILTER (own_head = n AND (class = 'E' OR class IN ('I', 'M') AND level = 'ERROR')) AS errors, count(*) FILTER (own_head = n AND class IN ('E', 'S', 'U')) AS inferred FROM told)
SELECT total_lines, total_lines AS processed_lines, good AS successful_lines, 0::BIGINT AS failed_lines, blank AS skipped_lines, more AS continuation_lines, good * 100.0::DOUBLE / total_lines AS success_rate, bytes_read,
  good AS total_entries, good AS saved_entries, 0::BIGINT AS failed_entries, (good + 999) // 1000 AS batches, errors AS error_count, inferred AS inferred_timestamps, 0::BIGINT AS split_traces FROM counted"""


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of files by a sample of their lines, whatever they are called."""
    kinds = {"text": F.col("raw_line"), "json": _json_line(), "csv": F.concat_ws(",", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "level", "source", "logger", "thread")}
    found = []
    for name, line in kinds.items():
        path = log_files(spark, sf_dir, line, ".data")
        found.append((name, Registry().detect(path, sample_text(spark, path)).format))
    return spark.createDataFrame(found, "name string, format string")


register("detect_formats", _detected, "SELECT * FROM (VALUES ('text', 'TEXT'), ('json', 'JSON'), ('csv', 'CSV')) AS t(name, format)")


def _export_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export written as CSV files and read again."""
    path = fresh_folder(spark, "export")
    write_export(logs(spark, sf_dir), path, ExportOptions(fields=("lineNumber", "level", "message", "hasError")))
    return spark.read.csv(path, header=True, quote='"', escape='"', schema="lineNumber string, level string, message string, hasError string").select("lineNumber", "level", "message", F.coalesce("hasError", F.lit("")).alias("hasError"))


register("export_csv_file", _export_read, "SELECT line_number::VARCHAR AS \"lineNumber\", level, message, coalesce(has_error::VARCHAR, '') AS \"hasError\" FROM lines")


def parsed_traces(spark: SparkSession, sf_dir: str, parse: Callable[[DataFrame, ParseOptions], DataFrame]) -> DataFrame:
    lines = trace_lines(spark, sf_dir)
    return parse(lines, replace(OPTS, about_lines=5 * events(spark, sf_dir).count()))


def trace_lines(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Events as lines, five for each: errors tell of an exception and have a trace of two lines; others are one line.
    Every fifth line is blank where the user's number divides by 7, and else a loose one."""
    e = logs(spark, sf_dir, "user_id")
    error = F.col("level") == "ERROR"
    five = F.array(
        F.when(error, F.concat(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" [main] ERROR com.shop.Job - failed: TimeoutException"))).otherwise(F.col("raw_line")),
        F.when(error, F.lit("java.util.TimeoutException: late")).otherwise(F.col("raw_line")),
        F.when(error, F.lit("\tat com.shop.Job.run(Job.java:7)")).otherwise(F.col("raw_line")),
        F.when(error, F.lit("Caused by: none")).otherwise(F.col("raw_line")),
        F.when(F.col("user_id") % 7 == 0, F.lit(" ")).otherwise(F.lit("a loose line")),
    )
    rows = e.select(F.lit("events.log").alias("file_name"), F.col("line_number").alias("event"), *more, F.posexplode(five).alias("k", "line"))
    return rows.withColumn("line_number", (F.col("event") * 5 - 4 + F.col("k")).cast("long")).drop("event", "k")


TRACES = """, five AS (
  SELECT line_number * 5 - 4 + k AS n, k, level, user_id, raw_line,
    CASE WHEN k = 4 THEN CASE WHEN user_id % 7 = 0 THEN ' ' ELSE 'a loose line' END
         WHEN level <> 'ERROR' THEN raw_line
         ELSE [strftime(timestamp, '%Y-%m-%d %H:%M:%S.%g') || ' [main] ERROR com.shop.Job - failed: TimeoutException', 'java.util.TimeoutException: late', chr(9) || 'at com.shop.Job.run(Job.java:7)', 'Caused by: none'][k + 1] END AS line,
    CASE WHEN k = 4 THEN CASE WHEN user_id % 7 = 0 THEN 'B' ELSE 'U' END WHEN level <> 'ERROR' THEN 'M' ELSE ['I', 'E', 'S', 'S'][k + 1] END AS class
  FROM lines, (SELECT unnest(range(5)) AS k)),
marked AS (SELECT *, max(CASE WHEN class IN ('B', 'E', 'I', 'M') THEN n END) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_n FROM five),
headed AS (SELECT m.*, CASE WHEN m.class IN ('S', 'U') AND l.class IN ('E', 'I') THEN m.last_n ELSE m.n END AS head FROM marked m LEFT JOIN five l ON l.n = m.last_n)"""
register(
    "multiline_traces",
    lambda s, d: parsed_traces(s, d, parse_text).select("line_number", "level", "stack_trace", "has_stack_trace", "has_error"),
    TRACES
    + """ SELECT h.n AS line_number, CASE WHEN h.class = 'E' THEN 'ERROR' WHEN h.class IN ('I', 'M') THEN h.level ELSE 'INFO' END AS level, t.trace AS stack_trace, CASE WHEN t.trace IS NOT NULL THEN true END AS has_stack_trace,
    CASE WHEN h.class = 'E' THEN true WHEN h.class IN ('I', 'M') THEN h.level = 'ERROR' END AS has_error
  FROM headed h LEFT JOIN (SELECT head, string_agg(line, chr(10) ORDER BY n) FILTER (n <> head OR class IN ('E', 'S')) AS trace FROM headed GROUP BY head) t ON t.head = h.n
  WHERE h.head = h.n AND h.class <> 'B'""",
)
register(
    "job_accounting",
    lambda s, d: line_accounting(parsed_traces(s, d, text_status)),
    TRACES
    + """ SELECT count(*) AS total_lines, count(*) FILTER (class <> 'B' AND head = n) AS successful_lines, 0::BIGINT AS failed_lines, count(*) FILTER (class = 'B') AS skipped_lines, count(*) FILTER (head <> n) AS continuation_lines,
    count(*) FILTER (class <> 'B' AND head = n) * 100.0::DOUBLE / count(*) AS success_rate FROM headed""",
)
register(
    "json_failures",
    lambda s, d: json_status(event_lines(s, d, F.when(F.col("level") == "ERROR", F.lit('{"level":')).when(F.col("level") == "WARN", F.lit('{"level":}')).when(F.col("level") == "DEBUG", F.lit(" ")).otherwise(_json_line()))).select("line_number", "parse_status", "error_message"),
    "SELECT line_number, CASE level WHEN 'ERROR' THEN 'FAILED' WHEN 'WARN' THEN 'FAILED' WHEN 'DEBUG' THEN 'SKIPPED' ELSE 'SUCCESS' END AS parse_status, CASE level WHEN 'ERROR' THEN 'Not valid JSON' WHEN 'WARN' THEN 'JSON parse error' END AS error_message FROM lines",
)

register("ingest_statistics", _statistics, TRACES + STATISTICS)

# ---------------------------------------------------------------- the engine's calls over an ingested job

_jobs: dict[tuple[str, str], tuple[LogEngine, str]] = {}
IN_FILE = "*part=1/*"


def shop(spark: SparkSession, sf_dir: str) -> tuple[LogEngine, str]:
    """An engine with the events' log files as a job, which is made once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _jobs:
        _jobs[key] = _ingested(spark, log_files(spark, sf_dir, F.col("raw_line"), ".log"))
    return _jobs[key]


def call(name: str, query: Callable[[LogEngine, str], DataFrame], sql: str) -> None:
    register(name, lambda s, d: query(*shop(s, d)), NUMBERED + sql)


FOUND = dict(levels=("ERROR",), file_name=IN_FILE, sort_by="lineNumber", sort_direction="asc")
call("engine_search", lambda e, j: e.search(LogQuery(j, **FOUND, page=1, size=40, include_fields=("lineNumber", "level", "thread", "timestamp")), posted=True).entries, " SELECT n AS line_number, level, thread, timestamp FROM numbered WHERE part = 1 AND level = 'ERROR' ORDER BY n LIMIT 40 OFFSET 40")
call(
    "engine_search_summary",
    lambda e, j: e.search(LogQuery(j, search_text="signup user", search_fields=("message",))).summary.select("total_entries", "error_count", "warning_count", "start_time", "end_time", "unique_threads", "unique_hostnames"),
    " SELECT count(*) AS total_entries, 0::BIGINT AS error_count, count(*) AS warning_count, min(timestamp) AS start_time, max(timestamp) AS end_time, count(DISTINCT thread) AS unique_threads, 0::BIGINT AS unique_hostnames FROM numbered WHERE source = 'signup'",
)
call("engine_search_levels", lambda e, j: e.search(LogQuery(j, file_name=IN_FILE)).level_counts, " SELECT level AS value, count(*) AS count FROM numbered WHERE part = 1 GROUP BY level")
call(
    "engine_search_highlights",
    lambda e, j: e.search(LogQuery(j, **FOUND, search_text="error", search_fields=("message",), highlight=True, size=30)).highlights.select(F.element_at("highlights", "message")[0].alias("passage")),
    " SELECT replace(trim(message), 'error', '<em class=\"highlight\">error</em>') AS passage FROM numbered WHERE part = 1 AND level = 'ERROR' ORDER BY n LIMIT 30",
)
call("engine_context", lambda e, j: e.context(j, 42, 5, 7, IN_FILE).select("line_number", "raw_line"), " SELECT n AS line_number, raw_line FROM numbered WHERE part = 1 AND n BETWEEN 37 AND 49")
call("engine_count", lambda e, j: e.spark.createDataFrame([(e.count(LogQuery(j, has_error=True)), e.job_status(j).saved_entries)], "errors long, entries long"), " SELECT count(*) FILTER (level = 'ERROR') AS errors, count(*) AS entries FROM numbered")
call("engine_result", lambda e, j: e.job_result(j), " SELECT 'total' AS name, count(*) AS count FROM numbered UNION ALL SELECT 'errors', count(*) FILTER (level = 'ERROR') FROM numbered UNION ALL SELECT level, count(*) FROM numbered GROUP BY level")
call(
    "engine_fields",
    lambda e, j: e.fields(j),
    " SELECT 'level' AS field, unnest(['ERROR', 'WARN', 'INFO', 'DEBUG', 'TRACE']) AS value, NULL::BIGINT AS count UNION ALL " + " UNION ALL ".join(f"SELECT '{f}', {f}, count(*) FROM numbered GROUP BY {f}" for f in ("logger", "thread", "source")),
)
call("engine_timeline", lambda e, j: e.timeline(j, "1d"), _timeline_sql("1d").replace(" FROM lines ", " FROM numbered "))
call("engine_top_values", lambda e, j: e.top_values_of(j, ("logger", "thread"), 5), " SELECT * FROM (" + " UNION ALL ".join(f"(SELECT '{f}' AS field, {f} AS value, count(*) AS count FROM numbered GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)" for f in ("logger", "thread")) + ")")
call("engine_rollups", lambda e, j: e.summary_of([j]).select("total_entries", "error_count", "warning_count", "start_time", "end_time", "unique_loggers", "unique_threads"), " SELECT count(*) AS total_entries, count(*) FILTER (level = 'ERROR') AS error_count, count(*) FILTER (level = 'WARN') AS warning_count, min(timestamp) AS start_time, max(timestamp) AS end_time, count(DISTINCT logger) AS unique_loggers, count(DISTINCT thread) AS unique_threads FROM numbered")


def _exported(engine: LogEngine, job_id: str, kind: str) -> DataFrame:
    """An export of one file's errors, read again: as one JSON text, or as files of JSON lines."""
    q, opts = LogQuery(job_id, **FOUND), ExportOptions(kind, max_records=2000)
    names = ("line_number", "level", "message", "timestamp")
    if kind == "json":
        rows = [tuple(o[n] for n in names) for o in json.loads("".join(engine.export(q, opts)))]
        found = engine.spark.createDataFrame(rows, "line_number long, level string, message string, timestamp string")
    else:
        path = fresh_folder(engine.spark, "export")
        engine.write_export(q, path, opts)
        found = engine.spark.read.schema("line_number long, level string, message string, timestamp string").json(path)
    return found.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


for _kind in ("json", "ndjson"):
    call(f"engine_export_{_kind}", lambda e, j, k=_kind: _exported(e, j, k), " SELECT n AS line_number, level, trim(message) AS message, timestamp FROM numbered WHERE part = 1 AND level = 'ERROR' ORDER BY n LIMIT 2000")

# ---------------------------------------------------------------- text functions and export

register(
    "extract_from_pages",
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", address(F.col("html")).alias("ip_address"), link(F.concat(F.lit("see "), F.col("url"))).alias("link"), request_id(F.concat(F.lit("Trace-Id: t-"), F.col("page_id"))).alias("request_id")),
    """SELECT page_id, nullif(regexp_extract(html, '\\b(?:(?:\\d{1,3}\\.){3}\\d{1,3}|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4})\\b'), '') AS ip_address, nullif(regexp_extract(url, 'https?://[^\\s"''<>]+'), '') AS link, 't-' || page_id AS request_id FROM pages""".replace("\\\\", "\\"),
)
register(
    "key_values",
    lambda s, d: logs(s, d).select("line_number", line_entries(F.concat(F.col("message"), F.lit(" user=last a.b='quoted text'")), []).alias("e")).select("line_number", as_metadata(F.col("e")).alias("m")).select("line_number", F.element_at("m", "user").alias("user"), F.element_at("m", "a.b").alias("quoted")),
    "SELECT line_number, 'last' AS user, 'quoted text' AS quoted FROM lines",
)
register("tokenize_documents", lambda s, d: document_entries(s, d).select("line_number", F.size(tokens(F.col("message"))).cast("long").alias("tokens")), f"SELECT doc_id AS line_number, len(regexp_extract_all(lower(coalesce(text, '')), '{SQL_TOKEN}')) AS tokens FROM documents")
register(
    "export_rows",
    lambda s, d: export_rows(logs(s, d), ExportOptions(fields=("lineNumber", "timestamp", "level", "hasError", "metadata"))),
    "SELECT line_number::VARCHAR AS \"lineNumber\", strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%g') AS timestamp, level, coalesce(has_error::VARCHAR, '') AS \"hasError\", '' AS metadata FROM lines",
)
