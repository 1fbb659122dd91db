"""Text log lines: six grammars, tried in order, and what to do with lines that none fits."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import normal_level, status_level
from ..functions.metadata import as_metadata, entry, line_entries
from ..functions.texts import filled, source_of, trim
from ..functions.times import checked_pattern, text_time
from ..options import ParseOptions
from ..schema import STATUS, conform
from .multiline import assign_heads, attach_traces


class Grammar(NamedTuple):
    name: str
    pattern: str
    groups: tuple[str, ...]
    multi_line: bool


#: The grammars and line classes.
_LEVELS = "TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|SEVERE"
_STAMP = r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,6})?"
GRAMMARS = (
    Grammar("SPRING_BOOT", rf"(?i)^({_STAMP})\s+(TRACE|DEBUG|INFO|WARN|ERROR)\s+(\d+)?\s*---\s+\[\s*([^\]]+)\]\s+([\w.$]+)\s*:\s+(.*)$", ("timestamp", "level", "pid", "thread", "logger", "message"), True),
    Grammar("LOG4J", rf"(?i)^({_STAMP})\s+(?:\[([^\]]+)\]\s+)?({_LEVELS})\s+(?:([\w.$]+)\s+[-:]\s+)?(.*)$", ("timestamp", "thread", "level", "logger", "message"), True),
    Grammar("APACHE", r'(?i)^([\d.]+|[\da-f:]+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d{3})\s+(\d+|-)(?:\s+"([^"]*)"\s+"([^"]*)")?$', ("ip", "ident", "user", "timestamp", "request", "status", "bytes", "referer", "useragent"), False),
    Grammar("SYSLOG", r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+([\w.-]+)\s+([\w.-]+)(?:\[(\d+)\])?:?\s+(.*)$", ("timestamp", "hostname", "service", "pid", "message"), True),
    Grammar("ISO", rf"(?i)^(\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d+)?(?:Z|[+-]\d{{2}}:?\d{{2}})?)\s+({_LEVELS})?\s*(.*)$", ("timestamp", "level", "message"), True),
    Grammar("SIMPLE", rf"(?i)^\[?([^\]]+)\]?\s+({_LEVELS})\s*:?\s+(.*)$", ("timestamp", "level", "message"), True),
)
STACK_LINE = r"^(?:\s+at\s+|\s+\.{3}\s+\d+\s+more|Caused\s+by:|Suppressed:)"
EXCEPTION_LINE = r"^(?:[\w.$]+(?:Exception|Error|Throwable))(?::\s+.*)?$"
INDICATORS = ("Exception", "Error", "Throwable")

#: Stands between a line's groups once they are found; private, so no text means anything by it.
_CUT = "\uE000"
#: Places of the groups once they are found.  The last is that of every grammar's last group, which is a message or a user agent.
_LAST = "message or useragent"
_PLACES = ("timestamp", "level", "thread", "logger", "service", "hostname", "ip", "user", "request", "status", "bytes", "referer", "pid", _LAST)


def _placed(g: Grammar) -> str:
    """What a line of the grammar is replaced by: its groups at their places."""
    at = {name: f"${k + 1}" for k, name in enumerate(g.groups)}
    return _CUT.join(at.get(name, "") for name in _PLACES[:-1]) + f"{_CUT}${len(g.groups)}"


def _has_indicator(c: Column) -> Column:
    return reduce(Column.__or__, [c.contains(w) for w in INDICATORS])


def class_lines(lines: DataFrame, opts: ParseOptions) -> DataFrame:
    """`lines` (file_name, line_number, line) with format, the grammar that fits, and class: what a line is told from, without its fields.

    Whether a message tells of an exception is looked up only where the line has such a word.
    """
    line = F.col("line")
    lines = lines.select("file_name", "line_number", F.substring(line, 1, opts.max_line_length).alias("line"))
    bare = trim(line)
    kind = F.when(line.isNull() | (bare == ""), "B").when(line.rlike(STACK_LINE), "S").when(bare.rlike(EXCEPTION_LINE), "E")
    lines = lines.withColumn("_kind", kind)
    name = F.lit(None).cast("string")
    for g in reversed(GRAMMARS):
        name = F.when(line.rlike(g.pattern), F.lit(g.name)).otherwise(name)
    lines = lines.withColumn("format", F.when(F.col("_kind").isNull(), name))
    tells = F.lit(False)
    for g in GRAMMARS:
        if g.multi_line:
            said = F.regexp_replace(line, g.pattern, f"${g.groups.index('message') + 1}")
            tells = F.when(F.col("format") == g.name, _has_indicator(said)).otherwise(tells)
    known = F.when(F.col("format").isNull(), "U").when(_has_indicator(line) & tells, "I").otherwise("M")
    return lines.select("file_name", "line_number", "line", "format", F.coalesce("_kind", known).alias("class"))


def line_fields(lines: DataFrame) -> DataFrame:
    """The rows of `class_lines`, with the fields of the grammar that fits.

    It is applied once: it puts a mark between the line's groups, at which the line is split.  All grammars' groups go to the same
    places, so that a field is told by its place alone: with a case for each grammar and field the task's code is so long that
    the JVM only interprets it.
    """
    line, rest = F.col("line"), lines.columns
    marked = F.lit(None).cast("string")
    for g in GRAMMARS:
        marked = F.when(F.col("format") == g.name, F.regexp_replace(line, g.pattern, _placed(g))).otherwise(marked)
    lines = lines.withColumn("_groups", F.split(marked, _CUT, len(_PLACES)))
    group = lambda name: filled(F.get("_groups", F.lit(_PLACES.index(name))))
    last, apache = group(_LAST), F.col("format") == "APACHE"
    lines = lines.select(*rest, *[group(n).alias(f"_{n}") for n in _PLACES[:-1]], F.when(~apache, last).alias("_message"), F.when(apache, last).alias("_useragent"))
    said = F.coalesce(trim("_message"), F.when(F.col("_request").isNotNull(), trim(F.concat_ws(" ", "_request", "_status"))), F.when(F.col("format") == "APACHE", trim(F.concat(F.lit(" "), F.col("_status")))), F.when(F.col("format").isNotNull(), F.lit("")))
    return lines.withColumn("_said", said)


def match_lines(lines: DataFrame, opts: ParseOptions) -> DataFrame:
    """`lines` (file_name, line_number, line) with format, class and the fields of the grammar that fits."""
    return line_fields(class_lines(lines, opts))


def line_status(matched: DataFrame) -> DataFrame:
    """file_name, line_number, line, parse_status, error_message of `assign_heads`' lines."""
    status = F.when(F.col("class") == "B", "SKIPPED").when(F.col("head_line") != F.col("line_number"), "CONTINUATION").when(F.col("class").isin("E", "I"), "BUFFERED").otherwise("SUCCESS")
    return matched.select("file_name", "line_number", "line", status.alias("parse_status"), F.lit(None).cast("string").alias("error_message"))


def parse_text(lines: DataFrame, opts: ParseOptions, spark=None) -> DataFrame:
    """Entries of `lines`, stack traces attached."""
    return conform(text_entries(_heads(lines, opts), opts))


def text_records(lines: DataFrame, opts: ParseOptions) -> DataFrame:
    """A row for each entry and each blank line of `lines`, with what became of them."""
    return text_entries(_heads(lines, opts, blank=True), opts)


def _heads(lines: DataFrame, opts: ParseOptions, blank: bool = False) -> DataFrame:
    """The entries' first lines with their traces.  Lines are shuffled as they are; fields are made of first lines only, thereafter."""
    heads = assign_heads(class_lines(lines, opts), opts.about_lines)
    return line_fields(attach_traces(heads, blank, about_lines=opts.about_lines))


def text_status(lines: DataFrame, opts: ParseOptions) -> DataFrame:
    """What became of each line.  Only what tells that is carried along, so it is what both sides of `assign_heads` share."""
    return line_status(assign_heads(class_lines(lines, opts).drop("format"), opts.about_lines))


def text_entries(heads: DataFrame, opts: ParseOptions) -> DataFrame:
    form, cls = F.col("format"), F.col("class")
    status = F.col("_status").try_cast("int")
    level = F.when(cls == "E", F.lit("ERROR")).when(F.col("_level").isNotNull(), normal_level(F.col("_level"))).when(form == "APACHE", status_level(status)).otherwise("INFO")
    has_error = F.when(cls == "E", F.lit(True)).when(F.col("_level").isNotNull(), normal_level(F.col("_level")) == "ERROR").when((form == "APACHE") & (status >= 500), F.lit(True))
    logger = F.coalesce("_logger", "_service")
    real = lambda c: F.when(F.col(c) != "-", F.col(c))
    of = lambda name, key, value: F.when(form == name, entry(key, value)).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    more = [of("APACHE", "client_ip", F.col("_ip")), of("APACHE", "user", real("_user")), of("APACHE", "http_status", F.col("_status")), of("APACHE", "bytes", real("_bytes")), of("APACHE", "referer", real("_referer")), of("APACHE", "user_agent", real("_useragent")), of("SYSLOG", "pid", F.col("_pid"))]
    heads = heads.withColumns({"_time": trim(F.col("_timestamp")), "_entries": F.when(form.isNotNull(), line_entries(F.col("line"), more))})
    stamp = text_time(F.col("_time"), checked_pattern(heads.sparkSession, opts.timestamp_format), opts.year)
    return finish(
        heads.withColumns(
            {
                "_stamp": stamp,
                "level": level,
                "has_error": has_error,
                "message": F.coalesce("_said", "line"),
                "thread": trim(F.col("_thread")),
                "logger": logger,
                "source": source_of(logger),
                "hostname": F.col("_hostname"),
                "metadata": as_metadata(F.col("_entries")),
                "has_stack_trace": F.when(F.col("stack_trace").isNotNull(), F.lit(True)),
                "parse_status": F.when(cls == "B", "SKIPPED").when(cls.isin("E", "I"), "BUFFERED").otherwise("SUCCESS"),
                "error_message": F.lit(None).cast("string"),
            }
        ),
        opts,
    )


def finish(entries: DataFrame, opts: ParseOptions) -> DataFrame:
    """What all parsers add: id, job, file, raw line, times; `STATUS` is kept.  `_stamp` is the parsed timestamp or null."""
    at = F.lit(opts.ingest_ts).cast("timestamp_ntz")
    name = F.lit(opts.file_name) if opts.file_name else F.col("file_name")
    return conform(
        entries.withColumns(
            {
                "file_name": name,
                "job_id": F.lit(opts.job_id),
                "id": F.sha2(F.concat_ws("|", F.lit(opts.job_id), name, F.col("line_number").cast("string")), 256),
                "raw_line": F.col("line"),
                "timestamp": F.coalesce("_stamp", at),
                "timestamp_inferred": F.col("_stamp").isNull(),
                "indexed_at": at,
            }
        ),
        STATUS,
    )
