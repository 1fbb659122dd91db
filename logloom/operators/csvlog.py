"""Delimited logs, one row a line."""

from __future__ import annotations

import csv

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import normal_csv_level
from ..functions.metadata import as_metadata
from ..functions.texts import filled, trim
from ..functions.times import checked_pattern, csv_time
from ..options import ParseOptions
from ..schema import entries_of
from ..sources.scratch import kept
from .textlog import finish

#: The headers of each field, in the order in which fields are tried.
HEADERS = {
    "timestamp": ("timestamp", "time", "date", "datetime", "@timestamp", "log_time", "logtime", "created_at", "createdat", "ts"),
    "level": ("level", "severity", "log_level", "loglevel", "levelname", "priority", "log_severity"),
    "message": ("message", "msg", "text", "log_message", "logmessage", "description", "content", "body", "log"),
    "logger": ("logger", "logger_name", "loggername", "class", "classname", "category", "source", "component", "module"),
    "thread": ("thread", "thread_name", "threadname", "thread_id", "threadid"),
    "hostname": ("hostname", "host", "server", "machine", "node", "instance"),
    "application": ("application", "app", "service", "service_name", "servicename", "app_name"),
    "environment": ("environment", "env", "stage", "deployment"),
    "stack_trace": ("stack_trace", "stacktrace", "exception", "error_stack", "traceback"),
}
HEADER_MARKS = ("timestamp", "level", "message", "logger")
DELIMITERS = "\t,;|"


def delimiter_of(line: str) -> str:
    """The most frequent delimiter outside quotes, of equally frequent ones the first; a comma if there is none."""
    counts = {d: sum(part.count(d) for part in line.split('"')[::2]) for d in DELIMITERS}
    best = max(DELIMITERS, key=lambda d: counts[d])
    return best if counts[best] else ","


def is_number(s: str) -> bool:
    try:
        float(s)
    except ValueError:
        return False
    return True


def is_header(cells: list[str]) -> bool:
    known = {h for f in HEADER_MARKS for h in HEADERS[f]}
    return bool(cells) and (any(c.strip().lower() in known for c in cells) or not any(c and is_number(c) for c in cells))


def layout(first: str, opts: ParseOptions) -> tuple[str, list[str], dict[str, int], bool]:
    """(delimiter, column names, column of each field, whether the first line is a header) from a file's first line."""
    mark = opts.csv_delimiter or delimiter_of(first)
    cells = next(csv.reader([first], delimiter=mark, quotechar=opts.csv_quote, skipinitialspace=True), [])
    header = not opts.csv_headers and (is_header(cells) if opts.csv_header == "auto" else opts.csv_header == "true")
    if header or opts.csv_headers:
        names = [c.strip() for c in (cells if header else opts.csv_headers)]
        fields = {}
        for i, name in enumerate(names):  # of several columns for a field the last counts
            kind = next((f for f, known in HEADERS.items() if name.lower() in known), None)
            if kind:
                fields[kind] = i
    else:
        names = [f"column_{i}" for i in range(len(cells))]
        fields = {f: i for i, f in enumerate(("timestamp", "level", "message")) if i < len(cells)}
    for name, kind in opts.column_mapping.items():
        if name.lower() in (lower := [n.lower() for n in names]):
            fields[kind] = lower.index(name.lower())
    return mark, names, fields, header


ARROW_LAYOUT = pa.schema([("file_name", pa.string()), ("_first", pa.int64()), ("_mark", pa.string()), ("_names", pa.list_(pa.string())), ("_fields", pa.map_(pa.string(), pa.int32())), ("_header", pa.bool_())])
LAYOUT = "file_name string, _first long, _mark string, _names array<string>, _fields map<string,int>, _header boolean"


def file_layouts(lines: DataFrame, opts: ParseOptions) -> DataFrame:
    """The layout of each file, which follows from its first line with text: a row for each file."""
    first = lines.where(trim(F.col("line")) != "").groupBy("file_name").agg(F.min(F.struct("line_number", "line")).alias("first"))

    def told(batches):
        for b in batches:
            rows = []
            for name, number, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                mark, names, fields, header = layout(line, opts)
                rows.append({"file_name": name, "_first": number, "_mark": mark, "_names": names, "_fields": list(fields.items()), "_header": header})
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW_LAYOUT)

    return first.select("file_name", "first.line_number", "first.line").mapInArrow(told, LAYOUT)


def csv_rows(lines: DataFrame, opts: ParseOptions) -> DataFrame:
    """`lines` with parse_status, error_message, _row (an array of cells), and the _names and _fields of their file's layout."""
    layouts = kept(file_layouts(lines, opts), "layouts")
    # Two numbers and at most four marks for all files.
    size = layouts.agg(F.coalesce(F.max(F.size("_names")), F.lit(1)).alias("width"), F.collect_set("_mark").alias("marks")).first()
    width, marks = max(1, size["width"]), sorted(size["marks"]) or [","]
    rows = lines.join(layouts, "file_name", "left")
    schema = ", ".join(f"`c{i}` string" for i in range(width))
    cells = F.lit(None).cast("array<string>")
    for mark in marks:
        row = F.from_csv("line", F.lit(schema), {"sep": mark, "quote": opts.csv_quote, "escape": opts.csv_quote, "ignoreLeadingWhiteSpace": "true", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
        cells = F.when(F.col("_mark") == mark, row_array(row, width)).otherwise(cells)
    blank = F.col("line").isNull() | (trim(F.col("line")) == "")
    quotes = F.length("line") - F.length(F.replace("line", F.lit(opts.csv_quote), F.lit("")))
    torn = quotes % 2 == 1
    is_head = F.col("_header") & (F.col("line_number") == F.col("_first"))
    status = F.when(blank | is_head, "SKIPPED").when(torn, "FAILED").otherwise("SUCCESS")
    error = F.when(blank, "Empty line").when(is_head, "Header row").when(torn, "CSV parse error: open quote")
    return rows.withColumns({"parse_status": status, "error_message": error, "_row": cells})


def row_array(row: Column, width: int) -> Column:
    """The cells of a struct c0, c1, ... as an array."""
    return F.transform(F.array(row), lambda r: F.array(*[r[f"c{i}"] for i in range(width)]))[0]


def csv_status(lines: DataFrame, opts: ParseOptions) -> DataFrame:
    return csv_rows(lines, opts).select("file_name", "line_number", "line", "parse_status", "error_message")


def parse_csv(lines: DataFrame, opts: ParseOptions) -> DataFrame:
    """Entries of the data rows, each by the layout of its file.  Columns that no field took go to metadata; without a
    message column the other columns but timestamp, level, logger and thread make the message."""
    return entries_of(csv_records(lines, opts))


def csv_records(lines: DataFrame, opts: ParseOptions) -> DataFrame:
    """A row for each line, with its entry if it is a data row."""
    rows = csv_rows(lines, opts).withColumns({"lines": F.lit(1).cast("long"), "parts": F.lit(1).cast("long")})
    at = lambda f: F.try_element_at("_fields", F.lit(f))
    value = lambda f: filled(trim(filled(F.get("_row", at(f)))))
    rows = rows.withColumns({f"_v_{f}": value(f) for f in HEADERS})
    told = {f: F.col(f"_v_{f}") for f in HEADERS}
    level = F.coalesce(normal_csv_level(told["level"]), F.lit("INFO"))
    numbered = F.transform("_names", lambda n, i: F.struct(n.alias("key"), F.get("_row", i).alias("value"), i.alias("i")))
    taken = F.array(*[F.coalesce(at(f), F.lit(-1)) for f in ("timestamp", "level", "logger", "thread")])
    joined = F.concat_ws(" ", F.transform(F.filter(numbered, lambda c: ~F.array_contains(taken, c["i"])), lambda c: F.coalesce(c["value"], F.lit(""))))
    spare = F.filter(numbered, lambda c: filled(c["value"]).isNotNull() & ~F.array_contains(F.map_values("_fields"), c["i"]))
    # Most layouts name all columns that matter, so the lists of the others are made only where there are others.
    others = F.size("_names") > F.size(F.array_distinct(F.map_values("_fields")))
    entries = F.when(others, F.transform(spare, lambda c: F.struct(c["key"].alias("key"), c["value"].alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    stack = told["stack_trace"]
    rows = rows.withColumns({"_time": told["timestamp"], "_entries": entries})
    return finish(
        rows.withColumns(
            {
                "_stamp": csv_time(F.col("_time"), checked_pattern(lines.sparkSession, opts.timestamp_format), opts.year),
                "level": level,
                "message": F.coalesce(told["message"], joined),
                "logger": told["logger"],
                "thread": told["thread"],
                "hostname": told["hostname"],
                "application": told["application"],
                "environment": told["environment"],
                "stack_trace": stack,
                "has_stack_trace": F.when(stack.isNotNull(), F.lit(True)),
                "has_error": level == "ERROR",
                "metadata": as_metadata(F.col("_entries")),
            }
        ),
        opts,
    )
