"""Entries as CSV, JSON or JSON lines: written by Spark, or as text for one download."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from textwrap import indent

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import ExportOptions
from ..schema import column_name

EXPORTABLE = ("id", "job_id", "timestamp", "level", "message", "logger", "thread", "source", "line_number", "raw_line", "file_name", "stack_trace", "hostname", "application", "environment", "has_error", "has_stack_trace")


def export_value(field: str) -> Column:
    """The field as text; empty for a null and for a field that isn't exported."""
    name = column_name(field)
    if name not in EXPORTABLE:
        return F.lit("")
    c = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS") if name == "timestamp" else F.col(name).cast("string")
    return F.coalesce(c, F.lit(""))


def export_rows(entries: DataFrame, opts: ExportOptions) -> DataFrame:
    return entries.select(*[export_value(f).alias(f) for f in opts.fields])


def write_export(entries: DataFrame, path: str, opts: ExportOptions) -> None:
    if opts.format.lower() != "csv":
        entries.write.json(path)  # a JSON object a line
        return
    rows = export_rows(entries, opts)
    # Every value is quoted, so an empty string goes out as a null, which is written as "".
    rows = rows.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in rows.columns])
    rows.write.csv(path, header=opts.header, sep=opts.delimiter[:1], quoteAll=True, escape='"', nullValue="", emptyValue="")


def export_lines(entries: DataFrame, opts: ExportOptions) -> Iterator[str]:
    """The text of an export, which has at most `max_records` entries, a piece at a time."""
    kind = opts.format.lower()
    if kind == "csv":
        out = io.StringIO()
        writer = csv.writer(out, delimiter=opts.delimiter[:1], quoting=csv.QUOTE_ALL, lineterminator="\n")
        if opts.header:
            writer.writerow(opts.fields)
        for r in export_rows(entries, opts).toLocalIterator():
            writer.writerow(r)
            yield out.getvalue()
            out.seek(0)
            out.truncate()
        yield out.getvalue()
        return
    objects = (r["o"] for r in entries.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"}).alias("o")).toLocalIterator())
    if kind == "ndjson":
        yield from (o + "\n" for o in objects)
    else:
        before = "["
        for o in objects:
            yield before + "\n" + indent(json.dumps(json.loads(o), indent=2), "  ")
            before = ","
        yield "[]" if before == "[" else "\n]"
