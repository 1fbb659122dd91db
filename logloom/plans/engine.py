"""The engine: files in, answers out.  Entries are Parquet partitioned by job, so a query reads its job's files only."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import FileTooLargeError, InvalidQueryError, LogProcessingError
from ..operators.aggregates import errors_per_logger, facets, job_statistics, summary, top_error_messages, top_values
from ..operators.csvlog import csv_status
from ..operators.export import export_lines, write_export
from ..operators.filters import apply_filters
from ..operators.heavy import heavy_values
from ..operators.highlight import highlights
from ..operators.jsonlog import json_status
from ..operators.multiline import assign_heads, trace_parts
from ..operators.page import Cursor, context_query, cursor_of, page_after, page_of, project
from ..operators.textlog import class_lines, text_status
from ..operators.timeline import timeline, timeline_levels
from ..options import ExportOptions, LogQuery, Pagination, ParseOptions
from ..schema import HAS_ENTRY, LEVELS, LOG_ENTRY_SCHEMA, entries_of
from ..sources.detect import Registry, sample_text, upload_extension
from ..sources.lines import FileScan, file_sizes
from .jobs import COMPLETED, FAILED, PROCESSING, Job, JobStore, per_second
from .progress import EVERY, watched
from .rollup import merged, rollup

FIELD_LIMIT = 100
#: Entries of a batch, as statistics count them; tasks write more at once.
BATCH_ENTRIES = 1000
TRACES = "job_id string, file_name string, head_line long, part long, text string"


@dataclass(frozen=True)
class SearchResult:
    entries: DataFrame
    pagination: Pagination
    summary: DataFrame | None
    level_counts: DataFrame | None
    highlights: DataFrame | None
    query_time_ms: int


class LogEngine:
    def __init__(self, spark: SparkSession, store: str, registry: Registry | None = None, max_file_size: int | None = None):
        self.spark, self.store, self.registry, self.max_file_size = spark, store.rstrip("/"), registry or Registry(), max_file_size
        self.jobs = JobStore(spark, f"{self.store}/jobs")

    # -- ingest

    def ingest(self, path: str, timestamp_format: str | None = None, job_id: str | None = None, options: ParseOptions | None = None, kind: str | None = None, start_line: int = 1, charset: str | None = None, batch_entries: int = BATCH_ENTRIES, look_every: float = EVERY, rotated: bool = False) -> Job:
        """Parse the files at `path` into a new job; their format is detected unless `kind` names it.

        The files are read twice: once to count their lines, once to parse and write them.  What the job tells of its lines
        and entries is observed on the rows that the second pass writes.  With `rotated` the files of a folder are one log, which goes on
        from file to file in the order of their names.
        """
        upload_extension(path, tuple(e[1:] for e in (".log", ".txt", ".json", ".csv", ".ndjson", ".tsv", ".out", ".err")))
        if start_line < 1:
            raise InvalidQueryError("startLine", start_line, "lines count from 1")
        if self.max_file_size is not None and file_sizes(self.spark, path).where(F.col("bytes") > self.max_file_size).first():
            raise FileTooLargeError(f"{path}: over {self.max_file_size} bytes")
        if job_id and self.jobs.get(job_id):
            raise LogProcessingError(f"there is a job {job_id!r} already")
        now = datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)
        opts = replace(options or ParseOptions(ingest_ts=now), job_id=job_id or uuid.uuid4().hex)
        opts = replace(opts, timestamp_format=timestamp_format or opts.timestamp_format)
        began = time.monotonic()
        job = self.jobs.save(Job(opts.job_id, PROCESSING, 5, file_name=path.rpartition("/")[2], timestamp_format=opts.timestamp_format, started_at=now, start_line=start_line))
        try:
            with watched(self.spark, self.jobs, job, look_every):
                told = self._ingest(path, kind, opts, start_line, charset, rotated)
        except Exception as e:
            self.jobs.save(job, status=FAILED, error=str(e)[:2000], completed_at=datetime.now(timezone.utc).replace(tzinfo=None))
            raise
        ms = max(1, int((time.monotonic() - began) * 1000))
        batches = -(-told["saved_entries"] // batch_entries)
        rates = {"lines_per_second": per_second(told["total_lines"], ms), "bytes_per_second": per_second(told["bytes_read"], ms), "batches": batches, "average_save_ms": told.pop("save_ms") / batches if batches else 0.0}
        return self.jobs.save(job, status=COMPLETED, progress=100, completed_at=datetime.now(timezone.utc).replace(tzinfo=None), processing_time_ms=ms, **told, **rates)

    def _ingest(self, path: str, kind: str | None, opts: ParseOptions, start_line: int, charset: str | None, rotated: bool = False) -> dict:
        """Parse and write; what was observed of it."""
        parser = self.registry.by_format(kind) if kind else self.registry.detect(path, sample_text(self.spark, path))
        if parser is None:
            raise LogProcessingError(f"no parser for the format {kind!r}")
        scan = FileScan(self.spark, path, start_line, charset, rotated)
        opts = replace(opts, about_lines=scan.line_count)
        seen, has_entry = Observation(), F.col("parse_status").isin(*HAS_ENTRY)
        records = parser.records(scan.lines(), opts).observe(
            seen,
            F.count_if(has_entry).alias("entries"),
            F.sum("lines").alias("lines"),
            F.sum(F.when(has_entry, F.greatest(F.col("lines"), F.lit(1)))).alias("entry_lines"),
            F.count_if(has_entry & (F.col("lines") == 0)).alias("further"),
            F.count_if(F.col("parse_status") == "FAILED").alias("failed"),
            F.count_if(F.col("parse_status") == "SKIPPED").alias("skipped"),
            F.count_if(has_entry & F.col("has_error")).alias("errors"),
            F.count_if(has_entry & F.col("timestamp_inferred")).alias("inferred"),
            F.count_if(F.col("parts") > 1).alias("split_traces"),
            *[F.count_if(has_entry & (F.col("level") == v)).alias(f"level_{v}") for v in LEVELS],
        )
        began = time.monotonic()
        entries_of(records).write.mode("append").partitionBy("job_id").parquet(f"{self.store}/entries")
        save_ms = int((time.monotonic() - began) * 1000)
        got = {k: v or 0 for k, v in seen.get.items()}
        if got["split_traces"]:
            traces = trace_parts(assign_heads(class_lines(scan.lines(), opts).drop("format"), opts.about_lines))
            traces = traces.select(F.lit(opts.job_id).alias("job_id"), F.lit(opts.file_name).alias("file_name") if opts.file_name else "file_name", "head_line", "part", "text")
            traces.write.mode("append").partitionBy("job_id").parquet(f"{self.store}/traces")
        rollup(self._stored(opts.job_id)).write.mode("append").partitionBy("job_id").parquet(f"{self.store}/rollups")
        # Without a parser's own statuses, lines with text that made no entry failed.
        blank = scan.blank_count if start_line == 1 else 0
        total = got["lines"] if parser.read else max(scan.line_count - start_line + 1, 0)
        failed = got["failed"] if parser.read else max(total - blank - got["lines"], 0)
        skipped = got["skipped"] if parser.read else min(blank, max(total - got["lines"], 0))
        good = got["entries"] - got["further"]
        return {
            "total_lines": total,
            "processed_lines": total,
            "successful_lines": good,
            "failed_lines": failed,
            "skipped_lines": skipped,
            "continuation_lines": got["entry_lines"] - got["entries"],
            "success_rate": good * 100.0 / total if total else 0.0,
            "end_line": scan.longest_file,
            "bytes_read": scan.byte_count,
            "total_entries": got["entries"],
            "saved_entries": got["entries"],
            "failed_entries": 0,  # a write that fails saves nothing
            "save_ms": save_ms,
            "error_count": got["errors"],
            "inferred_timestamps": got["inferred"],
            "split_traces": got["split_traces"],
            "level_counts": {v: got[f"level_{v}"] for v in LEVELS if got[f"level_{v}"]},
        }

    def status_of(self, kind: str, lines: DataFrame, opts: ParseOptions) -> DataFrame:
        """What became of each line; of formats that aren't built in, every line succeeded."""
        if kind == "TEXT":
            return text_status(lines, opts)
        if kind == "JSON":
            return json_status(lines)
        if kind == "CSV":
            return csv_status(lines, opts)
        return lines.withColumns({"parse_status": F.lit("SUCCESS"), "error_message": F.lit(None).cast("string")})

    # -- jobs

    def job_status(self, job_id: str) -> Job:
        return self.jobs.find(job_id)

    def job_result(self, job_id: str) -> DataFrame | None:
        """Statistics of a completed job, else None."""
        return job_statistics(self.entries(job_id)) if self.jobs.find(job_id).status == COMPLETED else None

    def entries(self, job_id: str) -> DataFrame:
        self.jobs.find(job_id)
        return self._stored(job_id)

    def _stored(self, job_id: str) -> DataFrame:
        return self.spark.read.schema(LOG_ENTRY_SCHEMA).parquet(f"{self.store}/entries").where(F.col("job_id") == job_id)

    def trace(self, job_id: str, line: int, file_name: str | None = None) -> DataFrame:
        """(file_name, part, text) of the whole stack trace of the entry at a line, in parts; the lines of two parts have a line feed
        between them."""
        head = self.entries(job_id).where(F.col("line_number") == line).select("file_name", F.lit(0).cast("long").alias("part"), F.col("stack_trace").alias("text")).where("text is not null")
        if self.jobs.find(job_id).split_traces:
            more = self.spark.read.schema(TRACES).parquet(f"{self.store}/traces").where((F.col("job_id") == job_id) & (F.col("head_line") == line))
            head = head.unionByName(more.select("file_name", "part", "text"))
        return (head.where(F.col("file_name") == file_name) if file_name else head).orderBy("file_name", "part")

    def summary_of(self, job_ids: list[str], first_day: str | None = None, last_day: str | None = None) -> DataFrame:
        """A summary over jobs and days from their rollups: no entry is read, and numbers of different values are estimates."""
        rows = self.spark.read.parquet(f"{self.store}/rollups").where(F.col("job_id").isin(*job_ids))
        if first_day:
            rows = rows.where(F.col("day") >= F.lit(first_day).cast("date"))
        return merged(rows.where(F.col("day") <= F.lit(last_day).cast("date")) if last_day else rows)

    # -- queries

    def search(self, q: LogQuery, posted: bool = False) -> SearchResult:
        began = time.monotonic()
        q.validate()
        if posted:
            q.validate_page()
        found = apply_filters(self.entries(q.job_id), q)
        page = page_of(found, q)
        marks = highlights(page, q) if q.highlight and q.search_text else None
        if q.include_summary:  # it counts the entries as well
            counts = summary(found)
            row = counts.first()
            total, counted = row["total_entries"], (self.spark.createDataFrame([row], counts.schema), top_values(found, "level"))
        else:
            total, counted = found.count(), (None, None)
        return SearchResult(project(page, q), Pagination(q.page, q.size, total), *counted, marks, int((time.monotonic() - began) * 1000))

    def search_after(self, q: LogQuery, cursor: Cursor | None = None) -> tuple[DataFrame, Cursor | None]:
        """A page of what comes after `cursor` (from the beginning without one), and the cursor of its last entry, None if there is
        none.  However far a page is, no entries before it are sorted."""
        found = apply_filters(self.entries(q.validate().job_id), q)
        page = page_after(found, q, cursor)
        return project(page, q), cursor_of(page, q)

    def count(self, q: LogQuery) -> int:
        return apply_filters(self.entries(q.job_id), q).count()

    def summary(self, job_id: str) -> DataFrame:
        return summary(self.entries(job_id))

    def levels(self, job_id: str) -> DataFrame:
        return top_values(self.entries(job_id), "level")

    def timeline(self, job_id: str, interval: str | None = "1h") -> DataFrame:
        return timeline(self.entries(job_id), interval)

    def timeline_levels(self, job_id: str, interval: str | None = "1h") -> DataFrame:
        return timeline_levels(self.entries(job_id), interval)

    def facet(self, job_id: str, field: str, limit: int = FIELD_LIMIT) -> DataFrame:
        return top_values(self.entries(job_id), field, limit)

    def fields(self, job_id: str) -> DataFrame:
        """(field, value, count) of the fields one can choose from; the levels are always the same."""
        found = facets(self.entries(job_id), ("logger", "thread", "source", "hostname", "application"), FIELD_LIMIT)
        levels = self.spark.createDataFrame([("level", v, None) for v in LEVELS], "field string, value string, count long")
        return levels.unionByName(found)

    def errors_per_logger(self, job_id: str) -> DataFrame:
        return errors_per_logger(self.entries(job_id))

    def top_error_messages(self, job_id: str, limit: int = 10) -> DataFrame:
        return top_error_messages(self.entries(job_id), limit)

    def top_values_of(self, job_id: str, fields: tuple[str, ...], limit: int = FIELD_LIMIT) -> DataFrame:
        """(field, value, count), as `facet` has them, without shuffling every different value."""
        return heavy_values(self.entries(job_id), fields, limit)

    def context(self, job_id: str, line: int, before: int = 5, after: int = 5, file_name: str | None = None) -> DataFrame:
        """The entries around a line, of one file if the job has several."""
        if line < 1 or before < 0 or after < 0:
            raise InvalidQueryError("line", line, "lines count from 1, and the numbers of lines around can't be negative")
        q = replace(context_query(job_id, line, before, after), file_name=file_name)
        return page_of(apply_filters(self.entries(job_id), q), q)

    # -- export

    def _exported(self, q: LogQuery, opts: ExportOptions) -> DataFrame:
        q = replace(q, page=0, size=opts.max_records, include_summary=False).validate()
        return page_of(apply_filters(self.entries(q.job_id), q), q)

    def export(self, q: LogQuery, opts: ExportOptions | None = None) -> Iterator[str]:
        opts = opts or ExportOptions()
        return export_lines(self._exported(q, opts), opts)

    def write_export(self, q: LogQuery, path: str, opts: ExportOptions | None = None) -> None:
        opts = opts or ExportOptions()
        write_export(self._exported(q, opts), path, opts)

    def expire(self, days: int = 30, now: datetime | None = None) -> DataFrame:
        """Entries of all jobs that are at most so many days old."""
        return self.spark.read.schema(LOG_ENTRY_SCHEMA).parquet(f"{self.store}/entries").where(F.col("timestamp") >= F.lit(now or datetime.now()) - F.expr(f"INTERVAL {days} DAYS"))
