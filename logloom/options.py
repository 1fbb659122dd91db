"""Requests as plain values, checked when they are made or used."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime
from math import ceil

from .errors import InvalidQueryError
from .schema import KEYWORDS, SORTABLE, TEXTS, column_name


@dataclass(frozen=True)
class ParseOptions:
    """How a file is read.  ingest_ts stands in for timestamps that can't be parsed, instead of the wall clock."""

    job_id: str = "job"
    file_name: str | None = None
    timestamp_format: str | None = None
    ingest_ts: datetime = datetime(1970, 1, 1)
    default_year: int | None = None  # of syslog lines; else that of ingest_ts
    max_line_length: int = 100_000
    csv_delimiter: str | None = None
    csv_quote: str = '"'
    csv_header: str = "auto"  # auto, true, false
    csv_headers: tuple[str, ...] | None = None
    column_mapping: dict[str, str] = field(default_factory=dict)  # column name to field
    about_lines: int | None = None  # the number of lines, if known: shuffles of many lines have more parts then

    @property
    def year(self) -> int:
        return self.default_year or self.ingest_ts.year


@dataclass(frozen=True)
class LogQuery:
    """Filters that all must hold, a text search, a sort, a page and a projection."""

    job_id: str | None
    search_text: str | None = None
    search_fields: tuple[str, ...] | None = None
    levels: tuple[str, ...] = ()
    logger: str | None = None
    thread: str | None = None
    source: str | None = None
    file_name: str | None = None
    hostname: str | None = None
    application: str | None = None
    environment: str | None = None
    has_error: bool | None = None
    has_stack_trace: bool | None = None
    tags: tuple[str, ...] = ()
    start_date: datetime | str | None = None
    end_date: datetime | str | None = None
    min_line: int | None = None
    max_line: int | None = None
    sort_by: str = "timestamp"
    sort_direction: str | None = "desc"
    page: int = 0
    size: int = 50
    include_fields: tuple[str, ...] | None = None
    exclude_fields: tuple[str, ...] | None = None
    include_summary: bool = True
    highlight: bool = False

    def __post_init__(self):
        for name in ("start_date", "end_date"):
            value = getattr(self, name)
            if isinstance(value, str):
                object.__setattr__(self, name, datetime.fromisoformat(value))

    @property
    def ascending(self) -> bool:
        return (self.sort_direction or "").lower() == "asc"

    @property
    def effective_search_fields(self) -> tuple[str, ...]:
        return tuple(column_name(f) for f in self.search_fields) if self.search_fields else TEXTS

    @property
    def has_filters(self) -> bool:
        words = (self.logger, self.thread, self.source, self.file_name, self.hostname, self.application, self.environment)
        rest = (self.has_error, self.has_stack_trace, self.start_date, self.end_date, self.min_line, self.max_line)
        return bool(self.levels or self.tags or any(words) or any(v is not None for v in rest))

    def validate(self) -> LogQuery:
        """Checks that the store makes of every search."""
        if not (self.job_id or "").strip():
            raise InvalidQueryError("jobId", self.job_id, "a job id is required")
        if self.start_date and self.end_date and self.start_date > self.end_date:
            raise InvalidQueryError("dateRange", None, "the start date must not be after the end date")
        if self.min_line is not None and self.max_line is not None and self.min_line > self.max_line:
            raise InvalidQueryError("lineRange", None, "the first line must not be after the last")
        if column_name(self.sort_by) not in SORTABLE:
            raise InvalidQueryError("sortBy", self.sort_by, f"can't sort by {self.sort_by!r}; sortable are {', '.join(SORTABLE)}")
        return self

    def validate_page(self) -> LogQuery:
        """Checks that only posted requests undergo."""
        if self.page < 0:
            raise InvalidQueryError("page", self.page, "pages count from 0")
        if not 1 <= self.size <= 1000:
            raise InvalidQueryError("size", self.size, "a page has 1 to 1000 entries")
        return self


@dataclass(frozen=True)
class Pagination:
    page: int
    size: int
    total: int

    @property
    def total_pages(self) -> int:
        return ceil(self.total / self.size) if self.size else 0

    @property
    def has_next(self) -> bool:
        return self.page < self.total_pages - 1

    @property
    def has_previous(self) -> bool:
        return self.page > 0

    @property
    def first_element(self) -> int:
        return self.page * self.size

    @property
    def last_element(self) -> int:
        return max(0, min(self.first_element + self.size - 1, self.total - 1))


@dataclass(frozen=True)
class ExportOptions:
    format: str = "csv"  # csv, json, ndjson
    fields: tuple[str, ...] = ("timestamp", "level", "logger", "thread", "message", "lineNumber", "fileName")
    max_records: int = 10_000
    header: bool = True
    delimiter: str = ","

    def __post_init__(self):
        if self.format.lower() not in ("csv", "json", "ndjson"):
            raise InvalidQueryError("format", self.format, "formats are csv, json and ndjson")
        if not 1 <= self.max_records <= 100_000:
            raise InvalidQueryError("maxRecords", self.max_records, "an export has 1 to 100000 records")


#: The intervals of a timeline; fixed ones have a length, the others follow the calendar.
FIXED_INTERVALS = {"1s": "1 second", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes"}
CALENDAR_INTERVALS = {"1m": "MINUTE", "1h": "HOUR", "1d": "DAY", "1w": "WEEK", "1M": "MONTH"}


def interval(value: str | None) -> str:
    """The interval of that name, in any case if no name matches exactly; an hour if none does."""
    known = [*FIXED_INTERVALS, *CALENDAR_INTERVALS]
    if value in known:
        return value
    return next((k for k in known if value and k.lower() == value.lower()), "1h")


def keyword_field(name: str) -> str:
    column = column_name(name)
    if column not in KEYWORDS:
        raise InvalidQueryError(name, None, f"field {name!r} is not supported for this operation")
    return column


def is_wildcard(value: str) -> bool:
    return bool(re.search(r"[*?]", value))
