"""Sort, page and projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import LogQuery
from ..schema import LOG_ENTRY_SCHEMA, column_name


def sort_entries(entries: DataFrame, q: LogQuery) -> DataFrame:
    """By one field, missing values last either way, then by line and id."""
    c = F.col(column_name(q.sort_by))
    return entries.orderBy(c.asc_nulls_last() if q.ascending else c.desc_nulls_last(), "line_number", "id")


def page_of(entries: DataFrame, q: LogQuery) -> DataFrame:
    return sort_entries(entries, q).offset(q.page * q.size).limit(q.size)


def project(entries: DataFrame, q: LogQuery) -> DataFrame:
    """Included fields without the excluded; unknown names are ignored."""
    known = [f.name for f in LOG_ENTRY_SCHEMA if f.name in entries.columns]
    include = {column_name(f) for f in q.include_fields or ()} & set(known)
    exclude = {column_name(f) for f in q.exclude_fields or ()}
    return entries.select(*[c for c in known if (not include or c in include) and c not in exclude])


def context_query(job_id: str, line: int, before: int = 5, after: int = 5) -> LogQuery:
    """The lines around a line, in order."""
    return LogQuery(job_id, min_line=max(1, line - before), max_line=line + after, sort_by="line_number", sort_direction="asc", size=before + after + 1, include_summary=False)


@dataclass(frozen=True)
class Cursor:
    """The place of an entry in a sort: its sort value, line and id."""

    value: object
    line_number: int | None
    id: str | None


def after(q: LogQuery, cursor: Cursor) -> Column:
    """What follows the cursor's entry in the order of `sort_entries`."""
    c, line, key = F.col(column_name(q.sort_by)), F.col("line_number"), F.col("id")
    # ascending, nulls first, as Spark sorts lines and ids
    later_id = key.isNotNull() if cursor.id is None else key > cursor.id
    same_line = line.isNull() if cursor.line_number is None else line == cursor.line_number
    later_line = line.isNotNull() if cursor.line_number is None else line > cursor.line_number
    within = later_line | same_line & later_id
    if cursor.value is None:
        return c.isNull() & within
    value = F.lit(cursor.value).cast("timestamp_ntz") if column_name(q.sort_by) == "timestamp" else F.lit(cursor.value)
    beyond = c > value if q.ascending else c < value
    return beyond | (c == value) & within | c.isNull()


def page_after(entries: DataFrame, q: LogQuery, cursor: Cursor | None) -> DataFrame:
    """The first `size` entries after the cursor: a predicate and a bounded sort, no offset."""
    return sort_entries(entries if cursor is None else entries.where(after(q, cursor)), q).limit(q.size)


def cursor_of(page: DataFrame, q: LogQuery) -> Cursor | None:
    """The place of a page's last entry, if the page is full."""
    c = column_name(q.sort_by)
    rows = page.select(F.col(c).alias("value"), "line_number", "id").collect()  # a page
    return Cursor(*rows[-1]) if len(rows) == q.size else None
