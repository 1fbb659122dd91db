"""A query's filters as one predicate, which reaches the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..options import LogQuery, is_wildcard
from .fulltext import matches_text

KEYWORD_FILTERS = ("file_name", "logger", "thread", "source", "hostname", "application", "environment")


def like_pattern(value: str) -> str:
    """`*` and `?` as LIKE writes them; what LIKE would take for its own is escaped."""
    escaped = value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return escaped.replace("*", "%").replace("?", "_")


def keyword_filter(name: str, value: str) -> Column:
    return F.col(name).like(like_pattern(value)) if is_wildcard(value) else F.col(name) == value


def predicates(q: LogQuery) -> list[Column]:
    """Flags compare as they are: a null is neither true nor false."""
    out = [F.col("job_id") == q.job_id]
    if q.levels:
        out.append(F.col("level").isin(*[v.upper() for v in q.levels]))
    out += [keyword_filter(n, v) for n in KEYWORD_FILTERS if (v := getattr(q, n)) and v.strip()]
    out += [F.col(n) == F.lit(v) for n in ("has_error", "has_stack_trace") if (v := getattr(q, n)) is not None]
    if q.tags:
        out.append(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in q.tags])))
    if q.start_date is not None:
        out.append(F.col("timestamp") >= F.lit(q.start_date).cast("timestamp_ntz"))
    if q.end_date is not None:
        out.append(F.col("timestamp") <= F.lit(q.end_date).cast("timestamp_ntz"))
    if q.min_line is not None:
        out.append(F.col("line_number") >= q.min_line)
    if q.max_line is not None:
        out.append(F.col("line_number") <= q.max_line)
    if q.search_text and q.search_text.strip():
        out.append(matches_text(q.search_text, q.effective_search_fields))
    return out


def apply_filters(entries: DataFrame, q: LogQuery) -> DataFrame:
    return entries.where(reduce(lambda a, b: a & b, predicates(q)))
