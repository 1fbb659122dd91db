"""Timestamps without a zone, to the millisecond.  Offsets are dropped, epochs are UTC; what can't be parsed is null."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DATE_TIME = r"^(\d{4}-\d{2}-\d{2})[T\s](\d{2}:\d{2}:\d{2})(?:[.,](\d{1,9}))?\s*(?:Z|[+-]\d{2}:?\d{2})?$"
#: Further patterns, in the order in which they are tried.
TEXT_PATTERNS = ((r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$", "yyyy/MM/dd HH:mm:ss"), (r"^\w{3} \d{2}, \d{4} \d{2}:\d{2}:\d{2}$", "MMM dd, yyyy HH:mm:ss"))
CSV_PATTERNS = ((r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$", "yyyy/MM/dd HH:mm:ss"), (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$", "dd/MM/yyyy HH:mm:ss"), (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$", "MM/dd/yyyy HH:mm:ss"))


def millis(c: Column) -> Column:
    return F.date_trunc("MILLISECOND", c).cast("timestamp_ntz")


def _ntz(c: Column) -> Column:
    return c.try_cast("timestamp_ntz")


def date_time(s: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss` and the ISO forms, with up to nine digits of fraction and an offset that is dropped."""
    plain = F.rtrim(F.regexp_replace(s, DATE_TIME, "$1 $2.$3"), F.lit("."))
    return F.when(s.rlike(DATE_TIME), _ntz(plain))


def by_patterns(s: Column, patterns: tuple[tuple[str, str], ...]) -> list[Column]:
    return [F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(p)).cast("timestamp_ntz")) for shape, p in patterns]


def access_log_time(s: Column) -> Column:
    """`dd/MMM/yyyy:HH:mm:ss`, without the offset that may follow."""
    first = F.split(s, r"\s")[0]
    return F.when(first.rlike(r"^\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(first, F.lit("dd/MMM/yyyy:HH:mm:ss")).cast("timestamp_ntz"))


def syslog_time(s: Column, year: int) -> Column:
    """`MMM d HH:mm:ss`, which has no year of its own."""
    full = F.concat(F.lit(f"{year:04d} "), F.regexp_replace(s, r"\s+", " "))
    return F.when(s.rlike(r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(full, F.lit("yyyy MMM d HH:mm:ss")).cast("timestamp_ntz"))


def epoch(s: Column) -> Column:
    """Whole numbers: milliseconds beyond 10^12, else seconds."""
    n = F.when(s.rlike(r"^[+-]?\d{1,18}$"), s.cast("long"))
    micros = F.when(n > 1_000_000_000_000, n * 1000).when(n.between(-10**12, 10**12), n * 1_000_000)
    return _ntz(F.timestamp_micros(micros))


def checked_pattern(spark: SparkSession, pattern: str | None) -> str | None:
    """The pattern if Spark accepts it; a wrong one is ignored."""
    if not pattern:
        return None
    try:
        spark.range(1).select(F.try_to_timestamp(F.lit("x"), F.lit(pattern))).collect()
    except Exception:  # what Spark raises depends on what is wrong with the pattern
        return None
    return pattern


def _user(s: Column, pattern: str | None) -> list[Column]:
    return [F.try_to_timestamp(s, F.lit(pattern)).cast("timestamp_ntz")] if pattern else []


def text_time(s: Column, pattern: str | None, year: int) -> Column:
    """The time that a trimmed text tells, by a grammar's field."""
    return millis(F.coalesce(*_user(s, pattern), date_time(s), *by_patterns(s, TEXT_PATTERNS), access_log_time(s), syslog_time(s, year)))


def json_time(s: Column, pattern: str | None, year: int) -> Column:
    """The time that a trimmed JSON value tells."""
    return millis(F.coalesce(*_user(s, pattern), date_time(s), epoch(s), *by_patterns(s, TEXT_PATTERNS), access_log_time(s)))


def csv_time(s: Column, pattern: str | None, year: int) -> Column:
    """The time that a trimmed cell tells."""
    return millis(F.coalesce(*_user(s, pattern), epoch(s), date_time(s), *by_patterns(s, CSV_PATTERNS)))
