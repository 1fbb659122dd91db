"""Log levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import trim

#: Other names of levels in text and JSON, and those that only CSV knows.
ALIASES = {"WARNING": "WARN", "SEVERE": "ERROR", "FATAL": "ERROR", "CRITICAL": "ERROR", "FINE": "DEBUG", "FINER": "DEBUG", "FINEST": "DEBUG", "VERBOSE": "DEBUG", "CONFIG": "INFO", "NOTICE": "INFO"}
CSV_ALIASES = ALIASES | {"ALERT": "ERROR", "EMERGENCY": "ERROR", "DBG": "DEBUG", "INFORMATIONAL": "INFO", "TRC": "TRACE"}


def _mapped(upper: Column, aliases: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, upper), upper)


def normal_level(level: Column) -> Column:
    return _mapped(F.upper(level), ALIASES)


def normal_csv_level(level: Column) -> Column:
    return _mapped(trim(F.upper(level)), CSV_ALIASES)


def status_level(status: Column) -> Column:
    """The level of an HTTP status."""
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO")
