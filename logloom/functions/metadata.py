"""What is picked out of a line beside its fields.  Values are text; `typed` reads them as numbers or flags."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import filled

#: key=value pairs, addresses, links and request ids.  A pair begins where its key does, so each run of letters is
#: looked through once.
KEY_VALUE = r"""(?<![\w.])[\w.]++=(["']?)(?:[^"'\s,]+|[^"']+)\1"""
ADDRESS = r"\b(?:(?:\d{1,3}\.){3}\d{1,3}|(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4})\b"
LINK = r"""https?://[^\s"'<>]+"""
REQUEST_ID = r"(?i)(?:request[_-]?id|correlation[_-]?id|trace[_-]?id|x-request-id)[=:\s]+([\w-]+)"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once a row, however often `use` looks at it."""
    return F.transform(F.array(value), use)[0]


def last_wins(entries: Column) -> Column:
    """A map of an array of (key, value); of equal keys the last counts, whatever the session's policy.

    Equal keys stand together in a sort by key and place, so a line of many pairs takes no longer than its sort."""
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("place"), e["value"].alias("value"))))
    is_last = lambda s: lambda e, i: F.coalesce(F.get(s, i + 1)["key"] != e["key"], F.lit(True))
    return F.map_from_entries(F.transform(bound(placed, lambda s: F.filter(s, is_last(s))), lambda e: F.struct(e["key"], e["value"])))


def pairs(line: Column) -> Column:
    """The line's key=value pairs.  Neither a key nor what follows the first `=` of a pair has marks of quotation inside."""
    value = lambda m: F.translate(F.substr(m, F.instr(m, "=") + 1), "\"'", "")
    return F.transform(F.regexp_extract_all(line, F.lit(KEY_VALUE), 0), lambda m: F.struct(F.substring_index(m, "=", 1).alias("key"), value(m).alias("value")))


def entry(key: str, value: Column) -> Column:
    """An array with the pair, or none if the value is null.  The value is computed once."""
    return F.filter(F.array(F.struct(F.lit(key).alias("key"), value.alias("value"))), lambda e: e["value"].isNotNull())


def address(line: Column) -> Column:
    return filled(F.regexp_extract(line, ADDRESS, 0))


def link(line: Column) -> Column:
    return filled(F.regexp_extract(line, LINK, 0))


def request_id(line: Column) -> Column:
    named = reduce(Column.__or__, [line.contains(w) for w in ("id", "Id", "ID", "iD")])  # every such name has it
    return F.when(named, filled(F.regexp_extract(line, REQUEST_ID, 1)))


def line_entries(line: Column, more: list[Column]) -> Column:
    """Pairs, first address, link and request id of a line, then `more`, as (key, value)s; later ones override."""
    kv = F.when(line.contains("="), pairs(line)).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    return F.concat(kv, entry("ip_address", address(line)), entry("url", F.when(line.contains("://"), link(line))), entry("request_id", request_id(line)), *more)


def as_metadata(entries: Column) -> Column:
    """The map of a column of entries, null if there are none.  Give it a column of its own: it looks at it often."""
    return F.when(F.size(entries) > 0, last_wins(entries))


def typed(metadata: Column, key: str, kind: str) -> Column:
    return F.try_element_at(metadata, F.lit(key)).try_cast(kind)
