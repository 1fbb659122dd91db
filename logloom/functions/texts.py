"""Column functions on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+(?:['.][\p{L}_]+|[.,]\p{N}+)*"

#: The characters up to U+0020.
_BLANKS = "".join(map(chr, range(0x21)))


def trim(c: Column) -> Column:
    """Without characters up to U+0020 at both ends."""
    return F.btrim(c, F.lit(_BLANKS))


def filled(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def source_of(logger: Column) -> Column:
    """The last part of a dotted name; trailing dots are no parts."""
    return filled(F.element_at(F.split(F.regexp_replace(logger, r"\.+$", ""), r"\."), -1))


def tokens(c: Column) -> Column:
    """Lower-case words of a text: an approximation of Unicode word boundaries."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), 0)
