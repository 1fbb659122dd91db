"""Which format a file has: by its extension if a look at its beginning agrees, else by that alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidFileTypeError
from ..operators.csvlog import csv_records, parse_csv
from ..operators.jsonlog import json_records, parse_json
from ..operators.textlog import parse_text, text_records
from ..options import ParseOptions

SAMPLE_LINES = 10
SAMPLE_CHARS = 4096
#: Extensions by format, and those that may be uploaded.
EXTENSIONS = {"JSON": (".json", ".ndjson"), "CSV": (".csv", ".tsv"), "TEXT": (".log", ".txt", ".out", ".err")}
UPLOADABLE = ("log", "txt", "json", "csv")
DELIMITERS = "\t,;|"

Parse = Callable[[DataFrame, ParseOptions], DataFrame]


def sample_text(spark: SparkSession, path: str) -> str:
    """The first lines, until there are ten or over 4096 characters."""
    out, chars = [], 0
    for r in spark.read.text(path).limit(SAMPLE_LINES).collect():
        out.append(r["value"])
        chars += len(r["value"])
        if chars >= SAMPLE_CHARS:
            break
    return "\n".join(out)


def has_extension(name: str | None, kind: str) -> bool:
    return bool(name) and name.lower().endswith(EXTENSIONS[kind])


def looks_like_json(sample: str | None) -> bool:
    s = (sample or "").strip()
    return bool(s) and (s[0], s[-1]) in (("{", "}"), ("[", "]"))


def outside_quotes(line: str, mark: str) -> int:
    return sum(part.count(mark) for part in line.split('"')[::2])


def can_parse_json(name: str | None, sample: str | None) -> bool:
    return has_extension(name, "JSON") or looks_like_json(sample)


def can_parse_csv(name: str | None, sample: str | None) -> bool:
    if has_extension(name, "CSV"):
        return True
    s = (sample or "").strip()
    return bool(s) and s[0] not in "{[" and any(outside_quotes(s.split("\n", 1)[0], d) for d in DELIMITERS)


def can_parse_text(name: str | None, sample: str | None) -> bool:
    s = (sample or "").strip()
    return s[0] not in "{[" if s else has_extension(name, "TEXT")


@dataclass(frozen=True)
class Parser:
    """A format: what makes its entries from lines, and what tells whether a file has it.

    `read` gives a row for each line, or for all lines of an entry, with `STATUS` and the entry's columns: entries and accounting
    come from it, in one pass.  A parser with `parse` alone gives entries; lines with text that have none count as failed.
    """

    format: str
    priority: int
    can_parse: Callable[[str | None, str | None], bool]
    parse: Parse
    multi_line: bool = False
    description: str = ""
    read: Parse | None = None

    def records(self, lines: DataFrame, opts: ParseOptions) -> DataFrame:
        if self.read:
            return self.read(lines, opts)
        entries = self.parse(lines, opts)
        # of several entries of a line the first one stands for it
        line = Window.partitionBy("file_name", "line_number").orderBy("id")
        first = (F.row_number().over(line) == 1).cast("long")
        return entries.withColumns({"parse_status": F.lit("SUCCESS"), "error_message": F.lit(None).cast("string"), "lines": first, "parts": F.lit(1).cast("long")})


class Registry:
    """Parsers by format; detection tries those of higher priority first."""

    def __init__(self, parsers: list[Parser] | None = None):
        self.parsers: list[Parser] = []
        for p in BUILT_IN if parsers is None else parsers:
            self.register(p)

    def register(self, parser: Parser) -> None:
        self.unregister(parser.format)
        self.parsers = sorted([*self.parsers, parser], key=lambda p: -p.priority)

    def unregister(self, kind: str) -> bool:
        kept = [p for p in self.parsers if p.format.upper() != kind.upper()]
        gone, self.parsers = len(kept) < len(self.parsers), kept
        return gone

    def by_format(self, kind: str | None) -> Parser | None:
        return next((p for p in self.parsers if kind and p.format.upper() == kind.upper()), None)

    def has(self, kind: str) -> bool:
        return self.by_format(kind) is not None

    def formats(self) -> list[str]:
        return [p.format for p in self.parsers]

    def info(self) -> dict[str, dict]:
        return {p.format: {"priority": p.priority, "multi_line": p.multi_line, "description": p.description} for p in self.parsers}

    def detect(self, name: str | None, sample: str | None) -> Parser:
        by_name = next((self.by_format(k) for k in EXTENSIONS if has_extension(name, k)), None)
        if by_name and by_name.can_parse(name, sample):
            return by_name
        found = next((p for p in self.parsers if p.can_parse(None, sample) or p.can_parse(name, sample)), None) or self.by_format("TEXT")
        if not found:
            raise InvalidFileTypeError(f"no parser for {name!r}")
        return found


BUILT_IN = [
    Parser("JSON", 20, can_parse_json, parse_json, description="one JSON object a line", read=json_records),
    Parser("CSV", 10, can_parse_csv, parse_csv, description="delimited lines, with or without a header", read=csv_records),
    Parser("TEXT", 0, can_parse_text, parse_text, multi_line=True, description="six grammars of log lines, with stack traces over many", read=text_records),
]


def upload_extension(name: str, allowed: tuple[str, ...] = UPLOADABLE) -> str:
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    if ext not in allowed:
        raise InvalidFileTypeError(f"{name!r}: files may be {', '.join(allowed)}")
    return ext
