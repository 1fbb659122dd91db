"""What a task has to hold doesn't grow with the input."""

import os
import re
from datetime import datetime
from random import Random

import duckdb
import pytest
from pyspark.sql import functions as F

from logloom.functions.metadata import pairs
from logloom.llm.queries import QUERIES as QUERIES_OF_TEXTS
from logloom.operators.fulltext import swaps, word_matches
from logloom.operators.highlight import highlights
from logloom.operators.multiline import assign_heads, attach_traces
from logloom.operators.textlog import class_lines, line_fields, match_lines
from logloom.options import LogQuery, ParseOptions
from logloom.queries import ORACLE_SQL, QUERIES, log_files
from logloom.sources.lines import FileScan
from logloom.sources.scratch import kept

from .test_queries import SF, rows


def test_shares_of_many_lines_do_not_grow(spark, monkeypatch):
    """Lines known to be many are dealt out in parts of half a block, also where all are of one file, and a long trace goes on over blocks."""
    monkeypatch.setattr("logloom.operators.multiline.BLOCK_LINES", 10)
    given = [("f", n, "2024-01-01 00:00:00 [t] ERROR a.B - TimeoutException" if n in (1, 96) else "\tat a.B.c(B.java:1)" if n < 90 else " " if n == 90 else f"loose {n}") for n in range(1, 101)]
    lines = spark.createDataFrame(given, "file_name string, line_number long, line string").withColumn("file_name", F.lit("f"))
    opts = ParseOptions(ingest_ts=datetime(2024, 1, 1), about_lines=100)
    heads = assign_heads(match_lines(lines, opts), opts.about_lines)
    assert heads.rdd.getNumPartitions() == 20
    got = {r["line_number"]: (r["lines"], r["stack_trace"]) for r in attach_traces(heads, about_lines=100).collect()}
    assert got[1] == (89, "\n".join(["\tat a.B.c(B.java:1)"] * 88)) and got[96] == (5, "loose 97\nloose 98\nloose 99\nloose 100")
    assert sorted(got) == [1, *range(91, 97)]
    assert "_timestamp" not in attach_traces(assign_heads(class_lines(lines, opts), 100)).columns


FILED = ("ingest_text", "ingest_json", "ingest_csv", "ingest_accounting", "ingest_statistics", "ingest_charsets", "engine_count", "engine_export_json", "engine_search", "engine_search_levels", "detect_formats")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_logs_of_many_files(spark, monkeypatch):
    """No task has a whole log, and what is told of a log of many files is what is told of one."""
    monkeypatch.setattr("logloom.queries.FILE_LINES", 50)
    monkeypatch.setattr("logloom.queries._jobs", {})
    path = log_files(spark, SF, F.lit("x"), ".log")
    sizes = [r["count"] for r in spark.read.text(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 100
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    for name in FILED:
        df = QUERIES[name](spark, SF)
        got = con.execute(ORACLE_SQL[name])
        order = [[d[0] for d in got.description].index(n) for n in df.columns]
        assert rows(df.collect()) == rows([r[i] for i in order] for r in got.fetchall()), name


def test_rotated_files_are_one_log(spark, tmp_path):
    for folder, files in {"a": ("1\n2\n", "", "3\n"), "b": ("4\n",)}.items():
        (tmp_path / folder).mkdir()
        for i, text in enumerate(files):
            (tmp_path / folder / f"part-{i}.log").write_text(text)
    scan = FileScan(spark, [str(tmp_path / "a"), str(tmp_path / "b")], rotated=True)
    got = sorted((r["file_name"].rpartition("/")[0][-1:] + r["file_name"][-2:], r["line_number"], r["line"]) for r in scan.lines().collect())
    assert got == [("a/*", 1, "1"), ("a/*", 2, "2"), ("a/*", 3, "3"), ("b/*", 1, "4")]
    assert (scan.line_count, scan.longest_file, scan.byte_count) == (4, 3, 8)


def test_fields_are_compiled(spark):
    """The JVM doesn't compile methods of more than 8000 bytes of code."""
    lines = spark.createDataFrame([("f", 1, "2024-01-01 00:00:00 [t] INFO a.B - x")], "file_name string, line_number long, line string")
    # Read from a file, so that no plan of rows in memory is evaluated ahead.
    classed = kept(class_lines(lines, ParseOptions(ingest_ts=datetime(2024, 1, 1))), "classed")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    code = debug.codegenString(line_fields(classed)._jdf.queryExecution().executedPlan())
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000


def test_pairs_are_found_in_one_go(spark):
    """A line is looked through once, and what is found is what the two patterns of before find."""
    before = re.compile(r"""([\w.]+)=(["']?)([^"'\s,]+|[^"']+)\2""", re.ASCII)
    rng = Random(7)
    said = ["".join(rng.choice(["a", "b.c", "=", "=", '"', "'", " ", ",", "-", "é", "1"]) for _ in range(rng.randint(1, 16))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in said], "t string").select("t", pairs(F.col("t")).alias("p"))
    assert str(df._jdf.queryExecution().optimizedPlan()).count("regexp_extract_all") == 1
    got = df.collect()
    assert [[tuple(x) for x in r["p"]] for r in got] == [[(m[1], m[3]) for m in before.finditer(r["t"])] for r in got]
    assert sum(len(r["p"]) for r in got) > 500


def test_passages_are_found_once(spark):
    """However often the passages are looked at, the plan has them made in one place."""
    q = LogQuery("j", search_text="failed host", search_fields=("message",), highlight=True)
    entries = spark.createDataFrame([("1", "It failed. The host"), ("2", "no"), ("3", None)], "id string, message string")
    found = highlights(entries, q).select("id", F.posexplode(F.element_at("highlights", "message")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?s).{1,150}?") == 1
    assert [tuple(r) for r in found.collect()] == [("1", 0, 'It <em class="highlight">failed</em>. '), ("1", 1, 'The <em class="highlight">host</em>')]


def test_words_that_match(spark):
    """The cheaper test lets the same words through as all distances do."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng, word = Random(5), "failed"
    said = {"".join(rng.choice("failedx") if rng.random() < 0.3 else c for c in rng.choice(swaps(word) + [word] + [b for s in swaps(word) for b in swaps(s)]))[: rng.randint(4, 6)] + rng.choice(["", "x"]) for _ in range(1500)}
    once = swaps(word)
    expected = {t for t in said if distance(t, word) <= 2 or any(distance(t, s) <= 1 for s in once) or any(t in swaps(s) for s in once)}
    got = spark.createDataFrame([(t,) for t in said], "t string").where(word_matches(F.col("t"), word)).collect()
    assert {r["t"] for r in got} == expected and 100 < len(expected) < len(said)


def test_decoder_meets_written_ids(spark, monkeypatch):
    """The steps of the decoder's query meet in a table, so no task runs the Python of both."""
    monkeypatch.setattr("logloom.llm.segmentations.SLICE_CHARS", 50)
    df = QUERIES_OF_TEXTS["decode_segmentations"](spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, texts.collect()))
