"""Requests, detection, and the engine from files to answers."""

import json
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.errors import FileTooLargeError, InvalidFileTypeError, InvalidQueryError, JobNotFoundError, LogProcessingError
from logloom.operators.aggregates import approximate_summary, top_values
from logloom.operators.fulltext import edits, query_words, swaps
from logloom.operators.heavy import heavy_values
from logloom.operators.multiline import PART_LINES
from logloom.operators.page import Cursor, cursor_of, page_after, sort_entries
from logloom.operators.textlog import finish
from logloom.operators.timeline import timeline
from logloom.options import ExportOptions, LogQuery, Pagination, ParseOptions, interval
from logloom.plans.engine import LogEngine
from logloom.plans.jobs import per_second, progress
from logloom.schema import conform
from logloom.sources.detect import Parser, Registry, upload_extension
from logloom.sources.lines import FileScan, read_lines
from logloom.streaming.tail import append_to, stream_json, stream_timeline

LINES = """2024-01-15 10:30:45.123 [main] ERROR com.shop.Cart - TimeoutException while paying
\tat com.shop.Cart.pay(Cart.java:42)
2024-01-15 10:31:00.000 [w-1] WARN com.shop.Stock - low stock user=7
2024-01-15 10:40:00.000 [w-1] INFO com.shop.Stock - refilled

2024-01-15 12:00:00.000 [w-2] INFO com.shop.Cart - paid, "quoted"
"""


def test_requests():
    q = LogQuery("j").validate().validate_page()
    assert (q.page, q.size, q.sort_by, q.ascending, q.include_summary, q.highlight, q.effective_search_fields, q.has_filters) == (0, 50, "timestamp", False, True, False, ("message", "raw_line", "stack_trace"), False)
    assert LogQuery("j", sort_direction="ASC").ascending and not LogQuery("j", sort_direction="up").ascending and LogQuery("j", has_error=False).has_filters
    for bad in (LogQuery(None), LogQuery(" "), LogQuery("j", start_date="2024-01-02", end_date="2024-01-01"), LogQuery("j", min_line=200, max_line=100), LogQuery("j", sort_by="invalidField"), LogQuery("j", sort_by="environment")):
        with pytest.raises(InvalidQueryError):
            bad.validate()
    for bad in (LogQuery("j", page=-1), LogQuery("j", size=0), LogQuery("j", size=1001)):
        with pytest.raises(InvalidQueryError):
            bad.validate_page()
    for by in ("timestamp", "lineNumber", "level", "logger", "thread", "indexedAt"):
        LogQuery("j", sort_by=by).validate()
    with pytest.raises(InvalidQueryError):
        ExportOptions(max_records=100_001)
    p = Pagination(2, 10, 25)
    assert (p.total_pages, p.has_next, p.has_previous, p.first_element, p.last_element) == (3, False, True, 20, 24) and Pagination(0, 10, 0).last_element == 0
    assert [interval(x) for x in ("1m", "1M", "5M", "1W", None, "2h")] == ["1m", "1M", "5m", "1w", "1h", "1h"]
    assert (progress(50, 100), progress(0, 0), per_second(10, 4), per_second(1, 0)) == (50, 5, 2500, 0)


def test_words_and_edits():
    assert query_words("at com.example.Foo user's 1,234.5") == ["at", "com.example.foo", "user's", "1,234.5"]
    assert [edits(w) for w in ("ab", "abcde", "abcdef")] == [0, 1, 2] and swaps("aab") == ["aba"]


def test_detection():
    r = Registry()
    for name, sample, want in [("app.json", "{}", "JSON"), ("data.JSON", "x", "JSON"), ("logs.ndjson", "{}", "JSON"), ("export.CSV", "timestamp,level,message", "CSV"), ("a.tsv", "timestamp\tlevel", "CSV"), ("app.log", "2024 x", "TEXT"), ("stderr.err", "y", "TEXT"), ("unknown.data", '{"a":1}', "JSON"), ("unknown.data", "a,b\n1,2", "CSV"), ("unknown.xyz", "free text", "TEXT"), ("app.log", "[2024-01-15 10:30:45] INFO x", "TEXT"), (None, None, "TEXT")]:
        assert r.detect(name, sample).format == want, (name, sample)
    assert r.formats() == ["JSON", "CSV", "TEXT"] and r.has("json") and set(r.info()) == {"JSON", "CSV", "TEXT"}
    r.register(Parser("CUSTOM", 100, lambda n, s: s == "mine", lambda lines, opts: lines))
    assert r.formats()[0] == "CUSTOM" and r.detect("x.y", "mine").format == "CUSTOM" and len(r.formats()) == 4
    assert r.unregister("JSON") and not r.unregister("JSON") and not r.has("JSON")
    with pytest.raises(InvalidFileTypeError):
        Registry([]).detect("a.log", "x")
    with pytest.raises(InvalidFileTypeError):
        upload_extension("a.exe")


def test_lines_of_split_files(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "a.log").write_text("\r\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_lines(spark, str(tmp_path / "a.log"))
        assert df.select("line").inputFiles() and spark.read.text(str(tmp_path / "a.log")).rdd.getNumPartitions() > 3
        got = [(r["line_number"], r["line"]) for r in df.orderBy("line_number").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i + 1, x) for i, x in enumerate(lines)]
    assert read_lines(spark, str(tmp_path / "a.log"), 4999).count() == 2


def test_no_line_is_shuffled_to_be_numbered(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\n" * 50)
    df = read_lines(spark, str(tmp_path / "a.log"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    above = plan[: plan.index("Scan text")]
    assert "Exchange hashpartitioning" not in above.split("BroadcastHashJoin", 1)[1].split("BroadcastQueryStage")[0]


CHARSETS = {"a": ("UTF-8", b""), "b": ("UTF-8", b"\xef\xbb\xbf"), "c": ("UTF-16BE", b"\xfe\xff"), "d": ("UTF-16LE", b"\xff\xfe")}


def test_charsets(spark, tmp_path):
    text = "é first\r\n\n\ufeffsecond \U0001f642\r\n" + "a long line " * 40 + "\n" + "\n".join(f"line {i}" for i in range(300)) + "\nlast Ā"
    for name, (charset, mark) in CHARSETS.items():
        (tmp_path / f"{name} x.log").write_bytes(mark + text.encode(charset))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scan = FileScan(spark, str(tmp_path))
        rows = scan.lines().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [x.removeprefix("\ufeff") for x in text.replace("\r\n", "\n").split("\n")]
    for name in CHARSETS:
        got = sorted((r["line_number"], r["line"].removeprefix("\ufeff")) for r in rows if r["file_name"].endswith(f"{name}%20x.log"))
        assert got == [(i + 1, x) for i, x in enumerate(want)], name
    assert (scan.line_count, scan.blank_count, scan.longest_file, scan.byte_count) == (4 * len(want), 4, len(want), sum(len(m + text.encode(c)) for c, m in CHARSETS.values()))
    (tmp_path / "named.log").write_bytes("é\nb".encode("utf-16-le"))
    assert [r["line"] for r in read_lines(spark, str(tmp_path / "named.log"), charset="UTF-16LE").orderBy("line_number").collect()] == ["é", "b"]
    (tmp_path / "torn.log").write_bytes(b"\xff\xfe" + "x\u0a05\u0100y\nz\nlast".encode("utf-16-le"))
    with pytest.raises(LogProcessingError):
        FileScan(spark, str(tmp_path / "torn.log"))


def test_charsets_give_the_same_entries(spark, tmp_path):
    e, found = LogEngine(spark, str(tmp_path / "store")), {}
    for name, (charset, mark) in CHARSETS.items():
        (tmp_path / f"{name}.log").write_bytes(mark + LINES.encode(charset))
        job = e.ingest(str(tmp_path / f"{name}.log"), options=ParseOptions(file_name="x", ingest_ts=datetime(2024, 6, 1)))
        assert (job.total_lines, job.successful_lines, job.skipped_lines, job.continuation_lines, job.bytes_read) == (6, 4, 1, 1, len(mark + LINES.encode(charset)))
        found[name] = sorted(map(repr, (r[2:] for r in e.entries(job.job_id).select("id", "job_id", *[c for c in e.entries(job.job_id).columns if c not in ("id", "job_id")]).collect())))
    assert found["a"] == found["b"] == found["c"] == found["d"] and len(found["a"]) == 4


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("engine")
    (folder / "shop.log").write_text(LINES)
    e = LogEngine(spark, str(folder / "store"))
    e.file = str(folder / "shop.log")
    e.job = e.ingest(e.file, options=ParseOptions(ingest_ts=datetime(2024, 6, 1)))
    return e


def test_job(engine):
    job = engine.job_status(engine.job.job_id)
    assert (job.status, job.progress, job.total_lines, job.successful_lines, job.failed_lines, job.file_name) == ("COMPLETED", 100, 6, 4, 0, "shop.log")
    assert {r["name"]: r["count"] for r in engine.job_result(job.job_id).collect()} == {"total": 4, "errors": 1, "ERROR": 1, "WARN": 1, "INFO": 2}
    assert engine.jobs.by_status("COMPLETED").count() == 1 and engine.jobs.recent().count() == 1
    assert (job.skipped_lines, job.continuation_lines, job.bytes_read, job.saved_entries, job.total_entries, job.failed_entries, job.batches, job.start_line, job.end_line) == (1, 1, len(LINES), 4, 4, 0, 1, 1, 6)
    assert (round(job.success_rate, 3), job.error_count, job.inferred_timestamps, job.split_traces, job.level_counts) == (66.667, 1, 0, 0, {"ERROR": 1, "WARN": 1, "INFO": 2})
    assert job.bytes_per_second > job.lines_per_second > 0 and job.average_save_ms > 0
    with pytest.raises(JobNotFoundError):
        engine.entries("nothing")
    with pytest.raises(LogProcessingError):
        engine.ingest(engine.file, job_id=job.job_id)
    with pytest.raises(FileTooLargeError):
        LogEngine(engine.spark, engine.store, max_file_size=10).ingest(engine.file)


def test_lines_before_the_start(engine, spark, tmp_path):
    job = engine.ingest(engine.file, start_line=4, options=ParseOptions(ingest_ts=datetime(2024, 6, 1)))
    assert (job.total_lines, job.successful_lines, job.skipped_lines, job.start_line, job.end_line) == (3, 2, 1, 4, 6)
    assert sorted(r["line_number"] for r in engine.entries(job.job_id).collect()) == [4, 6]
    with pytest.raises(InvalidQueryError):
        engine.ingest(engine.file, start_line=0)


def test_custom_parsers(spark, tmp_path):
    """One that tells a status for each line, and one that gives entries alone, two for a line."""

    def read(lines, opts):
        good = F.col("line").contains("=")
        status = F.when(good, "SUCCESS").when(F.col("line") == "", "SKIPPED").otherwise("FAILED")
        message = F.when(good, F.split("line", "=")[1])
        return finish(lines.withColumns({"parse_status": status, "error_message": F.when(status == "FAILED", "no ="), "lines": F.lit(1).cast("long"), "parts": F.lit(1).cast("long"), "message": message, "_stamp": F.lit(None).cast("timestamp_ntz")}), opts)

    def parse(lines, opts):
        twice = lines.where(F.col("line").contains("=")).select("*", F.explode(F.split("line", "=")).alias("message"))
        return conform(twice.withColumn("id", F.sha2(F.concat_ws("|", F.lit(opts.job_id), "line_number", "message"), 256)).withColumn("job_id", F.lit(opts.job_id)))

    (tmp_path / "a.log").write_text("a=1\nbroken\n\nb=2\nbroken too\nc=3\n")
    registry = Registry([Parser("STATUS", 1, lambda n, s: False, None, read=read), Parser("ENTRIES", 2, lambda n, s: True, parse)])
    e = LogEngine(spark, str(tmp_path / "store"), registry)
    job = e.ingest(str(tmp_path / "a.log"), kind="status")
    assert (job.total_lines, job.successful_lines, job.failed_lines, job.skipped_lines, job.continuation_lines, job.success_rate) == (6, 3, 2, 1, 0, 50.0)
    assert sorted(r["message"] for r in e.entries(job.job_id).collect()) == ["1", "2", "3"]
    job = e.ingest(str(tmp_path / "a.log"))
    assert (job.total_lines, job.successful_lines, job.failed_lines, job.skipped_lines, job.saved_entries) == (6, 3, 2, 1, 6)
    with pytest.raises(LogProcessingError):
        e.ingest(str(tmp_path / "a.log"), kind="nothing")


def test_progress_of_a_running_job(spark, tmp_path):
    """Some forty slow tasks, one after the other on few cores."""
    import time

    def slow(batches):
        for b in batches:
            time.sleep(0.4)
            yield b

    def read(lines, opts):
        shape = lines.repartition(40).mapInArrow(slow, lines.schema)
        return finish(shape.withColumns({"parse_status": F.lit("SUCCESS"), "error_message": F.lit(None).cast("string"), "lines": F.lit(1).cast("long"), "parts": F.lit(1).cast("long"), "message": F.col("line"), "_stamp": F.lit(None).cast("timestamp_ntz")}), opts)

    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(400)))
    e = LogEngine(spark, str(tmp_path / "store"), Registry([Parser("SLOW", 1, lambda n, s: True, None, read=read)]))
    job = e.ingest(str(tmp_path / "a.log"), look_every=0.2)
    saved = [r["progress"] for r in spark.read.parquet(f"{e.store}/jobs").where(F.col("job_id") == job.job_id).orderBy("updated_at").collect()]
    assert saved[0] == 5 and saved[-1] == 100 and any(5 < p < 95 for p in saved) and saved == sorted(saved)
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_long_traces_come_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("logloom.operators.multiline.BLOCK_LINES", 1000)
    lines = ["2024-01-15 10:30:45.123 [main] INFO com.shop.Cart - paid"] * 998 + ["java.lang.IllegalStateException: stuck", "\tat a.b(C.java:1)", "more of it"] + ["2024-01-15 10:30:45.123 [main] INFO com.shop.Cart - paid"]
    lines += ["java.lang.OutOfMemoryError: everything"] + [f"line {i} of a very long trace" for i in range(20_000)]
    (tmp_path / "a.log").write_text("\n".join(lines))
    e = LogEngine(spark, str(tmp_path / "store"))
    job = e.ingest(str(tmp_path / "a.log"))
    assert (job.total_lines, job.successful_lines, job.continuation_lines, job.split_traces) == (len(lines), 1001, 20_002, 1)
    rows = e.trace(job.job_id, 1003).collect()
    assert "\n".join(r["text"] for r in rows) == "\n".join(lines[1002:]) and len(rows) == 20 and max(len(r["text"].split("\n")) for r in rows) == PART_LINES
    assert [r["text"] for r in e.trace(job.job_id, 999).collect()] == ["\n".join(lines[998:1001])], "a short trace over the border of two blocks is whole"


def test_rollups_and_cursors(engine):
    j = engine.job.job_id
    exact, rolled = engine.summary(j).first().asDict(), engine.summary_of([j]).first().asDict()
    assert {k: exact[k] for k in rolled} == rolled
    assert engine.summary_of([j], "2024-01-16").first()["total_entries"] == 0
    for q in (LogQuery(j, sort_by="thread", size=1), LogQuery(j, sort_by="timestamp", sort_direction="asc", size=2), LogQuery(j, sort_by="hostname", size=3)):
        seen, cursor = [], None
        while True:
            page, cursor = engine.search_after(q, cursor)
            seen += [r["line_number"] for r in page.collect()]
            if cursor is None:
                break
        assert seen == [r["line_number"] for r in engine.search(replace(q, size=100)).entries.collect()]
    page, _ = engine.search_after(LogQuery(j, size=2), Cursor(datetime(2024, 1, 15, 10, 40), 4, "x"))
    plan = page._jdf.queryExecution().toString()
    assert "Offset" not in plan and "TakeOrderedAndProject" in plan and "PushedFilters" in plan


def test_cursors_with_nulls_and_ties(spark):
    rows = [(f"i{i:02d}" if i % 11 else None, i % 4 if i % 13 else None, None if i % 5 == 0 else "abc"[i % 3]) for i in range(60)]
    df = conform(spark.createDataFrame(rows, "id string, line_number long, thread string"))
    for direction in ("asc", "desc"):
        q, cursor, seen = LogQuery("j", sort_by="thread", sort_direction=direction, size=7), None, []
        while True:
            page = page_after(df, q, cursor)
            seen += [(r["id"], r["line_number"], r["thread"]) for r in page.collect()]
            cursor = cursor_of(page, q)
            if cursor is None:
                break
        want = [(r["id"], r["line_number"], r["thread"]) for r in sort_entries(df, q).collect()]
        assert len({x for x in seen}) == len({x for x in want}) and [x[2] for x in seen] == [x[2] for x in want]


def test_heavy_values(spark):
    values = ["common"] * 4000 + ["second"] * 2500 + [f"v{i}" for i in range(6000)] + [None] * 10
    df = conform(spark.createDataFrame([(v, f"t{i % 3000}") for i, v in enumerate(values)], "logger string, thread string").repartition(6))
    for limit, tracked in ((2, 64), (3, 64), (10, 10_000)):
        got = heavy_values(df, ("logger", "thread"), limit, tracked, candidates=16).collect()
        for f in ("logger", "thread"):
            want = [(r["value"], r["count"]) for r in top_values(df, f, limit).collect()]
            assert sorted((r["value"], r["count"]) for r in got if r["field"] == f) == sorted(want), (limit, tracked, f)
    assert heavy_values(df.limit(0), ("logger",)).count() == 0


def test_search_and_pages(engine):
    j = engine.job.job_id
    r = engine.search(LogQuery(j, search_text="tiemoutexception", highlight=True, size=10), posted=True)
    assert r.pagination.total == 1 and r.entries.first()["has_stack_trace"] and r.summary.first()["total_entries"] == 1
    marks = r.highlights.first()["highlights"]
    assert marks["message"] == ['<em class="highlight">TimeoutException</em> while paying'] and "raw_line" in marks
    assert engine.search(LogQuery(j, search_text="cart.java paying")).pagination.total == 0  # not in one field
    page = engine.search(LogQuery(j, sort_by="lineNumber", sort_direction="asc", page=1, size=3, include_fields=("lineNumber",), include_summary=False))
    assert [tuple(x) for x in page.entries.collect()] == [(6,)] and page.pagination.has_previous and page.summary is None
    assert engine.count(LogQuery(j, logger="com.shop.*", thread="w-?")) == 3
    assert [x["line_number"] for x in engine.context(j, 3, 2, 1).collect()] == [1, 3, 4]
    with pytest.raises(InvalidQueryError):
        engine.facet(j, "message")


def test_aggregations(engine):
    j = engine.job.job_id
    s = engine.summary(j).first()
    assert (s["total_entries"], s["error_count"], s["warning_count"], s["stack_trace_count"], s["unique_loggers"], s["time_span_seconds"]) == (4, 1, 1, 1, 2, 5354)
    assert approximate_summary(engine.entries(j)).first()["unique_loggers"] == 2
    assert [(r["value"], r["count"]) for r in engine.facet(j, "logger").collect()] == [("com.shop.Cart", 2), ("com.shop.Stock", 2)]
    assert [(r["bucket_start"].hour, r["count"], r["error_count"]) for r in engine.timeline(j).orderBy("bucket_start").collect()] == [(10, 3, 1), (11, 0, 0), (12, 1, 0)]
    assert engine.timeline(j, "1s").count() == 5356 and engine.timeline_levels(j, "1d").count() == 3
    assert timeline(engine.entries(j).limit(0)).count() == 0
    assert {r["field"] for r in engine.fields(j).collect()} == {"level", "logger", "thread", "source"}
    assert engine.errors_per_logger(j).first()["count"] == 1 and engine.top_error_messages(j).count() == 1 and engine.levels(j).count() == 3


def test_exports(engine, tmp_path):
    q = LogQuery(engine.job.job_id, sort_by="line_number", sort_direction="asc")
    text = "".join(engine.export(q, ExportOptions(fields=("lineNumber", "message", "hostname", "nothing"))))
    assert text.splitlines()[0] == '"lineNumber","message","hostname","nothing"' and text.splitlines()[-1] == '"6","paid, ""quoted""","",""'
    rows = json.loads("".join(engine.export(q, ExportOptions("json"))))
    assert len(rows) == 4 and rows[0]["line_number"] == 1 and rows[0]["timestamp"] == "2024-01-15T10:30:45.123"
    lines = "".join(engine.export(q, ExportOptions("ndjson", max_records=2))).splitlines()
    assert [json.loads(x)["line_number"] for x in lines] == [1, 3]
    engine.write_export(q, str(tmp_path / "csv"), ExportOptions(fields=("level", "hostname")))
    written = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("*.csv")))
    assert written.splitlines()[:2] == ['"level","hostname"', '"ERROR",""']
    engine.write_export(q, str(tmp_path / "nd"), ExportOptions("ndjson"))
    assert engine.spark.read.json(str(tmp_path / "nd")).count() == 4


def test_partitions_are_pruned(engine):
    plan = engine.entries(engine.job.job_id)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "job_id" in plan.split("PartitionFilters")[1][:120]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_text('{"ts":"2024-01-15T10:30:45","level":"info","msg":"x"}\n{"ts":"2024-01-15T10:31:00","level":"error","msg":"y"}\nbad\n')
    s = stream_json(spark, str(tmp_path / "in"), ParseOptions(job_id="s"))
    q = append_to(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    t = stream_timeline(stream_json(spark, str(tmp_path / "in"), ParseOptions())).writeStream.format("memory").queryName("buckets").outputMode("complete").trigger(availableNow=True).start()
    t.awaitTermination(120)
    assert spark.table("buckets").count() == 2
