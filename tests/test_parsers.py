"""Lines and what the parsers make of them."""

from datetime import datetime
from itertools import product

import pytest
from pyspark.sql import functions as F

from logloom.functions.metadata import as_metadata, line_entries
from logloom.operators.csvlog import csv_status, delimiter_of, is_header, layout, parse_csv
from logloom.operators.jsonlog import json_status, parse_json
from logloom.operators.multiline import assign_heads, attach_traces
from logloom.operators.textlog import line_status, match_lines, parse_text
from logloom.options import ParseOptions
from logloom.schema import LOG_ENTRY_SCHEMA

OPTS = ParseOptions(job_id="job-7", file_name="till.log", ingest_ts=datetime(2024, 6, 1), default_year=2024)
AT = datetime(2024, 1, 15, 10, 30, 45)


@pytest.fixture(scope="module")
def read(spark):
    def make(parse, lines, opts=OPTS):
        df = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(lines)], "file_name string, line_number long, line string")
        return [r.asDict() for r in parse(df, opts).orderBy("line_number").collect()]

    return make


def test_text_lines(read):
    lines = [
        "2024-01-15 10:30:45.123 [main] ERROR org.till.Drawer - drawer is stuck",
        "2024-01-15 10:30:45,123 [pool-3-thread-9] INFO org.till.Stock - shelf counted",
        "2024-01-15 10:30:45.123  INFO 4041 --- [main] o.t.Opening : shop is open",
        '172.20.5.9 - mira [15/Jan/2024:10:30:45 +0000] "GET /shelf/7 HTTP/1.1" 200 1234 "https://shop.test" "reader/2"',
        '172.20.5.9 - - [15/Jan/2024:10:30:45 +0000] "POST /order HTTP/1.1" 500 0',
        "Jan 15 10:30:45 depot4 scand[771]: parcel from 172.20.5.1",
        "2024-01-15 10:30:45.123 [main] INFO - shelf counted cartId=123 step=pay",
        "2024-01-15 10:30:45.123 [main] INFO com.x - reading https://stock.test/list",
        "2024-01-15 10:30:45.123 [main] INFO com.x - took request_id=r-77-x",
        "A" * 10_000,
        "nothing here looks like a record",
        "2024-01-15T10:30:45.5Z Information x",
        "A fatal error happened",
        "2024-01-15T10:30:45+05:00 fine weather",
    ]
    r = read(parse_text, lines)
    assert [x["line_number"] for x in r] == list(range(1, 15)) and all(x["job_id"] == "job-7" and x["file_name"] == "till.log" for x in r)
    assert (r[0]["level"], r[0]["logger"], r[0]["thread"], r[0]["message"], r[0]["has_error"], r[0]["source"], r[0]["timestamp"]) == ("ERROR", "org.till.Drawer", "main", "drawer is stuck", True, "Drawer", AT.replace(microsecond=123000))
    assert (r[1]["level"], r[1]["thread"], r[1]["has_error"]) == ("INFO", "pool-3-thread-9", False)
    assert (r[2]["level"], r[2]["thread"], r[2]["message"]) == ("INFO", "main", "shop is open")
    assert (r[3]["level"], r[3]["has_error"], r[3]["message"], r[3]["metadata"]["client_ip"], r[3]["metadata"]["http_status"], r[3]["metadata"]["user"]) == ("INFO", None, "GET /shelf/7 HTTP/1.1 200", "172.20.5.9", "200", "mira")
    assert (r[4]["level"], r[4]["has_error"], r[4]["timestamp"]) == ("ERROR", True, AT) and "user" not in r[4]["metadata"]
    assert (r[5]["hostname"], r[5]["logger"], r[5]["metadata"]["pid"], r[5]["timestamp"], r[5]["timestamp_inferred"]) == ("depot4", "scand", "771", AT, False)
    assert r[6]["message"].startswith("- ") and (r[6]["metadata"]["cartId"], r[6]["metadata"]["step"], r[6]["logger"]) == ("123", "pay", None)
    assert r[7]["metadata"]["url"] == "https://stock.test/list" and r[8]["metadata"]["request_id"] == "r-77-x"
    assert r[5]["metadata"]["ip_address"] == "172.20.5.1"
    assert (r[10]["message"], r[10]["level"], r[10]["timestamp"], r[10]["timestamp_inferred"], r[10]["has_error"]) == (lines[10], "INFO", OPTS.ingest_ts, True, None)
    assert (r[11]["level"], r[11]["message"], r[11]["timestamp"]) == ("INFO", "rmation x", AT.replace(microsecond=500000))
    assert (r[12]["level"], r[12]["message"]) == ("ERROR", "happened")
    assert (r[13]["level"], r[13]["message"], r[13]["timestamp"]) == ("INFO", "fine weather", AT)


def test_user_format_blank_and_long_lines(read):
    assert read(parse_text, ["[15/01/2024 10:30:45] INFO test message"], ParseOptions(timestamp_format="dd/MM/yyyy HH:mm:ss"))[0]["timestamp"] == AT
    assert not read(parse_text, ["[15/01/2024 10:30:45] INFO x"], ParseOptions(timestamp_format="not a {pattern"))[0]["timestamp"] == AT
    assert read(parse_text, [None, "", "   "]) == []
    assert len(read(parse_text, ["é" * 200_000])[0]["message"]) == 100_000
    assert read(parse_text, []) == []


def test_stack_traces(read):
    lines = ["2024-01-15 10:30:45.123 [main] ERROR a.B - NullPointerException", "\tat org.till.Drawer.open(Drawer.java:8)", "Caused by: java.io.IOException: x", "java.lang.NullPointerException: no drawer", "loose", "", "Caused by: alone", "2024-01-15 10:30:46 INFO fine", "loose again"]
    r = read(parse_text, lines)
    assert [(x["line_number"], x["stack_trace"], x["has_stack_trace"], x["level"]) for x in r] == [(1, lines[1] + "\n" + lines[2], True, "ERROR"), (4, lines[3] + "\nloose", True, "ERROR"), (7, lines[6], True, "INFO"), (8, None, None, "INFO"), (9, None, None, "INFO")]
    status = read(lambda df, o: line_status(assign_heads(match_lines(df, o))), lines)
    assert [x["parse_status"] for x in status] == ["BUFFERED", "CONTINUATION", "CONTINUATION", "BUFFERED", "CONTINUATION", "SKIPPED", "SUCCESS", "SUCCESS", "SUCCESS"]


@pytest.mark.parametrize("block", [2, 100_000])
def test_assembly_equals_a_state_machine(spark, monkeypatch, block):
    """All sequences of five line classes, each a file of its own."""
    monkeypatch.setattr("logloom.operators.multiline.BLOCK_LINES", block)
    files = {"".join(s): s for s in product("BSEIMU", repeat=4)}
    rows = [(name, i + 1, f"{c}{i}", c) for name, s in files.items() for i, c in enumerate(s)]
    df = spark.createDataFrame(rows, "file_name string, line_number long, line string, class string")
    got = {}
    for r in attach_traces(assign_heads(df)).collect():
        got.setdefault(r["file_name"], []).append((r["line_number"], r["stack_trace"]))
    for name, s in files.items():
        want, pending = [], None
        for i, c in enumerate(s):
            line = f"{c}{i}"
            if c in "SU" and pending is not None:
                pending[1].append(line)
            elif c == "B":
                pending = None
            else:
                entry = (i + 1, [line] if c in "SE" else [])
                want.append(entry)
                pending = entry if c in "EI" else pending if c in "SU" else None
        assert sorted(got.get(name, [])) == [(n, "\n".join(t) or None) for n, t in want]


def test_json(read):
    lines = [
        '{"timestamp":"2024-01-15T10:30:45.123","level":"info","message":"shop is open"}',
        '{"@timestamp":"2024-01-15T10:30:45.123Z","level":"CRITICAL","message":"no link","host":"depot1"}',
        '{"name":"till.front","hostname":"depot1","pid":771,"level":30,"msg":"shelf counted","time":"2024-01-15T10:30:45.123Z"}',
        '{"timestamp":1705315845777,"message":"till counted"}',
        '{"level":"error","logger":"org.till.Drawer","thread":"main","stack_trace":"x\\ny","application":"a","environment":"e","service":"s","cartId":123,"context":{"a":[1]},"tags":["t1","t2"],"Level":"kept","none":null}',
        '[{"message":"one"},{"message":"two"}]',
        '{"exception":"boom","timestamp":"2024-01-15 10:30:45"}',
    ]
    r = read(parse_json, lines)
    assert (r[0]["level"], r[0]["message"], r[0]["timestamp"], r[0]["has_error"]) == ("INFO", "shop is open", AT.replace(microsecond=123000), False)
    assert (r[1]["level"], r[1]["hostname"], r[1]["has_error"]) == ("ERROR", "depot1", True)
    assert (r[2]["level"], r[2]["logger"], r[2]["source"], r[2]["metadata"]) == ("30", "till.front", "front", {"pid": "771"})
    assert r[3]["timestamp"] == datetime(2024, 1, 15, 10, 50, 45, 777000) and r[3]["level"] is None and r[3]["has_error"] is None
    assert (r[4]["source"], r[4]["thread"], r[4]["stack_trace"], r[4]["has_stack_trace"], r[4]["application"], r[4]["tags"]) == ("Drawer", "main", "x\ny", True, "a", ["t1", "t2"])
    assert r[4]["metadata"] == {"cartId": "123", "context": '{"a":[1]}', "Level": "kept"}
    assert r[5]["message"] is None and r[5]["raw_line"] == lines[5]
    assert (r[6]["has_error"], r[6]["level"], r[6]["timestamp"]) == (True, None, AT)
    status = read(lambda df, o: json_status(df), ['{"level":"INFO","message":', "This is not JSON", "{bad}", "", None, "{}"])
    assert [(x["parse_status"], x["error_message"]) for x in status] == [("FAILED", "Not valid JSON"), ("FAILED", "Not valid JSON"), ("FAILED", "JSON parse error"), ("SKIPPED", None), ("SKIPPED", None), ("SUCCESS", None)]


@pytest.mark.parametrize("sep", [",", "\t", ";", "|"])
def test_csv_delimiters_and_fields(read, sep):
    lines = [sep.join(x) for x in (["Timestamp", "severity", "msg", "component", "extra", "traceback"], ["1705314645", "warning", f'"a{sep} ""b"""', "c.D", "7", ""], ["2024-01-15T10:30:45Z", "", "m", "", "", "t"], ["", "emergency"])]
    r = read(parse_csv, lines)
    assert [x["line_number"] for x in r] == [2, 3, 4]
    assert (r[0]["timestamp"], r[0]["level"], r[0]["message"], r[0]["logger"], r[0]["source"], r[0]["metadata"], r[0]["has_error"]) == (AT, "WARN", f'a{sep} "b"', "c.D", None, {"extra": "7"}, False)
    assert (r[1]["level"], r[1]["stack_trace"], r[1]["has_stack_trace"], r[1]["timestamp"], r[1]["metadata"]) == ("INFO", "t", True, AT, None)
    assert (r[2]["level"], r[2]["timestamp_inferred"]) == ("ERROR", True)


def test_csv_without_header_and_failures(read):
    r = read(parse_csv, ["1705314645123,dbg,hello,9"])
    assert (r[0]["timestamp"], r[0]["level"], r[0]["message"], r[0]["metadata"]) == (AT.replace(microsecond=123000), "DEBUG", "hello", {"column_3": "9"})
    r = read(parse_csv, ["time,user,load", "15/01/2024 10:30:45,ann,0.5"])
    assert (r[0]["message"], r[0]["timestamp"]) == ("ann 0.5", AT)
    status = read(csv_status, ["ts,level", 'x,"open', "", "1,INFO"])
    assert [x["parse_status"] for x in status] == ["SKIPPED", "FAILED", "SKIPPED", "SUCCESS"]
    assert read(parse_csv, []) == []
    own = ParseOptions(csv_header="false", column_mapping={"column_1": "hostname"})
    assert read(parse_csv, ["a,b,c"], own)[0]["hostname"] == "b"


def test_csv_layout():
    assert delimiter_of('a,"b;;;;",c') == "," and delimiter_of("plain") == "," and delimiter_of("a\tb,c") == "\t"
    assert is_header(["when", "who"]) and not is_header(["when", "5"]) and is_header(["5", "level"])
    assert layout("date,ts,msg", ParseOptions())[2] == {"timestamp": 1, "message": 2}


def test_schema_is_the_same_for_all(spark):
    df = spark.createDataFrame([("f", 1, '{"a":1}')], "file_name string, line_number long, line string")
    for parse in (parse_text, parse_json, parse_csv):
        assert [(f.name, f.dataType) for f in parse(df, OPTS).schema] == [(f.name, f.dataType) for f in LOG_ENTRY_SCHEMA]


def test_each_csv_file_has_its_own_layout(spark):
    files = {"a": ["timestamp,level,message", "2024-01-15 10:30:45,WARN,low stock"], "b": ["message;level;timestamp;shelf", "late;ERROR;2024-01-15 10:30:45;7"], "c": ["2024-01-15 10:30:45\tINFO\tno header\t5"], "d": ["", " "]}
    df = spark.createDataFrame([(f, i + 1, x) for f, lines in files.items() for i, x in enumerate(lines)], "file_name string, line_number long, line string")
    r = {x["file_name"]: x for x in parse_csv(df, ParseOptions(job_id="j")).collect()}
    assert {f: (x["line_number"], x["timestamp"], x["level"], x["message"], x["metadata"]) for f, x in r.items()} == {
        "a": (2, AT, "WARN", "low stock", None),
        "b": (2, AT, "ERROR", "late", {"shelf": "7"}),
        "c": (1, AT, "INFO", "no header", {"column_3": "5"}),
    }
    status = sorted((x["file_name"], x["line_number"], x["parse_status"]) for x in csv_status(df, ParseOptions()).collect())
    assert status == [("a", 1, "SKIPPED"), ("a", 2, "SUCCESS"), ("b", 1, "SKIPPED"), ("b", 2, "SUCCESS"), ("c", 1, "SUCCESS"), ("d", 1, "SKIPPED"), ("d", 2, "SKIPPED")]


def test_lines_are_parsed_once(spark, tmp_path):
    spark.createDataFrame([("f", 1, "x")], "file_name string, line_number long, line string").write.parquet(str(tmp_path / "lines"))
    entries = parse_text(spark.read.parquet(str(tmp_path / "lines")), OPTS)
    entries.collect()
    assert "ReusedExchange" in entries._jdf.queryExecution().executedPlan().toString()


def test_a_line_of_many_pairs(spark):
    """Of equal keys the last counts, and the work doesn't grow with the square of the pairs."""
    said = [(f"k{i * 7 % 15_000}", str(i)) for i in range(30_000)]
    lines = [(1, " ".join(f"{k}={v}" for k, v in said)), (2, "a=1 b='x y' a=2"), (3, "nothing"), (4, "a="), (5, None)]
    found = spark.createDataFrame(lines, "n int, line string").select("n", line_entries(F.col("line"), []).alias("e")).select("n", as_metadata(F.col("e")).alias("m"))
    assert {r["n"]: r["m"] for r in found.collect()} == {1: dict(said), 2: {"a": "2", "b": "x y"}, 3: None, 4: None, 5: None}
