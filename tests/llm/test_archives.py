import hashlib
import zlib

import pytest

from logloom.llm.archives import archive_faults, page_of_id, record_id, warc_date, arc_head, arc_record, arc_to_warc, arc_version, archive_files, archive_pages, member, members, parse_arc_record, parse_warc_record, read_warc, write_arc

PAGES = "page_id long, url string, html string, digest string, payload_bytes string, first_page string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], PAGES)


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines_follow_the_version(version):
    assert arc_version(arc_head(version, "x.arc.gz", "20240101000000")) == version
    body = b"HTTP/1.1 404 Not Found\r\nA: b\r\n\r\n\nfive\n"
    r = parse_arc_record(version, b"\n" + arc_record(version, "http://a/b", "20240102030405", body, status=404))
    assert (r.url, r.date, r.status, r.body) == ("http://a/b", "20240102030405", 404, body)
    with pytest.raises(ValueError, match="shorter"):
        parse_arc_record(version, arc_record(version, "http://a/b", "20240102030405", body)[:-10])


def test_members_of_any_size():
    parts = [b"", b"x" * 100_000, bytes(range(256)) * 700]
    assert [c for _, _, c in members(b"".join(map(member, parts)))] == parts
    with pytest.raises(ValueError, match="cut short"):
        list(members(member(b"abc")[:-3]))


def test_round_trip_and_revisits(spark):
    big = "é" * 60
    rows = [(3, "http://a/ b\n", big), (1, None, big), (2, "u", "tiny"), (4, "u", "tiny"), (5, "u", None), (6, "", ""), (None, "u", big), (7, "u", "z" * 3_000_000), (1, None, big)]
    out = sorted(archive_pages(pages(spark, rows)).collect(), key=str)
    assert len(out) == len(rows)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out)
    assert kinds == sorted([("3", "revisit", 1, 120), ("1", "response", None, 120), ("1", "response", None, 120), ("None", "revisit", 1, 120), ("2", "response", None, 4), ("4", "response", None, 4), ("5", "response", None, 0), ("6", "response", None, 0), ("7", "response", None, 3_000_000)])
    assert archive_pages(pages(spark, [])).count() == 0


def test_files_and_headers(spark, tmp_path):
    arc = write_arc(pages(spark, [(1, "http://a/b c", "<p>x</p>")])).collect()
    (tmp_path / arc[0]["name"]).write_bytes(arc[0]["data"])
    warc = arc_to_warc(archive_files(spark, str(tmp_path))).collect()
    fields, block = parse_warc_record(zlib.decompress(warc[0]["data"], 31))
    assert fields["warc-target-uri"] == "http://a/b%20c" and fields["warc-date"] == "2024-01-01T00:00:00Z" and fields["warc-record-id"].startswith("<urn:uuid:")
    assert block.endswith(b"<p>x</p>")
    assert read_warc(spark.createDataFrame(warc)).first()["html"] == "<p>x</p>"


@pytest.mark.parametrize("version", [1, 2])
def test_archives_of_other_writers(spark, version):
    """Plain, in one gzip member, and in a member for each record; a WARC with other types of records."""
    bodies = [b"HTTP/1.1 200 OK\r\nX-Odd: \xff\r\n\r\n" + c * n for c, n in ((b"a", 5), (b"\n", 200), (b"\xff", 120), (b"\xff", 120))]
    parts = [arc_head(version, "x.arc", "20240101000000"), *(arc_record(version, f"http://a/{k}", "20240102", b) for k, b in enumerate(bodies))]
    for data in (b"".join(parts), member(b"".join(parts)), b"".join(map(member, parts))):
        out = read_warc(arc_to_warc(spark.createDataFrame([("x", bytearray(data))], "name string, data binary"))).collect()
        assert sorted((r["url"], r["payload_bytes"]) for r in out) == [("http://a/0", 5), ("http://a/1", 200), ("http://a/2", 120), ("http://a/3", 120)]
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    other += b"WARC/1.0\r\nWARC-Type:response\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhiya\r\n\r\n"
    for data in (other, member(other)):
        (r,) = read_warc(spark.createDataFrame([("x", bytearray(data))], "name string, data binary")).collect()
        assert (r["url"], r["html"], r["payload_bytes"], r["payload_digest"]) == ("u", "hiya", 4, hashlib.sha256(b"hiya").hexdigest())


def test_bodies_that_are_no_http_and_heads_of_bare_line_feeds(spark):
    records = [
        ("dns:shop.test", b"20240102030405\nshop.test.\t60\tIN\tA\t10.0.0.1\n", "text/dns"),
        ("ftp://shop.test/a.txt", b"x" * 220, "text/plain"),
        ("http://a/lf", b"HTTP/1.0 200 OK\nX-Page-Id: 7\n\nlf body\r\n\r\nmore", "text/html"),
        ("http://a/mixed", b"HTTP/1.1 200 OK\r\nA: b\n\r\nmixed", "text/html"),
        ("http://a/none", b"HTTP/1.1 304 Not Modified\r\n", "text/html"),
        ("http://a/", b"", "text/html"),
    ]
    for version in (1, 2):
        data = arc_head(version, "x.arc", "2024") + b"".join(arc_record(version, u, "2005", body, kind=kind) for u, body, kind in records)
        warc = arc_to_warc(spark.createDataFrame([("x", bytearray(data))], "name string, data binary")).collect()
        rows = {r["url"]: r for r in read_warc(spark.createDataFrame(warc)).collect()}
        assert {u: (r["record_type"], r["html"]) for u, r in rows.items()} == {
            "dns:shop.test": ("resource", records[0][1].decode()), "ftp://shop.test/a.txt": ("resource", "x" * 220), "http://a/lf": ("response", "lf body\r\n\r\nmore"),
            "http://a/mixed": ("response", "mixed"), "http://a/none": ("response", ""), "http://a/": ("resource", "")}
        assert rows["http://a/lf"]["page_id"] == 7 and {r["date"] for r in rows.values()} == {"2005-01-01T00:00:00Z"}
        assert all(r["payload_digest"] == hashlib.sha256(r["html"].encode()).hexdigest() for r in rows.values())
        fields, _ = parse_warc_record(zlib.decompress(warc[0]["data"], 31))
        assert fields["content-type"] == "text/dns"


def test_broken_records_are_told_with_their_archive(spark):
    good = [arc_record(1, f"http://a/{k}", "20240102", b"HTTP/1.1 200 OK\r\n\r\n" + b"z" * 150) for k in range(3)]
    head = arc_head(1, "x.arc", "20240101000000")
    bad = b"http://a/bad 0.0.0.0 20240102 text/html many\nbody\n"
    short = good[1].replace(b" 169\n", b" 9169\n")
    rows = [
        ("plain", head + good[0] + bad + good[1]),
        ("members", b"".join(map(member, (head, good[0], bad, good[1], short, good[2]))) + b"\0" * 40),
        ("torn", member(head) + member(good[0]) + member(good[1])[:-9]),
        ("whole", head + b"".join(good)),
    ]
    archives = spark.createDataFrame([(n, bytearray(d)) for n, d in rows], "name string, data binary")
    faults = sorted((r["name"], r["fault"]) for r in archive_faults(archives).collect())
    assert faults == [("members", "an ARC record is shorter than its declared length"), ("members", "an ARC record's header line has no length"), ("plain", "an ARC record's header line has no length"), ("torn", "an archive member is cut short")]
    warc = arc_to_warc(archives)
    assert sorted(r["url"] for r in read_warc(warc).collect()) == sorted([f"http://a/{k}" for k in (0, 0, 1, 2, 0, 0, 1, 2)])
    assert archive_faults(warc, "warc").count() == 0
    assert archive_faults(spark.createDataFrame([("w", bytearray(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nx"))], "name string, data binary"), "warc").count() == 1


def test_ids_tell_their_page():
    digest = hashlib.sha256(b"x").digest()
    for page in (0, 1, -1, 2**63 - 1, -(2**63), 12345678901):
        assert page_of_id(record_id(page, digest)) == page
    assert page_of_id(record_id(None, digest)) is None and page_of_id("<urn:uuid:6ba7b811-9dad-11d1-80b4-00c04fd430c8>") is None and page_of_id(None) is None and page_of_id("x") is None
    assert len({record_id(p, hashlib.sha256(bytes([d])).digest()) for p in range(50) for d in range(50)}) == 2500
    assert [warc_date(d) for d in ("2005", "200503", "20050314", "20050314151617", "20051399", "x", "")] == ["2005-01-01T00:00:00Z", "2005-03-01T00:00:00Z", "2005-03-14T00:00:00Z", "2005-03-14T15:16:17Z", "1970-01-01T00:00:00Z", "1970-01-01T00:00:00Z", "1970-01-01T00:00:00Z"]


def test_many_repeated_payloads_are_looked_up_by_archive(spark):
    rows = [(i, f"http://a/{i}", f"payload {i % 7} " * 20) for i in range(60)] + [(100 + i, "u", "hot " * 50) for i in range(80)]
    arc = write_arc(pages(spark, rows).repartition(5))
    arc = spark.createDataFrame([(f"{k}-{r['name']}", r["data"]) for k, r in enumerate(arc.collect())], "name string, data binary")
    both = [sorted(map(str, read_warc(arc_to_warc(arc, broadcast_repeats=most)).select("page_id", "payload_digest", "record_type", "refers_to").collect())) for most in (0, 1000)]
    assert both[0] == both[1] and sum("revisit" in r for r in both[0]) == 140 - 8
