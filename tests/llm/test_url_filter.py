import pytest
from pyspark.sql import functions as F

from logloom.llm.url_filter import Rule, filter_urls, host_edges, propagate

PAGES = "page_id long, url string, html string"


def verdicts(spark, rows, **more):
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("clash") for c in ("rule", "action", "verdict", "trust", "kind")})
    return {r["page_id"]: r for r in filter_urls(df, **more).collect()}


def test_longest_rule_wins(spark):
    got = verdicts(spark, [(1, "http://A.example.COM/en/1?x", None), (2, "http://example.com/en/7", ""), (3, "http://notexample.com/en/7", ""), (4, "https://x.net/de/8", ""), (5, "https://example.net/de/8#a", ""), (6, "no host", ""), (7, None, ""), (8, "https://EXAMPLE.net/DE/8", "")], rounds=1)
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(1, 7)] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block"), (None, "allow")]
    assert (got[1]["host"], got[1]["path"]) == ("a.example.com", "/en/1") and (got[7]["host"], got[7]["path"], got[7]["verdict"]) == ("", "", "allow")
    assert got[8]["rule"] is None and got[8]["path"] == "/DE/8"


def test_distrust_flows_against_links(spark):
    rules = (Rule("block", "bad", "/"), Rule("allow", "good", "/"))
    link = lambda h: f'<a href="http://{h}/">x</a>'
    rows = [(1, "http://bad/", link("victim")), (2, "http://good/", link("fine")), (3, "http://farm/", link("bad")), (4, "http://victim/", "<a href='/x'>"), (5, "http://fine/", link("bad") + link("good") * 3), (6, "http://farm2/", link("farm"))]
    got = {i: r["verdict"] for i, r in verdicts(spark, rows, rules=rules).items()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "block"}


def test_ranks_equal_a_plain_loop(spark):
    edges = [("a", "b", 2), ("a", "a", 1), ("b", "c", 1), ("c", "a", 5), ("d", "a", 1)]
    seeds = [("a", 3.0, 0.0), ("c", 1.0, 2.0)]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in propagate(spark.createDataFrame(edges, "source string, target string, n long"), spark.createDataFrame(seeds, "host string, trusted double, blocked double"), 5).collect()}

    def loop(links, start):
        total = sum(start.values())
        start = {h: v / total for h, v in start.items() if v}
        out = {s: sum(n for a, _, n in links if a == s) for s, _, _ in links}
        rank = dict(start)
        for _ in range(5):
            new = {h: 0.15 * v for h, v in start.items()}
            for s, t, n in links:
                new[t] = new.get(t, 0) + 0.85 * rank.get(s, 0) * n / out[s]
            rank = new
        return rank

    trust, distrust = loop(edges, {"a": 3, "c": 1}), loop([(t, s, n) for s, t, n in edges], {"c": 2})
    for h, (x, y) in got.items():
        assert x == pytest.approx(trust.get(h, 0)) and y == pytest.approx(distrust.get(h, 0))


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    rows = [(0, "http://bad/", None), *((i, f"http://h{i}/", f'<a href="http://{f"h{i - 1}" if i > 1 else "bad"}/">x</a>') for i in range(1, 15))]
    got = verdicts(spark, rows, rules=(Rule("block", "bad", "/"),))
    assert [got[i]["verdict"] for i in range(15)] == ["block"] * 15


def test_links_and_edges(spark):
    df = spark.createDataFrame([("me", '<a href="HTTP://You/x"><a HREF=//they/><a href=\'mailto:a@b\'><a href="/own"><a href="#top">')], "host string, html string")
    assert {(r["target"], r["n"]) for r in host_edges(df, "html").collect()} == {("you", 1), ("they", 1), ("me", 2)}
    assert filter_urls(spark.createDataFrame([], PAGES), rounds=1).count() == 0
    same = filter_urls(spark.createDataFrame([(1, "http://a/", None), (1, "http://a/", None), (None, "http://com/en/", "x" * 500_000)], PAGES), rounds=1)
    assert same.count() == 3
