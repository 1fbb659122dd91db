"""URL filter: rules by host and path, and for what no rule fits, trust and distrust over the link graph.

Hosts are nodes; an edge's weight is the share of a host's links that it carries, a
link within a host being an edge to itself.  Trust is personalised PageRank from
the hosts that allow rules fit, along the links; distrust is the same from the hosts
that block rules fit, against the links: who links to bad hosts is bad.  Both are
computed in one sequence of joins and sums over a table of edges of both kinds.  A
host is blocked when its distrust exceeds its trust by more than the threshold.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
DAMPING = 0.85
#: Rounds of the SQL, which can't test whether ranks have settled.
ROUNDS = 10
#: Ranks have settled when those of either kind are together at most so far from where they lead to.
TOLERANCE = 1e-9
THRESHOLD = 0.0
LINK = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(name, action) of the longest rule that fits, nulls if none does; the list is meant to be short."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, action = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.action)).otherwise(action)
    return name, action


def link_host(link: Column, own: Column) -> Column:
    """The host that a link leads to; null if to none, such as `mailto:`."""
    return F.when(link.contains("://"), host_of(link)).when(link.startswith("//"), host_of(F.concat(F.lit("http:"), link))).when(link.rlike(r"^(?i)[a-z][a-z0-9+.-]*:"), F.lit(None)).otherwise(own)


def host_edges(judged: DataFrame, html_col: str) -> DataFrame:
    """(source, target, n): how many links lead from host to host."""
    links = judged.where("host <> ''").select(F.col("host").alias("source"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), 1)).alias("link"))
    return links.select("source", link_host(F.col("link"), F.col("source")).alias("target")).where("target <> ''").groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float | None = None) -> DataFrame:
    """(host, trust, distrust) from edges (source, target, n) and seeds (host, trusted, blocked), weights of any sum.

    Without a number of rounds, goes on until a round reaches no new host and ranks have settled.  A round's change
    shrinks by the damping at least, so what is still to come is at most damping / (1 - damping) times the last one's.
    With a threshold, that no host's distrust - trust can still come to its other side is enough.
    What reaches a host without further links is not dealt out again.
    """
    ways = edges.select(F.lit("trust").alias("kind"), F.col("source").alias("from"), F.col("target").alias("to"), "n")
    ways = ways.unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("from"), F.col("source").alias("to"), "n"))
    sums = ways.groupBy("kind", "from").agg(F.sum("n").alias("all"))
    ways = written(ways.join(sums, ["kind", "from"]).select("kind", "from", "to", (F.col("n") / F.col("all")).alias("share")), "host-edges")

    totals = seeds.agg(F.sum("trusted").alias("trusted"), F.sum("blocked").alias("blocked")).first()
    kinds = [(kind, col, float(totals[col] or 0)) for kind, col in (("trust", "trusted"), ("distrust", "blocked"))]
    start = seeds.select(F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), "host", (F.col(col) / F.lit(total or 1.0)).alias("start")) for kind, col, total in kinds])).alias("s")).select("s.*").where("start > 0")
    start = written(start, "host-seeds")
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    rank, done, nothing = start.withColumnRenamed("start", "rank"), 0, F.lit(None).cast("double")
    while rounds is None or done < rounds:
        moved = rank.join(ways, (rank["kind"] == ways["kind"]) & (rank["host"] == ways["from"])).select(ways["kind"], F.col("to").alias("host"), (F.col("rank") * F.col("share") * F.lit(damping)).alias("part"), nothing.alias("before"))
        again = start.select("kind", "host", (F.col("start") * F.lit(1 - damping)).alias("part"), nothing.alias("before"))
        # Each round starts with all seeds, so a host once reached is reached in all later rounds.
        last = rank.select("kind", "host", F.lit(0.0).alias("part"), F.col("rank").alias("before"))
        rank = written(moved.unionByName(again).unionByName(last).groupBy("kind", "host").agg(F.sum("part").alias("rank"), F.max("before").alias("before")), "host-ranks")
        done += 1
        if rounds is None:
            hosts = rank.groupBy("host").agg(of("trust"), of("distrust"), F.sum(F.abs(F.col("rank") - F.coalesce("before", F.lit(0.0)))).alias("change"), F.count_if(F.col("before").isNull()).alias("new"))
            # A host that only one of both reaches stays on its side of 0.
            unsure = F.lit(threshold != 0) | ((F.col("trust") > 0) & (F.col("distrust") > 0))
            margin = F.min(F.when(unsure, F.abs(F.col("distrust") - F.col("trust") - F.lit(threshold))))
            change, new, least = hosts.agg(F.coalesce(F.sum("change"), F.lit(0.0)), F.coalesce(F.sum("new"), F.lit(0)), margin).first()
            ahead = change * damping / (1 - damping)
            if not new and (ahead <= tolerance or (threshold is not None and (least is None or least > ahead))):
                break
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int | None = None, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of `pages`: id, host, path, rule, verdict.

    A null url, or one without `://`, has an empty host and path, no rule, and is
    allowed, as is every host that neither trust nor distrust reaches.  A null html
    has no links.  Repeated rows each get the same verdict, and their links count
    each time; other columns are not looked at; an empty table gives an empty result.
    """
    urls = pages.select(id_col, html_col, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    name, action = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = urls.withColumns({"rule": name, "action": action})
    count = lambda what: F.count_if(F.col("action") == what).cast("double")
    seeds = judged.where("action is not null").groupBy("host").agg(count("allow").alias("trusted"), count("block").alias("blocked"))
    ranks = propagate(host_edges(judged, html_col), written(seeds, "rule-hosts"), rounds, threshold=threshold)
    # Written, so that Spark knows the size of the table of hosts when it chooses how to join it.
    bad = written(ranks.where(F.col("distrust") - F.col("trust") > threshold).select("host", F.lit("block").alias("of_host")), "blocked-hosts")
    verdict = F.coalesce("action", "of_host", F.lit("allow"))
    return judged.drop(html_col).join(bad, "host", "left").select(id_col, "host", "path", "rule", verdict.alias("verdict"))


def filter_sql(rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """The same answer as SQL, a step for each round."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(rules, key=lambda r: -len(r.name))
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, what)}'" for r in longest) + " END"
    host = lambda url: f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    steps = []
    for k in range(rounds):
        steps.append(f"""r{k + 1} AS MATERIALIZED (
  SELECT kind, host, sum(part) AS rank FROM (
    SELECT w.kind, w.t AS host, r.rank * w.share * {damping} AS part FROM r{k} r JOIN w ON r.kind = w.kind AND r.host = w.f
    UNION ALL SELECT kind, host, rank * (1 - {damping}) FROM r0) GROUP BY ALL)""")
    link = LINK.replace("'", "''")
    return f"""
WITH u AS (SELECT page_id, html, {host("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS MATERIALIZED (SELECT *, {case("name")} AS rule, {case("action")} AS action FROM u),
l AS (SELECT host AS s, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS link FROM j WHERE host <> ''),
e AS (SELECT s, CASE WHEN contains(link, '://') THEN {host("link")} WHEN starts_with(link, '//') THEN {host("'http:' || link")} WHEN regexp_matches(link, '^(?i)[a-z][a-z0-9+.-]*:') THEN NULL ELSE s END AS t FROM l),
n AS (SELECT s, t, count(*) AS n FROM e WHERE t <> '' GROUP BY ALL),
b AS (SELECT 'trust' AS kind, s AS f, t, n FROM n UNION ALL SELECT 'distrust', t, s, n FROM n),
w AS MATERIALIZED (SELECT kind, f, t, n / sum(n) OVER (PARTITION BY kind, f) AS share FROM b),
r0 AS MATERIALIZED (
  SELECT CASE action WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) / sum(count(*)) OVER (PARTITION BY action) AS rank
  FROM j WHERE action IS NOT NULL GROUP BY action, host),
{", ".join(steps)},
h AS (SELECT host, sum(CASE kind WHEN 'trust' THEN rank ELSE 0 END) AS trust, sum(CASE kind WHEN 'distrust' THEN rank ELSE 0 END) AS distrust FROM r{rounds} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(action, CASE WHEN distrust - trust > {threshold} THEN 'block' END, 'allow') AS verdict
FROM j LEFT JOIN h ON j.host = h.host"""
