import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from logloom.llm import ngram_join
from logloom.llm.components import connected_components
from logloom.llm.ngram_join import Sets, Trie, chunk_components, drop_similar, similar_texts
from logloom.llm.words import shingles, word_chunks

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, similarity=75):
    """(id, set size, component, rows with an equal set) of each row, from all pairs."""
    sets = [grams(t) for _, t in rows]
    component = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and sets[a] and None not in (rows[a][0], rows[b][0]):
                both = len(sets[a] & sets[b])
                if 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                    old, new = component[b], component[a]
                    component = [new if c == old else c for c in component]
    least = {}
    for (i, _), c in zip(rows, component, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    equal = Counter(s for (i, _), s in zip(rows, sets, strict=True) if i is not None and s)
    return sorted(((i, len(s), least.get(c) if i is not None else None, equal[s] if i is not None and s else 1) for (i, _), s, c in zip(rows, sets, component, strict=True)), key=str)


def near_copies(seed=0):
    """Groups of texts with some words changed, a passage that many share, copies, and loose texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage, rows = [word() for _ in range(25)], []
    for _ in range(12):
        base = [word() for _ in range(r.randint(6, 120))]
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = word()
            rows.append(" ".join(t[: r.randint(len(t) * 3 // 4, len(t))]))
    for _ in range(25):
        t = [word() for _ in range(r.randint(5, 60))]
        rows.append(" ".join(t[:10] + passage + t[10:]))
    rows += [r.choice(rows) for _ in range(15)] + ["one two", "one TWO", "one two three", "", " \n", None]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    return list(zip(ids, rows, strict=True))


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_equal"]) for r in similar_texts(df).collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_equals_all_pairs(docs, seed):
    rows = near_copies(seed)
    assert got(docs(rows)) == brute(rows)


@pytest.mark.parametrize("size", [2, 5])
def test_blocks_are_dealt_out(docs, monkeypatch, size):
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", size)
    monkeypatch.setattr(ngram_join, "KNOWN_CLASSES", 2)
    rows = near_copies(5)
    assert got(docs(rows)) == brute(rows)


def test_chains_and_rings_in_many_chunks(docs, monkeypatch):
    """Texts linked only to the ones before and after them, which no set with many links brings together."""
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 3)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 40])) for k in range(60)] + [(100 + k, " ".join(words[300 + k : 340 + k])) for k in range(0, 40, 9)]
    assert got(docs(rows)) == brute(rows)


def test_a_large_group_of_near_copies(docs, monkeypatch):
    """20,000 differing near copies: every chunk has few of them, and none is compared with all."""
    r, n = random.Random(9), 20_000
    base = [f"b{k}" for k in range(80)]
    rows = [(k, " ".join(base[:40] + [f"u{k}"] + base[40:])) for k in range(n)] + [(n + k, " ".join(f"x{k}-{j}" for j in range(30))) for k in range(20)]
    for k in range(0, n, 3):
        t = rows[k][1].split()
        t[r.randrange(len(t))] = r.choice(["p", "q"])
        rows[k] = (k, " ".join(t))
    out = {x["doc_id"]: x["component_id"] for x in similar_texts(docs(rows)).collect()}
    assert all(out[k] == 0 for k in range(n)) and all(out[n + k] == n + k for k in range(20))


def test_tasks_send_often(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "GATHERED", 300)
    rows = near_copies(7)
    assert got(docs(rows)) == brute(rows)


def test_edges(docs, clashing):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (2, "A B C D E F"), (3, "a b c d e f"), (5, "x " * 100_000), (6, "x x x x x"), (7, None)]
    assert got(clashing(rows)) == brute(rows)
    assert similar_texts(docs([])).count() == 0
    kept = drop_similar(clashing(rows))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "5", "7", "None"]
    assert kept.columns == clashing([]).columns and drop_similar(docs([])).count() == 0


def some_sets(r, m):
    base = r.sample(range(1000), 40)
    sets = [np.array(sorted(set(r.sample(base, r.randint(20, 40))) | set(r.sample(range(1000, 1100), r.randint(0, 3)))), np.int64) for _ in range(m)]
    return Sets(list(range(m)), np.array([len(s) + r.randint(0, 2) for s in sets], np.int64), sets)


def linked(a, b, i, j):
    both = len(np.intersect1d(a.grams[i], b.grams[j]))
    return 100 * both >= 75 * (a.n[i] + b.n[j] - both)


@pytest.mark.parametrize("seed", range(60))
def test_trie_finds_all_pairs(seed):
    r = random.Random(seed)
    hosts = some_sets(r, r.randint(1, 25))
    guests = some_sets(random.Random(seed + seed % 2), r.randint(1, 25))
    for probes in (hosts, guests):
        a, b = Trie(hosts).links(probes, 75)
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i in range(len(probes.n)) for j in range(len(hosts.n)) if linked(probes, hosts, i, j)]
    root, hub = chunk_components(hosts, 75)
    label = list(range(len(hosts.n)))
    for i in label[:]:
        for j in range(i):
            if linked(hosts, hosts, i, j):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert root.tolist() == label and sorted(root[hub].tolist()) == sorted(set(label))


def test_trie_cuts_subtrees_off(monkeypatch):
    """A probe that can't reach the needed overlap below a node doesn't go down to its sets."""
    base = np.arange(100)
    sets = [np.concatenate([base[:10], 1000 * (g + 1) + np.arange(90), [100_000 + 10 * g + k]]) for g in range(5) for k in range(8)]
    hosts = Sets(list(range(40)), np.full(40, 101), [np.sort(s) for s in sets])
    steps = []
    count = np.bincount
    monkeypatch.setattr(ngram_join.np, "bincount", lambda *a, **k: steps.append(1) or count(*a, **k))
    a, _ = Trie(hosts).links(Sets([0], np.array([101]), [hosts.grams[0]]), 75)
    assert len(a) == 8 and len(steps) <= 1 + 1 + 5 + 8  # what the probe has, the root, five ways down, and only one group's sets


def test_shingles_of_whole_texts():
    texts = ["a b c d e f", "A b  c\td e f", "a b c", "", "a b c d e a b c d e", "c b a"]
    found = {}
    for w in word_chunks(pa.array(texts), chunk_bytes=12):
        text, value = shingles(w)
        for t, v in zip(text, value, strict=True):
            found.setdefault(t + w.first, set()).add(int(v))
    assert [len(found.get(k, ())) for k in range(6)] == [len(grams(t)) for t in texts]
    assert found[0] == found[1] and not found[2] & found[5]


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, 500)]
    out = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    seen = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = start
                todo += near[x]
    assert out == seen
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shared_paragraphs(n, pool, seed=3):
    """Pages of five paragraphs, of 60 words each, that many pages share, so that hardly any two link; some near copies."""
    r = random.Random(seed)
    paragraphs = [" ".join(f"p{p}w{r.randrange(10**6)}" for _ in range(60)) for p in range(pool)]
    pages = [r.sample(paragraphs, 5) for _ in range(n)]
    for k in range(0, n, 100):
        pages[k] = [*pages[k + 50][:4], pages[k + 50][4] + f" end{k}"]
    return [(k, "\n".join(page)) for k, page in enumerate(pages)]


def test_half_similar_pages_meet_few_chunks(docs, monkeypatch):
    """Pages of one block that share paragraphs visit a few of its 12 chunks, and lose no link."""
    visits, write = [], ngram_join.written

    def written(df, name):
        out = write(df, name)
        visits.extend([out.count()] if name == "visits" else [])
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    n = 3000
    rows = shared_paragraphs(n, 200)
    out = {x["doc_id"]: x["component_id"] for x in similar_texts(docs(rows)).collect()}
    sets, sharing = {k: grams(t) for k, t in rows}, defaultdict(set)
    component = {k: k for k in sets}
    for k, t in rows:
        for p in t.split("\n"):
            sharing[p.split(" end")[0]].add(k)
    for members in sharing.values():
        for a in members:
            for b in members:
                both = len(sets[a] & sets[b]) if a < b else 0
                if a < b and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    old, new = max(component[a], component[b]), min(component[a], component[b])
                    component = {k: new if c == old else c for k, c in component.items()}
    assert out == component and len(set(component.values())) < n
    assert sum(visits) < 5 * n


def test_passages_are_looked_at_once(spark):
    """Sets with a passage meet chunks by the first of its n-grams that they share, not by each of them."""
    passage = [5, 3, 9, 7]  # in the global order
    rows = [(k // 2, k, 4, passage if k < 6 else [11, 3, 9, 7]) for k in range(8)]
    sets = spark.createDataFrame(rows, "chunk long, vertex long, n long, grams array<long>")
    seen, plan = [], ngram_join.starts(sets, 20, "chunk", "vertex")
    assert sorted((r["vertex"], r["gram"], r["last"]) for r in plan.where("vertex in (0, 7)").collect()) == [(0, 3, 5), (0, 5, None), (0, 7, 9), (0, 9, 3), (7, 3, 11), (7, 7, 9), (7, 9, 3), (7, 11, None)]
    visits = ngram_join.chunk_visits(sets, sets, 20)
    assert sorted(map(tuple, visits.collect())) == [(v, c) for v in range(8) for c in range(4) if c != v // 2]
    distinct = type(sets).distinct
    try:
        type(sets).distinct = lambda df: seen.append(df.count()) or distinct(df)
        ngram_join.chunk_visits(sets, sets, 20)
    finally:
        type(sets).distinct = distinct
    # n-grams 9 and 7 always follow another one; 5, 3 and 11 are looked at
    assert seen == [6 * 2 + 8 * 3]
