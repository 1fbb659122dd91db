"""Similarity join of n-gram sets by prefix trees.

Two texts are linked when the Jaccard similarity of their sets of word n-grams is at
least `similarity` percent.  The join loses no link between components:

1. Texts with equal sets become one class.
2. A filter by the ordered beginnings of the sets.  In a global order of n-grams (their
   hashes), two linked sets share at least `l` n-grams among the first
   n - ceil(t n) + l of each.  Sets that share too few of these with any other set
   have no partner and leave, which in most corpora are nearly all.
3. For the rest the global order is rarest first, and beginnings are short.  Sets that
   share an n-gram of their beginnings, directly or over others, form a block.
4. Blocks are dealt out in chunks of bounded size, in an order that keeps sets with the
   same first passage together.  In each chunk the sets are put in a
   trie, which is walked once for all sets: the overlaps of all sets with the path to a
   node are shared by everything below it, and a set leaves the walk of a subtree as soon
   as the overlap so far and the length that remains can't make a link with any set there.
5. Of each chunk's components the set with most links stands for it, and these are joined
   in chunks again, until chunks of a block can't be brought together further.  Most near
   copies are then in one component.  A link that is still missing has an end outside its
   block's largest component, so every set there meets the tries of all other chunks that
   have an n-gram of its beginning at places and with sizes that allow a link: what comes
   before the first shared n-gram is lost to both sets.

So the work grows with the number of sets and of those outside, not with the square of a
group of near copies.  That is also why links are not counted: all pairs of such a group
would have to be looked at.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import among_top, written
from .components import connected_components
from .words import mix, shingles, word_chunks

SIZE = 5
SIMILARITY = 75
#: Classes with the most copies that every task knows, so that it leaves the copies out: 24 bytes each.  Copies in
#: other classes take part like any other text.
KNOWN_CLASSES = 1 << 16
#: A chunk has about so many sets, and about so many n-grams if it has more than one set.
CHUNK_SETS = 256
CHUNK_GRAMS = 1_000_000
#: N-grams that a task gathers before it sends them on.
GATHERED = 4_000_000


def needed(n: Column, similarity: int) -> Column:
    """The least overlap of a set of size n with any set linked to it."""
    return F.ceil(n * similarity / 100).cast("long")


def set_digest(text: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each text's n-grams, equal for equal sets."""
    ends = np.searchsorted(text, np.arange(n + 1))
    sums = []
    for seed in (0x51ED270B, 0xB4B82E39):
        total = np.append(np.uint64(0), np.cumsum(mix(gram + np.uint64(seed)), dtype=np.uint64))
        sums.append(total[ends[1:]] - total[ends[:-1]])
    return sums[0], sums[1]


def set_classes(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, n, d1, d2: the size and digests of every row's n-gram set."""
    schema = T.StructType([df.schema[id_col], T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())])

    def run(batches):
        for b in batches:
            for w in word_chunks(b.column(1)):
                text, gram = shingles(w, size)
                n = w.last - w.first
                d1, d2 = set_digest(text, gram, n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.first, n), pa.array(np.bincount(text, minlength=n)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def first_grams(df: DataFrame, id_col: str, text_col: str, size: int, similarity: int, copies) -> DataFrame:
    """gram, doc, n, hits: the beginnings of the sets in hash order.

    A task combines what it has gathered: an n-gram of several of its sets goes on once, without a doc, and those
    sets get their hits at once, in rows of their own.  So no n-gram has more rows than there are tasks.
    """
    schema = T.StructType([T.StructField("gram", T.LongType()), T.StructField("doc", df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("hits", T.LongType())])

    def run(batches):
        known, first = copies.value
        ids, grams, docs, sizes, total = [], [], [], [], 0
        count = 0

        def send():
            gram, doc, n = np.concatenate(grams), np.concatenate(docs), np.concatenate(sizes)
            id_array = pa.concat_arrays(ids)
            order = np.argsort(gram)
            gram, doc = gram[order], doc[order]
            head = np.append(True, gram[1:] != gram[:-1])
            times = np.diff(np.append(np.flatnonzero(head), len(gram)))
            several = np.repeat(times > 1, times)
            hits = np.bincount(doc[several], minlength=len(n))
            hit = np.flatnonzero(hits)
            alone, shared = np.flatnonzero(~several), np.flatnonzero(head & several)
            nothing = pa.nulls(len(shared), id_array.type)
            zero = np.zeros(len(alone), np.int64)
            spread = mix(hit.astype(np.uint64) + gram[:1].repeat(len(hit))).view(np.int64)
            for columns in (
                (gram[alone].view(np.int64), id_array.take(pa.array(doc[alone])), n[doc[alone]], zero),
                (gram[shared].view(np.int64), nothing, np.zeros(len(shared), np.int64), np.zeros(len(shared), np.int64)),
                (spread, id_array.take(pa.array(hit)), n[hit], hits[hit]),
            ):
                yield from pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names).to_batches(100_000)

        for b in batches:
            for w in word_chunks(b.column(1)):
                text, gram = shingles(w, size)
                n = w.last - w.first
                own = b.column(0).slice(w.first, n)
                d1, _ = set_digest(text, gram, n)
                per = np.bincount(text, minlength=n)
                need = -(-per * similarity // 100)
                keep = np.minimum(per, per - need + np.maximum(1, per // 8))
                if len(known):
                    at = np.minimum(np.searchsorted(known, d1), len(known) - 1)
                    copy = (known[at] == d1) & ~np.array([i == j for i, j in zip(own.to_pylist(), (first[k] for k in at.tolist()), strict=True)], bool)
                    keep[copy] = 0
                place = np.arange(len(text)) - np.searchsorted(text, np.arange(n))[text]
                some = place < keep[text]
                ids.append(own)
                grams.append(gram[some])
                docs.append(text[some] + count)
                sizes.append(per)
                count, total = count + n, total + int(some.sum())
                if total >= GATHERED:
                    yield from send()
                    ids, grams, docs, sizes, total, count = [], [], [], [], 0, 0
        if total:
            yield from send()

    return df.select(id_col, text_col).mapInArrow(run, schema)


def possible(df: DataFrame, classes: DataFrame, id_col: str, text_col: str, size: int, similarity: int) -> DataFrame:
    """(doc, n): the first rows of the classes whose sets may have a partner."""
    several = classes.where("copies > 1")
    top = several.where(among_top(several, "copies", KNOWN_CLASSES, "doc")).select("d1", "doc").collect()
    top.sort(key=lambda r: r["d1"] % (1 << 64))
    copies = df.sparkSession.sparkContext.broadcast((np.array([r["d1"] for r in top], np.int64).view(np.uint64), [r["doc"] for r in top]))
    rows = first_grams(df, id_col, text_col, size, similarity, copies)
    rows = rows.withColumn("_sets", F.count("*").over(Window.partitionBy("gram")))
    hits = F.when(F.col("hits") > 0, F.col("hits")).otherwise(F.lit(1))
    found = rows.where("doc is not null and (hits > 0 or _sets > 1)").groupBy("doc", "n").agg(F.sum(hits).alias("hits"))
    # The sets linked to one of size n have at least needed(n) n-grams, and so share at least an eighth of that.
    found = found.where(F.col("hits") >= F.greatest(F.lit(1), F.floor(needed(F.col("n"), similarity) / 8)))
    return written(found.select("doc", "n").join(classes.select("doc", "n"), ["doc", "n"], "left_semi"), "possible-sets")


def all_grams(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc, n, gram): every n-gram of every row."""
    schema = T.StructType([T.StructField("doc", df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("gram", T.LongType())])

    def run(batches):
        for b in batches:
            for w in word_chunks(b.column(1), 1 << 20):
                text, gram = shingles(w, size)
                n = np.bincount(text, minlength=w.last - w.first)
                own = b.column(0).slice(w.first, w.last - w.first)
                yield from pa.Table.from_arrays([own.take(pa.array(text)), pa.array(n[text]), pa.array(gram.view(np.int64))], names=schema.names).to_batches(100_000)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def ordered_sets(df: DataFrame, kept: DataFrame, id_col: str, text_col: str, size: int, similarity: int) -> DataFrame:
    """(doc, n, grams, near): grams has the n-grams that at least two sets have, rarest first; those of one set alone come
    before them in the global order and link nothing.

    near is the n-gram by which similar sets stand together in chunks.  Sets of one size share one of their first
    n - 2t/(1+t) n + 1, the last of which is mostly of a passage that many sets have; near is the first of about its
    frequency, which is the same for all sets that have the passage there."""
    rows = df.select(F.col(id_col).alias("doc"), text_col).join(kept.select("doc").distinct(), "doc", "left_semi")
    grams = written(all_grams(rows, "doc", text_col, size).join(kept, ["doc", "n"], "left_semi"), "grams")
    sets = grams.groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1")
    ordered = grams.join(sets, "gram").groupBy("doc", "n").agg(F.sort_array(F.collect_set(F.struct("sets", "gram"))).alias("g"))
    last = F.greatest(F.size("g") - F.ceil(F.col("n") * 2 * similarity / (100 + similarity)), F.lit(0)).cast("int")
    often = lambda sets: F.floor(F.log2(sets))
    near = F.filter("g", lambda x: often(x["sets"]) >= often(F.col("g")[last]["sets"]))[0]["gram"]
    ordered = ordered.select("doc", "n", F.col("g.gram").alias("grams"), near.alias("near"))
    return written(ordered.where(F.size("grams") >= needed(F.col("n"), similarity)), "ordered-sets")


def starts(sets: DataFrame, similarity: int, *keep: str) -> DataFrame:
    """`keep`, before, gram and last: a row for each n-gram of the beginnings of `sets`, whose other n-grams no other set has;
    before is the number of n-grams before it, last that of them which stands directly before it, if another set has it too."""
    beginning = F.greatest(F.size("grams") - needed(F.col("n"), similarity) + 1, F.lit(0)).cast("int")
    pairs = F.transform(F.slice("grams", F.lit(1), beginning), lambda g, i: F.struct(g.alias("gram"), F.get("grams", i - 1).alias("last")))
    rows = sets.select(*keep, (F.col("n") - F.size("grams")).alias("_alone"), F.posexplode(pairs).alias("_at", "_g"))
    return rows.select(*keep, (F.col("_alone") + F.col("_at")).alias("before"), "_g.gram", "_g.last")


# ---------------------------------------------------------------- in a task


class Sets(NamedTuple):
    """Some sets with their sizes, which count n-grams that no other set has too."""

    ids: list
    n: np.ndarray
    grams: list[np.ndarray]


class Trie:
    """The trie of some sets: their n-grams, most frequent first, as sorted paths, with the depth to which each path is
    also the next one's.  A node is a run of paths and the depth to which they are one."""

    def __init__(self, sets: Sets):
        flat = np.concatenate(sets.grams)
        self.values, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(self.values), np.int64)
        self.rank[np.argsort(-count, kind="stable")] = np.arange(len(self.values))
        cuts = np.append(0, np.cumsum([len(g) for g in sets.grams]))
        paths = [np.sort(self.rank[inverse[a:b]]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        self.order = np.array(sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes()), np.int64)
        self.paths = [paths[i] for i in self.order]
        self.n, self.length = sets.n[self.order], np.array([len(p) for p in self.paths], np.int64)
        self.shared = np.array([_shared(a, b) for a, b in zip(self.paths[:-1], self.paths[1:])], np.int64)

    def links(self, probes: Sets, similarity: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of a probe, number of a set) of all linked pairs."""
        at = np.minimum(np.searchsorted(self.values, np.concatenate(probes.grams)), len(self.values) - 1)
        owner = np.repeat(np.arange(len(probes.grams)), [len(g) for g in probes.grams])
        known = self.values[at] == np.concatenate(probes.grams)
        label, owner = self.rank[at[known]], owner[known]
        by_label = np.argsort(label, kind="stable")
        posting, post = owner[by_label], np.searchsorted(label[by_label], np.arange(len(self.values) + 1))
        inside = np.bincount(owner, minlength=len(probes.n))  # n-grams of each probe that the trie has
        found: tuple[list, list] = ([], [])
        everyone = np.arange(len(probes.n))
        todo = [(0, len(self.paths), 0, everyone, np.zeros(len(everyone), np.int64))]
        while todo:
            low, high, depth, active, overlap = todo.pop()
            # At most what remains of a probe and of the longest path below can be added.
            least, rest = self.n[low:high].min(), self.length[low:high].max() - depth
            can = overlap + np.minimum(inside[active] - overlap, rest)
            going = (100 + similarity) * can >= similarity * (probes.n[active] + least)
            if not going.any():
                continue
            active, overlap = active[going], overlap[going]
            end = int(self.shared[low : high - 1].min()) if high - low > 1 else int(self.length[low])
            segment = self.paths[low][depth:end]
            if len(segment):
                size = post[segment + 1] - post[segment]
                reached = posting[np.repeat(post[segment] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())]
                overlap = overlap + np.bincount(reached, minlength=len(probes.n))[active]
            if high - low == 1:
                hit = (100 + similarity) * overlap >= similarity * (probes.n[active] + self.n[low])
                found[0].append(active[hit])
                found[1].append(np.full(hit.sum(), self.order[low]))
                continue
            cuts = [low, *(low + 1 + np.flatnonzero(self.shared[low : high - 1] == end)).tolist(), high]
            todo += [(a, b, end, active, overlap) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return (np.concatenate(found[0]), np.concatenate(found[1])) if found[0] else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[:k] != b[:k])
    return int(differ[0]) if len(differ) else k


def chunk_components(sets: Sets, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the first set of each set's component, and whether the set has most links of its component."""
    m = len(sets.n)
    a, b = Trie(sets).links(sets, similarity)
    beside = np.eye(m, dtype=bool)
    beside[a, b] = beside[b, a] = True
    root, links, hub = np.full(m, -1), beside.sum(1), np.zeros(m, bool)
    for i in range(m):
        if root[i] < 0:
            members = beside[i]
            while (more := members | beside[members].any(0)).sum() > members.sum():
                members = more
            root[members] = i
            hub[np.argmax(np.where(members, links, -1))] = True
    return root, hub


def grouped(batches, keys: int):
    """(key, Sets) of rows (key columns, id, n, grams) of which those with equal keys stand together.  Of `keys` columns
    the last tells whether the rows stay together (0) or come in parts of bounded size (1)."""
    key, ids, n, grams, total = None, [], [], [], 0
    for b in batches:
        lists = b.column(keys + 2)
        values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for k, row in enumerate(zip(*(b.column(c).to_pylist() for c in range(keys + 2)), strict=True)):
            if ids and (key != row[:keys] or (key[-1] and (len(ids) >= CHUNK_SETS or total >= CHUNK_GRAMS))):
                yield key, Sets(ids, np.array(n, np.int64), grams)
                ids, n, grams, total = [], [], [], 0
            key = row[:keys]
            ids.append(row[keys])
            n.append(row[keys + 1])
            grams.append(values[at[k] : at[k + 1]].copy())
            total += len(grams[-1])
    if ids:
        yield key, Sets(ids, np.array(n, np.int64), grams)


# ---------------------------------------------------------------- rounds


def join_chunks(sets: DataFrame, similarity: int) -> DataFrame:
    """(block, chunk, vertex, n, grams, root, hub) of sets (block, vertex, n, grams, near), joined within each chunk.

    One sort over all sets deals them out: tasks have ranges of it, and cut what they have of a block into chunks.
    The vertex's hash ends the order, so that any number of like sets can be split.
    """
    vertex = sets.schema["vertex"]
    found = [T.StructField("root", vertex.dataType), T.StructField("hub", T.BooleanType())]
    schema = T.StructType([sets.schema["block"], T.StructField("chunk", T.LongType()), vertex, sets.schema["n"], sets.schema["grams"], *found])

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        for number, ((block, *_), part) in enumerate(grouped(batches, 2)):
            root, hub = chunk_components(part, similarity)
            ids, m = pa.array(part.ids), len(part.ids)
            grams = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(g) for g in part.grams])), pa.int32()), pa.array(np.concatenate(part.grams)))
            yield pa.RecordBatch.from_arrays([pa.array([block] * m), pa.array([task + number] * m, pa.int64()), ids, pa.array(part.n), grams, ids.take(pa.array(root)), pa.array(hub)], names=schema.names)

    rows = sets.select("block", F.lit(1).alias("role"), "vertex", "n", "grams", "near", F.array_min("grams").alias("_least"), F.xxhash64("vertex").alias("_hash"))
    order = ["block", "near", "_least", "_hash"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, "vertex").drop("near", "_least", "_hash").mapInArrow(run, schema)


def of_several(chunks: DataFrame) -> DataFrame:
    """The rows of those blocks that have more than one chunk.  Rows meet by chunk, as one block may have most of them."""
    places = chunks.select("block", "chunk").distinct()
    several = places.groupBy("block").count().where("count > 1").select("block")
    return chunks.join(places.join(several, "block", "left_semi").select("chunk"), "chunk", "left_semi")


def chunk_visits(sets: DataFrame, outside: DataFrame, similarity: int) -> DataFrame:
    """(vertex, chunk): the chunks other than its own that may have a set linked to a vertex of `outside`.

    Of the first n-gram that two sets share, `before` tells how much of each can't be shared.  A link needs an overlap
    of t/(1+t) of both sizes, so a chunk's least size and its longest rest are compared for each n-gram.

    Where all sets that have an n-gram have the same one directly before it, it is not the first that any two of them share, and
    isn't looked at.  So a passage of many sets counts once, and not once for each of its n-grams.
    """
    s, all_of = similarity, 100 + similarity
    rows = starts(sets, s, "chunk", "n")
    places = rows.groupBy("gram", "chunk").agg(F.min("n").alias("least"), F.max(100 * F.col("n") - all_of * F.col("before")).alias("reach"), F.min("last").alias("low"), F.max("last").alias("high"), F.count_if(F.col("last").isNull()).alias("none"))
    follows = (F.sum("none") == 0) & (F.min("low") == F.max("high"))
    firsts = places.groupBy("gram").agg(F.coalesce(follows, F.lit(False)).alias("_follows")).where(~F.col("_follows")).select("gram")
    places = places.join(firsts, "gram").drop("low", "high", "none")
    visitors = starts(outside.withColumnRenamed("chunk", "own"), s, "vertex", "n", "own").drop("last")
    fits = (all_of * (F.col("n") - F.col("before")) >= s * (F.col("n") + F.col("least"))) & (F.col("reach") >= s * F.col("n"))
    return visitors.join(places, "gram").where(fits & (F.col("chunk") != F.col("own"))).select("vertex", "chunk").distinct()


def meet_chunks(sets: DataFrame, outside: DataFrame, similarity: int) -> DataFrame:
    """Edges (a, b) from each vertex of `outside` to the sets of other chunks linked to it, one for each of their
    components.  Chunks are copied for each CHUNK_SETS of their visitors, so that no task has more than a chunk and so
    many visitors."""
    vertex = sets.schema["vertex"]
    schema = T.StructType([T.StructField("a", vertex.dataType), T.StructField("b", vertex.dataType)])
    visits = written(chunk_visits(sets, outside, similarity), "visits")
    parts = visits.groupBy("chunk").agg(F.ceil(F.count("*") / CHUNK_SETS).alias("parts"))
    visitors = visits.join(parts, "chunk").withColumn("part", F.pmod(F.xxhash64("vertex"), F.col("parts"))).drop("parts").join(outside.select("vertex", "n", "grams", "component"), "vertex")
    hosts = sets.join(parts, "chunk").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["chunk", "part", "role", F.struct("vertex", "component").alias("id"), "n", "grams"]
    rows = hosts.withColumn("role", F.lit(0)).select(*columns).unionByName(visitors.withColumn("role", F.lit(1)).select(*columns))

    def run(batches):
        trie, hosts = None, []
        for key, part in grouped(batches, 3):
            if key[2] == 0:
                trie, hosts, place = Trie(part), part.ids, key[:2]
            elif trie is not None and place == key[:2]:
                a, b = trie.links(part, similarity)
                found = {(part.ids[i]["vertex"], hosts[j]["component"]): hosts[j]["vertex"] for i, j in zip(a.tolist(), b.tolist(), strict=True) if part.ids[i]["component"] != hosts[j]["component"]}
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], ids), pa.array(list(found.values()), ids)], names=schema.names)

    ids = pa.int64() if isinstance(vertex.dataType, T.LongType) else None
    return rows.repartition("chunk", "part").sortWithinPartitions("chunk", "part", "role").mapInArrow(run, schema)


def joined(placed: DataFrame, similarity: int) -> DataFrame:
    """(node, component) of the sets of `placed` (block, vertex, n, grams, near) that have a link."""
    chunked = now = written(join_chunks(placed, similarity), "chunks")
    edges = now.select(F.col("vertex").alias("a"), F.col("root").alias("b"))
    divided = of_several(now).where("hub")
    before, hubs = None, divided.count()
    # Sets with most links meet in chunks again, as long as that leaves fewer of them.
    while hubs and (before is None or hubs < before * 0.9):
        again = placed.join(divided.select("vertex"), "vertex", "left_semi")
        now = written(join_chunks(again, similarity).drop("n", "grams"), "hub-components")
        edges = edges.unionByName(now.select(F.col("vertex").alias("a"), F.col("root").alias("b")))
        divided = of_several(now).where("hub")
        before, hubs = hubs, divided.count()
    components = connected_components(edges)
    if before is None:
        return components
    # Blocks of several chunks: what is not in the largest component meets all chunks that it can have a link to.
    parted = written(of_several(chunked).drop("root", "hub").join(components, F.col("vertex") == F.col("node"), "left").drop("node").withColumn("component", F.coalesce("component", "vertex")), "parted-blocks")
    largest = parted.groupBy("block", "component").count().groupBy("block").agg(F.max_by("component", F.struct("count", F.col("component"))).alias("largest"))
    largest = parted.select("block", "chunk").distinct().join(largest, "block").select("chunk", "largest")
    outside = written(parted.join(largest, "chunk").where("component <> largest").drop("largest"), "outside")
    more = written(meet_chunks(parted, outside, similarity), "late-links")
    if more.isEmpty():
        return components
    return connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def similar_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: int = SIMILARITY) -> DataFrame:
    """One row per row of `df`: id, n_shingles, component_id, n_equal.

    component_id is the smallest id reachable by links, n_equal the number of rows
    with the same set of n-grams, this one included.  A text with fewer than `size`
    words has its whole sequence as its n-gram; a null or empty text, or one without
    words, has an empty set and no links (n_equal is 1).  A row without an id takes no
    part and has a null component.  A repeated row is linked to its twin.  Ids are
    meant to be unique; rows that share an id but not a text count as documents of
    their own if their sets differ in size.  Other columns are not looked at; an empty
    table gives an empty result.
    """
    light = written(set_classes(df, id_col, text_col, size), "set-classes").withColumnRenamed(id_col, "doc")
    real = df.where(F.col(id_col).isNotNull())
    classes = written(light.where("n > 0 and doc is not null").groupBy("d1", "d2", "n").agg(F.min("doc").alias("doc"), F.count("*").alias("copies")), "classes")
    kept = possible(real, classes, id_col, text_col, size, similarity)
    sets = ordered_sets(real, kept, id_col, text_col, size, similarity)

    # Sets of one size with equal repeated n-grams are one vertex; a task combines them before anything is shuffled.
    same = ["n", F.size("grams").alias("size"), F.xxhash64("grams").alias("h1"), F.hash("grams").alias("h2")]
    vertices = written(sets.groupBy(*same).agg(F.min("doc").alias("vertex"), F.first("grams").alias("grams"), F.first("near").alias("near")), "vertices")
    first = starts(vertices, similarity, "vertex").drop("last")
    least = first.groupBy("gram").agg(F.min("vertex").alias("b"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    blocks = connected_components(first.join(least, "gram").select(F.col("vertex").alias("a"), "b"))
    placed = written(vertices.join(blocks, F.col("vertex") == F.col("node")).select(F.col("component").alias("block"), "vertex", "n", "grams", "near"), "blocks")
    roots = joined(placed, similarity)

    # A vertex's own sets are linked to one another if what they share is enough.
    own = (100 + similarity) * F.col("size") >= 2 * similarity * F.col("n")
    member = sets.select("doc", *same).join(vertices.select("n", "size", "h1", "h2", "vertex", own.alias("own")), ["n", "size", "h1", "h2"]).join(roots, F.col("vertex") == F.col("node"), "left")
    known = member.select("doc", "n", F.coalesce("component", F.when(F.col("own"), F.col("vertex"))).alias("component"))
    by_class = written(classes.join(known, ["doc", "n"], "left").select("d1", "d2", "n", F.coalesce("component", "doc").alias("component"), "copies"), "class-components")
    told = light.where("n > 0").join(by_class, ["d1", "d2", "n"], "left").unionByName(light.where("n = 0"), allowMissingColumns=True)
    linked = F.col("doc").isNotNull()
    return told.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(linked, F.coalesce("component", "doc")).alias("component_id"), F.when(linked, F.coalesce("copies", F.lit(1))).otherwise(1).alias("n_equal"))


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: int = SIMILARITY) -> DataFrame:
    """One row of each component, that with the smallest id, with all its columns; rows without an id stay."""
    found = similar_texts(df, id_col, text_col, size, similarity)
    keep = found.where(F.col("component_id") == F.col(id_col)).select(id_col).distinct()
    rows = df.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"))
    kept = rows.join(keep.withColumnRenamed(id_col, "_id"), "_id", "left_semi").dropDuplicates(["_id", "_text"])
    return kept.unionByName(rows.where("_id is null")).select("_row.*")
