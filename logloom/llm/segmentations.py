"""Sampled segmentations into the pieces of a SentencePiece model, without replacement.

A text's lattice has a node before each character and an edge for each vocabulary
piece (or, for a character outside the vocabulary, its bytes).  A segmentation's
probability is the product of its edges' conditional probabilities, so the whole
lattice has mass 1.  Gumbel top-k is run as a perturbed A-star search: the root's
perturbed value is drawn, then its best segmentation; the rest of the lattice falls
into regions, each made of the segmentations that agree up to some node and leave
it by another edge, and each gets a perturbed value truncated at its parent's.  The
region with the largest value holds the next segmentation.  So the segmentations of
a text are distinct by construction, none is drawn and thrown away, and a region's
value bounds all below it.

The lattice factorises between characters that no piece has side by side, such as a
letter and a blank, so it is built once for each different run of characters between
such places of a batch, and all texts of the batch are sampled together by numpy.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import mix

SAMPLES = 2
SLICE_CHARS = 3 << 20
BLANK = 0x2581  # what a model writes for a space
LITERAL = 0x110000  # that character itself in a text: no piece has it, so it becomes bytes
_KEY = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A model's pieces in a hash table of all their beginnings, and log weights of the pieces.

    A piece of rank r among the model's pieces weighs -log(r + 10) times the
    temperature's inverse; a character outside the vocabulary weighs as much as its
    bytes, each the rarest rank.
    """

    SLOTS = 1 << 20

    def __init__(self, path: str, temperature: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.weights = np.zeros(self.size)
        ranked = sorted(plain, key=lambda i: -model.get_score(i))
        self.weights[ranked] = -np.log(np.arange(len(ranked)) + 10.0) / temperature
        self.byte_weight = -np.log(len(ranked) + 10.0) / temperature
        self.longest = max((len(self.texts[i]) for i in plain), default=0)
        # Which characters some piece has side by side: numbers of characters, and a table of pairs of them.
        pairs = {(ord(a), ord(b)) for i in plain for a, b in zip(self.texts[i], self.texts[i][1:])}
        known = np.array(sorted({c for pair in pairs for c in pair}), np.int64)
        self.number = np.zeros(LITERAL + 1, np.int32)
        self.number[known] = np.arange(1, len(known) + 1)
        self.beside = np.zeros((len(known) + 1, len(known) + 1), bool)
        if pairs:
            self.beside[tuple(self.number[np.array(list(pairs))].T)] = True
        found: dict[int, int] = {}
        for i in plain:
            h = 0
            points = [ord(c) for c in self.texts[i]]
            for k, c in enumerate(points):
                h = _step_int(h, c)
                if k + 1 == len(points):
                    found[h] = i
                else:
                    found.setdefault(h, -1)
        self.keys, self.values = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -2, np.int64)
        for h, i in found.items():
            at = h >> 44
            while self.values[at] != -2:
                at = (at + 1) % self.SLOTS
            self.keys[at], self.values[at] = h, i

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The piece with this hash, -1 if only the beginning of one has it, -2 if neither."""
        at = (h >> np.uint64(44)).astype(np.int64)
        out = self.values[at].copy()
        todo = np.flatnonzero((out != -2) & (self.keys[at] != h))
        while len(todo):
            at[todo] = (at[todo] + 1) % self.SLOTS
            out[todo] = self.values[at[todo]]
            todo = todo[(out[todo] != -2) & (self.keys[at[todo]] != h[todo])]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: blanks back to spaces, bytes back to characters, without the first blank."""
        if not hasattr(self, "bytes_of"):  # of each id, made once in a worker
            self.bytes_of = dict(enumerate(t.replace(chr(BLANK), " ").encode() for t in self.texts)) | {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data.decode(errors="replace").removeprefix(" ")


def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h + c + np.uint64(1)) * _KEY
    return h ^ (h >> np.uint64(29))


def _step_int(h: int, c: int) -> int:
    h = (h + c + 1) * int(_KEY) & (1 << 64) - 1
    return h ^ h >> 29


class Lattice:
    """The lattices of different units, one after the other.  Node numbers are places in `chars`; an edge leads
    to node `start + length`; the edges of a node go from the longest piece to the shortest."""

    def __init__(self, chars: np.ndarray, ends: np.ndarray, pieces: Pieces):
        n = len(chars)
        place, h = np.arange(n), np.zeros(n, np.uint64)
        starts, lengths, ids = [], [], []
        single = np.zeros(n, bool)
        for length in range(1, max(pieces.longest, 1) + 1):
            inside = place + length <= ends[place]
            place, h = place[inside], h[inside]
            if not len(place):
                break
            h = step(h, chars[place + length - 1].astype(np.uint64))
            piece = pieces.lookup(h)
            hit = piece >= 0
            starts.append(place[hit])
            lengths.append(np.full(hit.sum(), length))
            ids.append(piece[hit])
            if length == 1:
                single[place[hit]] = True
            place, h = place[piece != -2], h[piece != -2]
        other = np.flatnonzero(~single)  # characters that are no piece: their bytes
        starts.append(other)
        lengths.append(np.ones(len(other), np.int64))
        ids.append(np.full(len(other), -1))
        start, length, piece = np.concatenate(starts), np.concatenate(lengths), np.concatenate(ids)
        order = np.argsort(start * (pieces.longest + 1) - length)  # no two edges of a node are equally long
        self.start, self.length, self.piece = start[order], length[order], piece[order]
        self.char = np.where(chars == LITERAL, BLANK, chars)
        self.bytes = np.where(self.piece < 0, utf8_length(self.char[self.start]), 1)
        weight = np.where(self.piece < 0, self.bytes * pieces.byte_weight, pieces.weights[self.piece])
        self.first = np.searchsorted(self.start, np.arange(n + 1))
        # Log mass from each node to its unit's end, nodes nearest to the end first.
        mass = np.zeros(n + 1)
        left = ends - np.arange(n)
        to = self.start + self.length
        at_end = to == ends[self.start]
        far = left[self.start]
        by_left = np.argsort(far.astype(np.int16) if left.max(initial=0) < 1 << 15 else far, kind="stable")
        cuts = np.append(0, np.cumsum(np.bincount(far, minlength=left.max(initial=0) + 1)))[1:]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            e = by_left[a:b]
            value = weight[e] + np.where(at_end[e], 0.0, mass[np.minimum(to[e], n)])
            node = self.start[e]
            heads = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            top = np.maximum.reduceat(value, heads)
            sums = np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(heads, len(e))))), heads)
            mass[node[heads]] = top + np.log(sums)
        self.log = weight + np.where(at_end, 0.0, mass[np.minimum(to, n)]) - mass[self.start]
        self.p = np.exp(self.log)
        total = np.cumsum(self.p)
        before = np.append(0.0, total)[self.first[self.start]]
        self.cum = total - before
        degree = np.diff(self.first)[self.start]
        self.log_other = np.full(len(self.p), -np.inf)
        several = degree > 1
        self.log_other[several] = np.log(np.maximum(1 - self.p[several], 1e-15))
        self.to, self.last, self.degree = to, at_end, degree

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Random ways from nodes to their units' ends: (number of the walk, step, edge), in this order."""
        walk, steps = np.arange(len(node)), []
        k = 0
        while len(walk):
            u = uniform(key[walk], k)
            edge = self.first[node[walk]]
            final = self.first[node[walk] + 1] - 1
            todo = np.flatnonzero((u > self.cum[edge]) & (edge < final))
            while len(todo):
                edge[todo] += 1
                todo = todo[(u[todo] > self.cum[edge[todo]]) & (edge[todo] < final[todo])]
            steps.append((walk, edge))
            node[walk] = self.to[edge]
            walk = walk[~self.last[edge]]
            k += 1
        count = np.bincount(np.concatenate([w for w, _ in steps]), minlength=len(node)) if steps else np.zeros(0, np.int64)
        offset = np.append(0, np.cumsum(count))
        edges = np.empty(offset[-1], np.int64)
        for k, (w, e) in enumerate(steps):
            edges[offset[w] + k] = e
        return offset, edges, count


def utf8_length(c: np.ndarray) -> np.ndarray:
    return 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)


def uniform(key: np.ndarray, number: int | np.ndarray) -> np.ndarray:
    """Random numbers between 0 and 1, a function of key and number."""
    x = mix(key + np.asarray([number]).astype(np.uint64).reshape(-1) * _KEY)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def truncated(log_mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values with these log masses as locations, given that they are under `bound`."""
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(np.isneginf(log_mass), -np.inf, -np.logaddexp(-bound, np.log(-np.log(u)) - log_mass))


class Sample:
    """One segmentation of each of some texts: the edges in order, and the regions that leave it at each edge."""

    def __init__(self, texts: np.ndarray, offset: np.ndarray, edges: np.ndarray, units: np.ndarray, lattice: Lattice, gumbel: np.ndarray, key: np.ndarray, number: int, branch: np.ndarray | None = None, taken: np.ndarray | None = None):
        """branch: the edge from which on the regions are this sample's own; taken: edges (a row for each text, -1 for
        none) that other samples took at that node."""
        self.texts, self.offset, self.edges, self.units, self.gumbel = texts, offset, edges, units, gumbel
        n = np.diff(offset)
        text = np.repeat(np.arange(len(texts)), n)
        log = lattice.log[edges]
        total = np.append(0.0, np.cumsum(log))
        before = total[:-1] - np.repeat(total[offset[:-1]], n)
        self.log_prob = total[offset[1:]] - total[offset[:-1]]
        mass = before + lattice.log_other[edges]
        self.taken = np.full((len(texts), 1), -1) if taken is None else taken
        self.branch = np.zeros(len(texts), np.int64) if branch is None else branch
        if branch is not None:
            at = offset[:-1] + branch
            mass[np.arange(len(edges)) < np.repeat(at, n)] = -np.inf
            out = np.append(taken, edges[at][:, None], 1)
            p = np.where(out >= 0, lattice.p[out], 0.0).sum(1)
            left = lattice.degree[edges[at]] > (out >= 0).sum(1)
            with np.errstate(divide="ignore"):
                mass[at] = np.where(left, before[at] + np.log(np.maximum(1 - p, 1e-15)), -np.inf)
        place = np.arange(len(edges)) - np.repeat(offset[:-1], n)
        self.values = np.full(len(edges), -np.inf)
        some = np.flatnonzero(~np.isneginf(mass))
        self.values[some] = truncated(mass[some], gumbel[text[some]], uniform(mix(key + np.uint64(1000 + number))[text[some]], place[some]))

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """(value, place) of each text's best region."""
        n = np.diff(self.offset)
        top = np.full(len(n), -np.inf)
        some = n > 0
        if some.any():
            top[some] = np.maximum.reduceat(self.values, self.offset[:-1][some])
        hit = np.flatnonzero(self.values == np.repeat(top, n))
        text = np.repeat(np.arange(len(n)), n)[hit]
        place = np.zeros(len(n), np.int64)
        place[text[::-1]] = hit[::-1]
        return top, place - self.offset[:-1]


def sample_texts(texts: list[str], keys: np.ndarray, pieces: Pieces, samples: int = SAMPLES):
    """Yields, for each text and sample, (text, number from 1, ids, log probability, perturbed value, inclusion score)."""
    joined = "".join([" " + t for t in texts if t])
    raw = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
    size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    bounds = np.append(0, np.cumsum(size))
    at = np.arange(len(raw))
    chars = np.where(raw == BLANK, LITERAL, np.where(raw == 0x20, BLANK, raw))
    # A unit starts where no edge can cross.
    number, begin = pieces.number[chars], np.ones(len(raw), bool)
    begin[1:] = ~pieces.beside[number[:-1], number[1:]]
    begin[bounds[:-1][size > 0]] = True
    starts = np.flatnonzero(begin)
    lengths = np.diff(np.append(starts, len(raw)))

    # Equal units share a lattice.
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(lengths.max(initial=0), _KEY)))
    place = at - np.repeat(starts, lengths)
    h = np.add.reduceat(mix(chars.astype(np.uint64) + np.uint64(1)) * power[place], starts) if len(starts) else np.zeros(0, np.uint64)
    numbered = pa.array(h).dictionary_encode()
    kind, which = numbered.indices.to_numpy(), np.empty(len(numbered.dictionary), np.int64)
    which[kind[::-1]] = np.arange(len(h) - 1, -1, -1)
    kind_len = lengths[which]
    kind_start = np.append(0, np.cumsum(kind_len))
    inside = np.repeat(starts[which] - kind_start[:-1], kind_len) + np.arange(kind_start[-1])
    lattice = Lattice(chars[inside], np.repeat(kind_start[1:], kind_len), pieces)
    node = kind_start[:-1][kind]
    text_unit = np.searchsorted(starts, bounds)
    unit_text = np.repeat(np.arange(len(texts)), np.diff(text_unit))
    unit_place = np.arange(len(starts)) - text_unit[unit_text]

    keys = mix(keys)
    found: list[Sample] = []
    everyone = np.arange(len(texts))
    walk_key = lambda number: mix(keys[unit_text] + np.uint64(number)) + unit_place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    offset, edges, count = lattice.walk(node.copy(), walk_key(1))
    root = -np.log(-np.log(uniform(mix(keys + np.uint64(77)), 0)))
    found.append(Sample(everyone, offset[text_unit], edges, np.repeat(np.arange(len(starts)), count), lattice, root, keys, 1))
    rows = {1: found[0]}
    spare = np.full(len(texts), -np.inf)
    for number in range(2, samples + 2):
        value, owner, place = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for s, sample in enumerate(found):
            top, p = sample.best()
            t = sample.texts
            better = top > value[t]
            value[t[better]], owner[t[better]], place[t[better]] = top[better], s, p[better]
        if number > samples:
            spare = value
            break
        going = np.flatnonzero(~np.isneginf(value))
        if not len(going):
            break
        sample = _branch(found, going, owner, place, value, lattice, node, text_unit, walk_key(number), keys, number)
        found.append(sample)
        rows[number] = sample
    for number, sample in rows.items():
        ids, cuts = _ids(sample, lattice, pieces)
        inclusion = np.where(np.isneginf(spare[sample.texts]), 1.0, -np.expm1(-np.exp(np.minimum(sample.log_prob - spare[sample.texts], 700))))
        for k, t in enumerate(sample.texts.tolist()):
            yield t, number, ids[cuts[k] : cuts[k + 1]], float(sample.log_prob[k]), float(sample.gumbel[k]), float(inclusion[k])


def _branch(found: list[Sample], going, owner, place, value, lattice: Lattice, node, text_unit, walk_key, keys, number: int) -> Sample:
    """The next segmentation of the texts `going`: that of the region (owner, place), with value `value`."""
    parts, texts_of, branch_of, taken_of = [], [], [], []
    for s, sample in enumerate(found):
        mine = going[owner[going] == s]
        if not len(mine):
            continue
        row = np.searchsorted(sample.texts, mine)
        cut = sample.offset[row] + place[mine]
        old = sample.edges[cut]
        same = place[mine] == sample.branch[row]
        taken = np.append(np.where(same[:, None], sample.taken[row], -1), old[:, None], 1)
        sample.values[cut] = -np.inf  # what remains of this region is the new sample's
        # Another edge of the same node, by its probability among those not taken.
        first, width = lattice.first[lattice.start[old]], lattice.degree[old]
        options = first[:, None] + np.arange(width.max())
        valid = np.arange(width.max()) < width[:, None]
        options = np.where(valid, options, first[:, None])
        p = np.where(valid & ~(options[:, :, None] == taken[:, None, :]).any(2), lattice.p[options], 0.0)
        cum = np.cumsum(p, 1)
        u = uniform(mix(keys[mine] + np.uint64(2000 + number)), 0) * cum[:, -1]
        pick = np.minimum((cum < u[:, None]).sum(1), width - 1)
        pick = np.where(p[np.arange(len(mine)), pick] > 0, pick, p.argmax(1))
        edge = options[np.arange(len(mine)), pick]
        # Up to the cut as before, the new edge, on to the unit's end, then new ways through all later units.
        unit = sample.units[cut]
        rest = text_unit[mine + 1] - unit - 1
        later = np.repeat(unit + 1 - np.append(0, np.cumsum(rest))[:-1], rest) + np.arange(rest.sum())
        open_unit = ~lattice.last[edge]
        walks = np.concatenate([unit[open_unit], later])
        start = np.concatenate([lattice.to[edge][open_unit], node[later]])
        offset, edges, count = lattice.walk(start, walk_key[walks])
        walker = np.concatenate([np.flatnonzero(open_unit), np.repeat(np.arange(len(mine)), rest)])
        kept = place[mine]
        # Each text's edges: those kept, the new one, and those of its walks in order.
        more = np.bincount(walker, count, len(mine)).astype(np.int64)
        begin = np.append(0, np.cumsum(kept + 1 + more))
        kept_at, old_at = _runs(begin[:-1], kept), _runs(sample.offset[row], kept)
        order = np.argsort(walker, kind="stable")
        walk_at = np.empty(len(walks), np.int64)
        walk_at[order] = np.cumsum(count[order]) - count[order]
        walk_at += (begin[:-1] + kept + 1 - np.cumsum(more) + more)[walker]
        all_edges, all_units = np.empty(begin[-1], np.int64), np.empty(begin[-1], np.int64)
        new_at = _runs(walk_at, count)
        for out, old, one, new in ((all_edges, sample.edges, edge, edges), (all_units, sample.units, unit, np.repeat(walks, count))):
            out[kept_at], out[begin[:-1] + kept], out[new_at] = old[old_at], one, new
        parts.append((begin, all_edges, all_units))
        texts_of.append(mine)
        branch_of.append(kept)
        taken_of.append(taken)
    texts = np.concatenate(texts_of)
    by_text = np.argsort(texts)
    size = np.concatenate([np.diff(begin) for begin, _, _ in parts])
    offset = np.append(0, np.cumsum(size[by_text]))
    at = np.empty(len(texts), np.int64)
    at[by_text] = offset[:-1]
    at = _runs(at, size)
    edges, units = np.empty(offset[-1], np.int64), np.empty(offset[-1], np.int64)
    edges[at], units[at] = np.concatenate([e for _, e, _ in parts]), np.concatenate([u for _, _, u in parts])
    texts = texts[by_text]
    width = max(t.shape[1] for t in taken_of)
    taken = np.concatenate([np.pad(t, ((0, 0), (0, width - t.shape[1])), constant_values=-1) for t in taken_of])
    return Sample(texts, offset, edges, units, lattice, value[texts], keys[texts], number, np.concatenate(branch_of)[by_text], taken[by_text])


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _ids(sample: Sample, lattice: Lattice, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The samples' ids one after the other, and where each begins."""
    count = lattice.bytes[sample.edges]
    out = np.repeat(lattice.piece[sample.edges], count)
    ends = np.append(0, np.cumsum(count))
    loose = out < 0
    if loose.any():
        char = np.repeat(lattice.char[lattice.start[sample.edges]], count)[loose]
        total = np.repeat(count, count)[loose]
        k = (np.arange(len(out)) - np.repeat(ends[:-1], count))[loose]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[total]
        tail = char >> (6 * (total - 1 - k))
        out[loose] = pieces.byte_ids[np.where(total == 1, char, np.where(k == 0, lead | tail, 0x80 | (tail & 0x3F)))]
    return out, ends[sample.offset]


_pieces: dict[tuple[str, float], Pieces] = {}


def load_pieces(path: str, temperature: float = 1.0) -> Pieces:
    if (path, temperature) not in _pieces:
        _pieces[path, temperature] = Pieces(path, temperature)
    return _pieces[path, temperature]


def sample_segmentations(df: DataFrame, model: str, samples: int = SAMPLES, temperature: float = 1.0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Up to `samples` rows per row of `df`: id, sample (from 1), n_pieces, ids_crc32, log_prob, perturbed, inclusion and, if
    asked for, ids.

    perturbed falls with the sample's number; inclusion is the probability of being among the samples given the
    value of the first segmentation left out, 1 if there is none.  A text with fewer segmentations has fewer rows; a
    null or empty text has one, without pieces.  All draws follow from the row's id, so repeated rows get the same
    samples.  Other columns are not looked at; an empty table gives an empty result.
    """
    fields = [("sample", T.IntegerType()), ("n_pieces", T.LongType()), ("ids_crc32", T.LongType()), ("log_prob", T.DoubleType()), ("perturbed", T.DoubleType()), ("inclusion", T.DoubleType())]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(n, t) for n, t in fields)] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches):
        pieces = load_pieces(model, temperature)
        for b in batches:
            keys, first = b.column(2).to_numpy().view(np.uint64), 0
            ends = np.append(0, np.cumsum(pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy()))
            while first < b.num_rows:  # a slice's texts at a time
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_CHARS, "right")) - 1)
                texts = [t or "" for t in b.column(1).slice(first, last - first).to_pylist()]
                rows = [(first + t, n, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *more, ids.astype(np.int32) if with_ids else None) for t, n, ids, *more in sample_texts(texts, keys[first:last], pieces, samples)]
                c = list(zip(*rows, strict=True))
                arrays = [b.column(0).take(pa.array(c[0], pa.int64())), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), *(pa.array(c[k], pa.float64()) for k in (4, 5, 6))]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(c[7], pa.list_(pa.int32()))] * with_ids, names=schema.names)
                first = last

    return df.select(id_col, text_col, F.xxhash64(id_col)).mapInArrow(run, schema)


def decode_segmentations(segmentations: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """`segmentations` with the text of each row's ids in place of the ids.

    Bytes that are no UTF-8 become U+FFFD; no ids give an empty text, null ids a null one, and an id that the model
    hasn't is an error.  Other columns stay as they are, repeated rows too; an empty table gives an empty result.
    """
    rest = [c for c in segmentations.columns if c not in (ids_col, text_col)]
    schema = T.StructType([*(segmentations.schema[c] for c in rest), T.StructField(text_col, T.StringType())])

    def run(batches):
        pieces = load_pieces(model)
        for b in batches:
            column, sizes, first = b.column(len(rest)), pc.fill_null(pc.list_value_length(b.column(len(rest))), 0).to_numpy(), 0
            while first < b.num_rows:  # a row's ids at a time, some 2^18 a slice
                last = max(first + 1, first + int(np.searchsorted(np.cumsum(sizes[first:]), 1 << 18, "right")))
                texts = [pieces.decode(column[i].values.to_pylist()) if column[i].is_valid else None for i in range(first, min(last, b.num_rows))]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(first, len(texts)) for k in range(len(rest))), pa.array(texts, pa.string())], names=schema.names)
                first = last

    return segmentations.select(*rest, ids_col).mapInArrow(run, schema)
