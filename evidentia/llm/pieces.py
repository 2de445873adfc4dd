r"""SentencePiece encoding and decoding with segmentations sampled without replacement.

The vocabulary of a SentencePiece model spans a lattice over each text; a piece's weight is a Zipf
prior on its rank in the vocabulary (no model is trained). Perturbed A-star search draws distinct
segmentations: the root's bound is a Gumbel variate, the branch taken at a node keeps its node's
bound, and what is left of the node gets a bound of its own, truncated at it. The largest bound left
is opened next, so samples come out by decreasing perturbed log-probability, without replacement.
With kappa the largest bound left after the last sample, 1 - exp(-exp(log p - kappa)) is a sample's
inclusion score. All variates are hashes of the row's key, the sample's number and the position, so
they depend neither on the run nor on what else is in a batch.

No piece has a space after another character or a line feed, so the lattice is a chain of small
lattices of units between such places; those of distinct units are built once for SHARED rows. What may
follow a place depends on the rest of its unit only, so units that end alike share the nodes of their ends.

Spaces are marked as U+2581 and a first one is added; characters without a piece, and U+2581 itself,
are written as bytes, so decoding gives every text back exactly.

Defined cases: null text counts as empty; an empty text has one segmentation, without pieces; texts
with fewer segmentations than asked give all they have, with inclusion 1; rows that repeat a key and
a text give the same samples; of equal bounds (none in practice) the earliest sample's and then the
earliest place's is opened; very long texts are segmented whole; extra columns are not read and may have
any name; an empty table gives an empty result. Weights are a prior on rank since a BPE model's own
scores are merge ranks, not log-probabilities.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SEED = "pieces"
#: Rows that are sampled at once, rows that share the lattices of their units.
BATCH = 300
SHARED = 300

_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def _roll(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    h = (h + points + np.uint64(1)) * _P
    h ^= h >> np.uint64(29)
    return h


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Vocabulary:
    """Pieces, their weights, and prefix tables for lookup by length."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.bytes_at = next(i for i in range(n) if sp.is_byte(i))
        self.strings = [sp.id_to_piece(i).encode().replace("▁".encode(), b" ") if not sp.is_byte(i) else bytes([int(sp.id_to_piece(i)[3:-1], 16)]) for i in range(n)]
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.logp = np.zeros(n)
        self.logp[usable] = -np.log(np.arange(len(usable)) + 2.7)
        self.logp[usable] -= np.log(np.exp(self.logp[usable]).sum())
        self.byte_logp = float(self.logp[usable].min()) - 2.0
        tables: dict[int, dict[int, int]] = {}
        for i in usable:
            points = _points(sp.id_to_piece(i)).astype(np.uint64)
            h = np.zeros(1, np.uint64)
            for length, point in enumerate(points, 1):
                h = _roll(h, point)
                own = tables.setdefault(length, {})
                if length == len(points):
                    own[int(h[0])] = i
                else:
                    own.setdefault(int(h[0]), -1)
        self.tables = []
        for length in sorted(tables):
            keys = np.array(sorted(tables[length]), dtype=np.uint64)
            self.tables.append(Table(keys, np.array([tables[length][int(k)] for k in keys], dtype=np.int32)))

    def decode(self, ids) -> str:
        text = b"".join([self.strings[i] for i in ids]).decode()
        return text[1:] if text[:1] == " " else text

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The texts in UTF-8 whose ids lie between the bounds."""
        taken = pa.array(self.strings, pa.large_binary()).take(pa.array(ids))
        _, offsets, data = taken.buffers()
        data = memoryview(data or b"")
        ends = np.frombuffer(offsets, np.int64)[bounds].tolist()
        return [data[a + (data[a : a + 1] == b" ") : b] if a < b else data[a:a] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Table:
    """Hashes of prefixes of one length, found by the place where their leading bits begin."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray):
        self.ids = np.append(ids, np.int32(-1))
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        bits = (2 * len(keys)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(keys >> self.shift, np.arange(2**bits, dtype=np.uint64))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or one with another key."""
        at = self.start[h >> self.shift]
        more = np.flatnonzero(self.keys[at] < h)
        while len(more):
            at[more] += 1
            more = more[self.keys[at[more]] < h[more]]
        return at


def _suffix_hashes(points: np.ndarray, remaining: np.ndarray) -> np.ndarray:
    powers = np.full(int(remaining.max(initial=0)) + 1, _P)
    np.cumprod(powers, out=powers)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(points + np.uint64(1)) * powers[remaining])])
    return run[np.arange(len(points)) + remaining] - run[:-1]


def _suffixes(points: np.ndarray, remaining: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By character, the number of the rest of its unit, equal rests alike and short ones first; by number, a character."""
    c = np.arange(len(points))
    number = pa.array(_suffix_hashes(points, remaining)).dictionary_encode().indices.to_numpy().astype(np.int64)
    head = np.zeros(int(number.max(initial=-1)) + 1, dtype=np.int64)
    head[number[::-1]] = c[::-1]
    like = head[number]
    after = np.append(number, 0)
    if not ((points == points[like]) & (remaining == remaining[like]) & ((remaining == 1) | (after[c + 1] == after[like + 1]))).all():
        number = head = c  # two rests have one hash: none are shared
    distance = remaining[head]
    order = np.argsort(distance.astype(np.uint16) if distance.max(initial=0) < 65536 else distance, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank[number], head[order]


class Lattice:
    """The lattices of distinct units: edges sorted by source and length; nodes are distinct ends of units, short ones first."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, vocab: Vocabulary):
        ends = np.cumsum(sizes)
        remaining = np.repeat(ends, sizes) - np.arange(len(points))
        number, head = _suffixes(points, remaining)
        self.start = number[ends - sizes]
        self.points = points[head].astype(np.uint32)
        marked = np.where(points == 0x2581, np.uint64(0xD800), points)
        marked[points == 0x20] = 0x2581
        remaining = remaining[head]
        nodes = len(head)
        live, h = np.arange(nodes), np.zeros(nodes, np.uint64)
        src, piece = [], []
        for n, table in enumerate(vocab.tables, 1):
            keep = remaining[live] >= n
            live, h = live[keep], h[keep]
            h = _roll(h, marked[head[live] + (n - 1)])
            at = table.find(h)
            found = table.keys[at] == h
            if n == 1:  # every node has an edge of one character, if only by its bytes
                src.append(live)
                piece.append(np.where(found, table.ids[at], -1).astype(np.int32))
            live, h, at = live[found], h[found], at[found]
            if n > 1:
                own = table.ids[at]
                hit = own >= 0
                src.append(live[hit])
                piece.append(own[hit])
            if not len(live):
                break
        self.degree = np.bincount(np.concatenate(src), minlength=nodes)
        after = np.cumsum(self.degree)
        self.first = after - self.degree
        edges = int(after[-1])
        self.src = np.repeat(np.arange(nodes), self.degree)
        self.piece, self.length = np.empty(edges, dtype=np.int32), np.empty(edges, dtype=np.int16)
        free = self.first.copy()
        for n, (of, own) in enumerate(zip(src, piece, strict=True), 1):
            at = free[of]
            self.piece[at], self.length[at] = own, n
            free[of] += 1
        self.last = remaining[self.src] == self.length
        self.target = np.append(number, nodes)[np.where(self.last, len(number), head[self.src] + self.length)]
        bare = np.flatnonzero(self.piece < 0)
        x = self.points[self.src[bare]]
        self.n_tokens = np.ones(edges, dtype=np.int8)
        self.n_tokens[bare] += (x > 0x7F).astype(np.int8) + (x > 0x7FF) + (x > 0xFFFF)
        self.weight = vocab.logp[self.piece]
        self.weight[bare] = self.n_tokens[bare] * vocab.byte_logp
        beta = np.zeros(nodes + 1)
        self.levels = []  # nodes by distance to the end: nodes, edges, first edge of each node
        bounds = np.searchsorted(remaining, np.arange(1, int(remaining[-1]) + 2)).tolist()
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            if x < y:
                edges = slice(int(self.first[x]), int(after[y - 1]))
                own = self.first[x:y] - edges.start
                beta[x:y] = np.logaddexp.reduceat(self.weight[edges] + beta[self.target[edges]], own)
                self.levels.append((slice(x, y), edges, own))
        self.q = self.weight + beta[self.target] - beta[self.src]
        p = np.exp(self.q)
        self.left = np.log(np.maximum(1.0 - p, 0.0), out=np.full(len(p), -np.inf), where=(self.degree[self.src] > 1) & (p < 1.0))
        self.upto = p  # summed within each source on its own, so it does not depend on other units
        later = np.flatnonzero(self.degree > 1)
        for k in range(1, int(self.degree.max())):
            later = later[self.degree[later] > k]
            at = self.first[later] + k
            self.upto[at] += self.upto[at - 1]
        self.upto[after - 1] = np.inf

    def best(self) -> np.ndarray:
        """The first edge of the path of largest weight from each character to its unit's end."""
        most, best = np.zeros(len(self.points) + 1), np.zeros(len(self.points), dtype=np.int64)
        for nodes, edges, heads in self.levels:
            value = self.weight[edges] + most[self.target[edges]]
            top = most[nodes] = np.maximum.reduceat(value, heads)
            is_top = edges.start + np.flatnonzero(value == np.repeat(top, self.degree[nodes]))[::-1]
            best[self.src[is_top]] = is_top
        return best

    def draw(self, node: np.ndarray, uniform) -> np.ndarray:
        """An edge of each node, by its share of the node's mass; uniform gives the variates of some of the nodes."""
        edge = self.first[node]
        upto = self.upto[edge]
        more = np.flatnonzero(upto < 1.0)
        u = uniform(more)
        later = upto[more] < u
        while len(more):
            more, u = more[later], u[later]
            edge[more] += 1
            later = self.upto[edge[more]] < u
        return edge


def _uniform(seed: np.ndarray, sample: int, place: np.ndarray, kind: int) -> np.ndarray:
    turn = np.uint64((sample + 1) * int(_P) % 2**64)
    x = _mix(seed + _mix(place.astype(np.uint64) * np.uint64(8) + np.uint64(kind)) + turn)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Units:
    """The chains of units of several texts, and the lattices of the distinct ones."""

    def __init__(self, texts: pa.Array | list[str | None], vocab: Vocabulary):
        self.vocab = vocab
        texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()), "")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        data, bounds = _bytes(texts)
        space, line = data == 0x20, data == 0x0A
        head = line.copy()
        head[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        head[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        begin = np.flatnonzero(head)
        self.begin = np.searchsorted(begin, bounds)
        self.n_units = np.diff(self.begin)
        units = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data))
        coded = units.dictionary_encode()
        self.unit = coded.indices.to_numpy().astype(np.int64)
        data, bounds = _bytes(coded.dictionary)
        self.sizes = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds])
        self.lattice = Lattice(_points(data.tobytes().decode()).astype(np.uint64), self.sizes, vocab) if len(begin) else None


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings, and where each begins (and the last ends)."""
    _, offsets, data = strings.buffers()
    bounds = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places from each start to its end."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class Batch:
    """The unit chains of texts `first` to `last` of several."""

    def __init__(self, units: Units, first: int, last: int):
        self.vocab, self.lattice = units.vocab, units.lattice
        self.n_units = units.n_units[first:last]
        self.unit = units.unit[units.begin[first] : units.begin[last]]
        self.doc = np.repeat(np.arange(last - first), self.n_units)
        sizes = units.sizes[self.unit]
        self.base = np.cumsum(sizes) - sizes  # place of a unit in the batch's characters
        self.n = int(sizes.sum())
        per_doc = np.bincount(self.doc, weights=sizes, minlength=last - first).astype(np.int64)
        self.doc_start = np.cumsum(per_doc) - per_doc
        self.doc_end = self.doc_start + per_doc

    def walk(self, path: np.ndarray, node: np.ndarray, place: np.ndarray, choose) -> None:
        """Follow edges from every node to its unit's end, noting them in path by place."""
        lat = self.lattice
        while len(node):
            edge = choose(node, place)
            path[place] = edge
            on = ~lat.last[edge]
            edge = edge[on]
            node, place = lat.target[edge], place[on] + lat.length[edge]

    def best(self) -> np.ndarray:
        path = np.full(self.n, -1, dtype=np.int64)
        if self.n:
            best = self.lattice.best()
            self.walk(path, self.lattice.start[self.unit], self.base, lambda node, place: best[node])
        return path

    def samples(self, seeds: np.ndarray, count: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By sample: path, docs that have it, log-probability, perturbed value; the last entry has only the bounds left."""
        lat, docs = self.lattice, len(self.n_units)
        owner = np.repeat(np.arange(docs), self.doc_end - self.doc_start)
        own_place = np.arange(self.n) - self.doc_start[owner]
        bound = -np.log(-np.log(_uniform(seeds, 0, np.zeros(docs, np.int64), 7)))
        path = np.full(self.n, -1, dtype=np.int64)
        have = np.ones(docs, dtype=bool)
        pools: list[dict] = []
        out = []
        from_place, node, place = self.doc_start.copy(), None, None
        for number in range(count):
            if self.n:
                if number == 0:
                    node, place = lat.start[self.unit], self.base
                def pick(node, place, k=number):
                    return lat.draw(node, lambda some: _uniform(seeds[owner[place[some]]], k, own_place[place[some]], 0))

                self.walk(path, node, place, pick)
            at = np.flatnonzero(path >= 0)
            edge, of = path[at], owner[at] if self.n else np.zeros(0, np.int64)
            q = lat.q[edge] if self.n else np.zeros(0)
            run = np.concatenate([[0.0], np.cumsum(q)])
            heads = np.searchsorted(of, np.arange(docs + 1))
            logp = np.zeros(docs)
            some = np.flatnonzero(heads[1:] > heads[:-1])
            if len(some):
                logp[some] = np.add.reduceat(q, heads[some])  # a text's own sum, whatever else is in the batch
            out.append((path.copy(), have.copy(), logp, bound.copy()))
            # what is left of each new node on the path
            new = np.flatnonzero((at >= from_place[of]) & have[of] & (lat.left[edge] > -np.inf)) if self.n else np.zeros(0, np.int64)
            before = run[new] - run[heads[of[new]]]
            phi = before + lat.left[edge[new]] if self.n else np.zeros(0)
            top = bound[of[new]]
            u = _uniform(seeds[of[new]], number, own_place[at[new]], 1) if self.n else np.zeros(0)
            pools.append({"g": phi - np.log(np.exp(np.minimum(phi - top, 700)) - np.log(u)), "at": at[new], "before": before, "doc": of[new], "path": out[-1][0], "gone": np.zeros(0, np.int64)})
            # open the largest bound
            best = np.full(docs, -np.inf)
            best_pool, best_row = np.full(docs, -1), np.full(docs, -1)
            for i, pool in enumerate(pools):
                if not len(pool["g"]):
                    continue
                heads = np.flatnonzero(np.concatenate([[True], pool["doc"][1:] != pool["doc"][:-1]]))
                top = np.maximum.reduceat(pool["g"], heads)
                whose = pool["doc"][heads]
                row = np.flatnonzero(pool["g"] == np.repeat(top, np.diff(np.append(heads, len(pool["g"])))))
                first = np.full(docs, -1)
                first[pool["doc"][row[::-1]]] = row[::-1]
                better = top > best[whose]
                best[whose[better]], best_pool[whose[better]], best_row[whose[better]] = top[better], i, first[whose[better]]
            bound, have = best, best > -np.inf
            if number + 1 < count:
                node, place = self._open(pools, path, from_place, seeds, number + 1, bound, have, best_pool, best_row)
        out.append((None, have, None, bound))
        return out

    def _open(self, pools, path, from_place, seeds, number, bound, have, best_pool, best_row):
        """Set path to each doc's opened branch up to its node; return the nodes to walk on from."""
        lat = self.lattice
        after = np.full(len(self.n_units), self.n + 1, dtype=np.int64)
        nodes, stops = [], []
        for i, pool in enumerate(pools):
            docs = np.flatnonzero(have & (best_pool == i))
            if not len(docs):
                continue
            row = best_row[docs]
            at = pool["at"][row]
            taken = pool["path"][at]
            node = lat.src[taken]
            if i != number - 1:
                own = _ranges(self.doc_start[docs], self.doc_end[docs])
                path[own] = pool["path"][own]
            # the edges of each node, one row a doc; those taken before have no mass
            first, degree = lat.first[node], lat.degree[node]
            column = np.arange(int(degree.max()))
            edges = first[:, None] + np.minimum(column, degree[:, None] - 1)
            codes = row[:, None] * len(lat.src) + edges
            gone = (edges == taken[:, None]) | np.isin(codes, pool["gone"])
            free = (column < degree[:, None]) & ~gone
            mass = np.where(free, np.exp(lat.q[edges]), 0.0)
            upto = np.cumsum(mass, axis=1)
            whole, own_place = upto[:, -1], at - self.doc_start[docs]
            pick = np.argmax(upto >= (_uniform(seeds[docs], number, own_place, 2) * whole)[:, None], axis=1)
            each = np.arange(len(docs))
            chosen = edges[each, pick]
            pool["gone"] = np.concatenate([pool["gone"], codes[each, pick]])
            rest = whole - mass[each, pick]
            some = (free.sum(1) > 1) & (rest > 0)
            left = np.full(len(docs), -np.inf)
            phi = pool["before"][row[some]] + np.log(rest[some])
            u = _uniform(seeds[docs[some]], number, own_place[some], 3)
            left[some] = phi - np.log(np.exp(np.minimum(phi - bound[docs[some]], 700.0)) - np.log(u))
            pool["g"][row] = left
            path[_ranges(at, self.doc_end[docs])] = -1
            path[at] = chosen
            stop = at + lat.length[chosen]
            from_place[docs], after[docs] = at + 1, stop
            inner = ~lat.last[chosen]
            nodes.append(lat.target[chosen][inner])
            stops.append(stop[inner])
        later = self.base >= after[self.doc]
        nodes.append(lat.start[self.unit[later]] if self.n else np.zeros(0, np.int64))
        stops.append(self.base[later])
        return np.concatenate(nodes), np.concatenate(stops)

    def tokens(self, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All token ids along the path, and where each text's begin (and the last ends)."""
        if not self.n:
            return np.zeros(0, np.int32), np.zeros(len(self.n_units) + 1, np.int64)
        lat = self.lattice
        at = np.flatnonzero(path >= 0)
        edge = path[at]
        ids, n = lat.piece[edge], lat.n_tokens[edge]
        run = np.concatenate([[0], np.cumsum(n)])
        if (ids < 0).any():
            bare = np.flatnonzero(ids < 0)
            full = np.repeat(ids, n)
            text = lat.points[lat.src[edge[bare]]].tobytes().decode("utf-32-le")
            full[_ranges(run[bare], run[bare + 1])] = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.int32) + self.vocab.bytes_at
            ids = full
        return ids.astype(np.int32), run[np.searchsorted(at, np.append(self.doc_start, self.n))]


def row_seeds(keys: list, seed: str) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(f"{seed}:{k}") for k in keys), dtype=np.uint64, count=len(keys))


def encode_best(texts: list[str | None], vocab: Vocabulary) -> list[np.ndarray]:
    """The segmentation of largest weight of each text."""
    batch = Batch(Units(texts, vocab), 0, len(texts))
    ids, bounds = batch.tokens(batch.best())
    return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def samples(texts: pa.Array | list[str | None], keys: list, vocab: Vocabulary, count: int, seed: str) -> Iterator[tuple]:
    """(rows, sample from 1, all ids, where each row's begin, log-probabilities, perturbed ones, inclusion scores) of rows that have the sample."""
    units, seeds = Units(texts, vocab), row_seeds(keys, seed)
    for at in range(0, len(texts), BATCH):
        batch = Batch(units, at, min(at + BATCH, len(texts)))
        drawn = batch.samples(seeds[at : at + BATCH], count)
        kappa = np.where(drawn[-1][1], drawn[-1][3], -np.inf)
        for number, (path, have, logp, bound) in enumerate(drawn[:-1], 1):
            path[~np.repeat(have, batch.doc_end - batch.doc_start)] = -1
            ids, bounds = batch.tokens(path)
            with np.errstate(over="ignore"):
                score = np.where(np.isinf(kappa), 1.0, -np.expm1(-np.exp(np.minimum(logp - kappa, 700))))
            rows = np.flatnonzero(have)
            values = [[round(x, n) for x in column[rows].tolist()] for column, n in ((logp, 6), (bound, 6), (score, 9))]
            yield at + rows, number, ids, bounds[np.append(rows, len(have))], *values


def sample(texts: list[str | None], keys: list, vocab: Vocabulary, count: int = SAMPLES, seed: str = SEED) -> Iterator[tuple[int, int, np.ndarray, float, float, float]]:
    """(row, sample from 1, ids, log-probability, perturbed log-probability, inclusion score)."""
    for rows, number, ids, bounds, *values in samples(texts, keys, vocab, count, seed):
        for row, a, b, *own in zip(rows.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), *values, strict=True):
            yield row, number, ids[a:b], *own


def read_model(path: str = MODEL) -> Vocabulary:
    with open(path, "rb") as file:
        return Vocabulary(file.read())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SHARED):
            yield batch.slice(at, SHARED)


def encode(docs: DataFrame, model: str = MODEL, count: int = SAMPLES, seed: str = SEED, key: str = "doc_id") -> DataFrame:
    """doc_id, sample, ids, log_prob, perturbed, inclusion: up to count segmentations for every row of docs(doc_id, text)."""
    vocab = read_model(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in _slices(batches):
            keys = batch[key]
            for rows, number, ids, bounds, *values in samples(batch["text"], keys.to_pylist(), vocab, count, seed):
                columns = [keys.take(pa.array(rows)), pa.array(np.full(len(rows), number, np.int32)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.float64()) for x in values]], [key, "sample", "ids", "log_prob", "perturbed", "inclusion"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, sample int, ids array<int>, log_prob double, perturbed double, inclusion double")


def digests(docs: DataFrame, model: str = MODEL, count: int = SAMPLES, seed: str = SEED) -> DataFrame:
    """As encode, with the number of pieces and digests of ids (int32, little-endian) and decoded text for the ids."""
    vocab = read_model(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sha = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches):
        for batch in _slices(batches):
            keys = batch["doc_id"]
            for rows, number, ids, bounds, *values in samples(batch["text"], keys.to_pylist(), vocab, count, seed):
                own = [sha(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                decoded = [sha(text) for text in vocab.decode_all(ids, bounds)]
                columns = [keys.take(pa.array(rows)), pa.array(np.full(len(rows), number, np.int32)), pa.array(np.diff(bounds)), pa.array(own, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.float64()) for x in values]], ["doc_id", "sample", "n_pieces", "ids_sha256", "decoded_sha256", "log_prob", "perturbed", "inclusion"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, sample int, n_pieces long, ids_sha256 string, decoded_sha256 string, log_prob double, perturbed double, inclusion double"
    )


def op1_sentencepiece(spark, sf_dir):
    from .common import table

    return digests(table(spark, sf_dir, "documents"))
