r"""N-gram Jaccard join by PartEnum signatures, and its connected components.

A document is the set of its word shingles. Sets of one size band, with those just below it, form an
instance. Its feature domain is dealt into partitions of two parts, and the subsets of one part are
enumerated: more parts than the instance's similar sets can differ in, so similar sets agree in one.
A signature is a part's number and the sum of its features. A set of which similar sets differ in at
most k features emits its first k + 1 parts that have a feature: of a similar pair, take the one whose
emitted parts end first; at most k of its k + 1 parts differ, so one agrees, and the other set emits it
too. A set with too few such parts (parts are so many that this is rare) emits all, empty ones too.

Equal sets are collapsed first. A few signatures then find most copies: rows of one such signature are
compared with its most central one only, and the links found give components. All signatures follow,
as (signature, component), each once a batch. Only signatures of several components matter: the rows
behind them are named again, compared with their signature's most central one, and components grow.
Of what still has several components, every row that is not of a signature's largest component is
compared with all its other rows, in blocks: rows of the large component pass by and are held by no task.
Only pairs that two lower bounds of the Hamming distance allow leave a task: each set has a parity
sketch of about two bits a feature, and no more bits of two sketches differ than features of their
sets. All links are checked on the sets.

Shingles are compared by 64-bit hashes, equal sets by their size and two 64-bit sums.

Defined cases: null and empty texts have no shingles and link with nothing; fewer words than a
shingle form one shingle; rows without an id link with nothing and have no component; of rows that
share an id each is linked by its own text; very long texts are used whole; of extra columns, whatever
their names, join reads none and keep_one hands on all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, settings, temporary

BAND_RATIO = 1.5
SLICE = 500
#: Signatures of a set that look for copies first.
EARLY = 16
#: Rows of a block that is compared with the other rows of its signature.
BLOCK = 512
#: Rows that a task takes at once, and pairs that it compares at once.
GATHER = 100_000
PAIRS = 1_000_000
#: Bytes of a sketch that travels with signatures; longer ones are folded.
CARRIED = 256
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: Iterable[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words, sizes = [], []
    for text in texts:
        own = (text or "").encode().lower().split()
        words += own
        sizes.append(len(own))
    coded = pa.array(words, pa.binary()).dictionary_encode()
    distinct = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    h = distinct[coded.indices.to_numpy(zero_copy_only=False)] if words else np.zeros(0, np.uint64)
    n = len(h) - width + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for i in range(width):
        rolled = _mix(rolled * _GOLD + h[i : i + len(rolled)])
    out, at = [], 0
    for size in sizes:
        if size >= width:
            out.append(np.unique(rolled[at : at + size - width + 1]))
        elif size:
            short = np.zeros(1, np.uint64)
            for x in h[at : at + size]:
                short = _mix(short * _GOLD + x + np.uint64(size))
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def _bands(largest: int) -> np.ndarray:
    """Upper ends of the size bands."""
    ends = [1]
    while ends[-1] < largest:
        ends.append(max(ends[-1] + 1, int((ends[-1] + 1) * BAND_RATIO)))
    return np.array(ends, dtype=np.int64)


def signatures(sets: list[np.ndarray], percent: int, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of set, signature) for all sets, in order of sets; first limits them to so many of each set and instance."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not sizes.max(initial=0):
        return none
    ends = _bands(int(sizes.max()) * 2)
    own = np.searchsorted(ends, sizes)
    up = np.flatnonzero((sizes > 0) & (sizes * 100 // percent > ends[own]))
    doc = np.concatenate([np.flatnonzero(sizes > 0), up])
    band = np.concatenate([own[sizes > 0], own[up] + 1])
    k = (100 - percent) * (sizes[doc] + np.minimum(sizes[doc] * 100 // percent, ends[band])) // (100 + percent)
    some = k > 0  # with k = 0 only equal sets are similar
    doc, band, k = doc[some], band[some], k[some]
    if not len(doc):
        return none
    most = (100 - percent) * 2 * ends // (100 + percent) + 1
    bare = most * np.exp(-ends / most)
    parts = (most + 4 + np.ceil(bare + 3 * np.sqrt(bare)).astype(np.int64)) // 2 * 2
    n = parts[band]
    count = sizes[doc]
    flat = np.concatenate([sets[i] for i in doc])
    row = np.repeat(np.arange(len(doc)), count)
    dealt = _mix(flat + np.repeat(band.astype(np.uint64) + np.uint64(1000), count) * _GOLD)
    offset = np.concatenate([[0], np.cumsum(n)])
    cell = offset[row] + ((dealt >> np.uint64(8)) % np.repeat(n.astype(np.uint64), count)).astype(np.int64)
    order = np.argsort(cell)
    cell = cell[order]
    heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    filled = cell[heads]
    total = np.add.reduceat(_mix(flat[order] ^ _GOLD), heads)
    of = np.repeat(np.arange(len(doc)), n)[filled]
    at = np.searchsorted(of, np.arange(len(doc) + 1))
    rank = np.arange(len(of)) - at[of]
    have = np.diff(at)
    few = np.flatnonzero(have <= k)
    if len(few):  # these emit their empty parts as well
        missing = np.setdiff1d(np.concatenate([np.arange(offset[i], offset[i + 1]) for i in few]), filled, assume_unique=True)
        of = np.concatenate([of, np.repeat(np.arange(len(doc)), n)[missing]])
        rank = np.concatenate([rank, np.zeros(len(missing), np.int64)])
        filled, total = np.concatenate([filled, missing]), np.concatenate([total, np.zeros(len(missing), np.uint64)])
    wanted = k + 1 if first is None else np.minimum(k + 1, first)
    keep = rank < wanted[of]
    of, filled, total = of[keep], filled[keep], total[keep]
    place = (filled - offset[of]).astype(np.uint64)
    sig = _mix(_mix(band[of].astype(np.uint64) * np.uint64(1 << 32) + place) * _GOLD + total)
    order = np.argsort(doc[of], kind="stable")
    return doc[of][order], sig[order]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def parity_sketch(features: np.ndarray) -> bytes:
    """Bit i is the parity of the features that fall on it; a power of two of bits, about two a feature."""
    bits = 64
    while bits < 2 * len(features):
        bits *= 2
    odd = np.bincount((_mix(features ^ np.uint64(77)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_distance(x: bytes, y: bytes) -> int:
    """A lower bound of the Hamming distance of the sets behind two sketches; the longer is folded onto the shorter."""
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    if len(a) < len(b):
        a, b = b, a
    folded = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0) if len(a) > len(b) else a
    return int(np.bitwise_count(folded ^ b).sum())


def _signed(x) -> np.ndarray:
    return np.array(x, dtype=np.uint64).view(np.int64)


def _folded(sketch: bytes) -> bytes:
    if len(sketch) <= CARRIED:
        return sketch
    return np.bitwise_xor.reduce(np.frombuffer(sketch, dtype=np.uint64).reshape(-1, CARRIED // 8), axis=0).tobytes()


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        folded = pa.array([_folded(x) for x in batch["sketch"].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["rep"], batch["n_shingles"], folded], ["rep", "n_shingles", "carried"])


def _summaries(width: int, percent: int):
    """n_shingles, two sums that stand for the set, parity sketch and early signatures of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = shingle_sets(batch["text"].to_pylist(), width)
            one = [int(_mix(s).sum(dtype=np.uint64)) for s in sets]
            two = [int(_mix(s ^ _GOLD).sum(dtype=np.uint64)) for s in sets]
            row, sig = signatures(sets, percent, EARLY)
            bounds = np.searchsorted(row, np.arange(len(sets) + 1))
            early = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sig.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], pa.array([len(s) for s in sets], pa.int64()), pa.array(_signed(one)), pa.array(_signed(two)), pa.array([parity_sketch(s) for s in sets], pa.binary()), early], ["doc_id", "row", "n_shingles", "one", "two", "sketch", "early"])

    return run


def _signature_labels(width: int, percent: int):
    """(sig, label): the components behind each signature, each once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            labels = batch["label"].to_numpy(zero_copy_only=False)
            row, sig = signatures(shingle_sets(batch["text"].to_pylist(), width), percent)
            own, sig = labels[row], sig.view(np.int64)
            values, times = np.unique(labels, return_counts=True)
            often = np.flatnonzero(np.isin(own, values[times > 1]))
            order = often[np.lexsort((own[often], sig[often]))]
            keep = np.ones(len(sig), dtype=bool)
            keep[order[1:]] = (sig[order[1:]] != sig[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(own[keep], pa.int64())], ["sig", "label"])

    return run


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, label) sorted by both, the distinct ones whose sig has several labels."""
    sig, label, met = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the last row, and whether its sig had another label before
    for batch in _with_end(batches):
        if batch is None:
            if len(sig) and met:
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(label)], ["sig", "label"])
            return
        s = np.concatenate([sig, batch["sig"].to_numpy(zero_copy_only=False)])
        x = np.concatenate([label, batch["label"].to_numpy(zero_copy_only=False)])
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (x[1:] != x[:-1])
        s, x = s[new], x[new]
        as_before = np.zeros(len(s), dtype=bool)
        as_before[1:] = s[1:] == s[:-1]
        as_before[:1] |= met and len(sig) > 0
        out = as_before[:-1] | (s[1:] == s[:-1])
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(s[:-1][out]), pa.array(x[:-1][out])], ["sig", "label"])
        sig, label, met = s[-1:], x[-1:], bool(as_before[-1]) if len(s) else False


def _with_end(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def _signed_rows(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, labels = batch["doc_id"].to_numpy(zero_copy_only=False), batch["label"].to_numpy(zero_copy_only=False)
            row, sig = signatures(shingle_sets(batch["text"].to_pylist(), width), percent)
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids[row], pa.int64()), pa.array(labels[row], pa.int64())], ["sig", "doc", "label"])

    return run


def _least_distances(x: np.ndarray, y: np.ndarray, width: np.ndarray, where: np.ndarray, stacks: dict[int, np.ndarray]) -> np.ndarray:
    """least_distance of rows x and y, whose sketches are rows `where` of the stack of their width in words."""
    out = np.zeros(len(x), dtype=np.int64)
    both = width[x] * 10_000 + width[y]
    for pair in np.unique(both):
        own = np.flatnonzero(both == pair)
        a, b = stacks[pair // 10_000][where[x[own]]], stacks[pair % 10_000][where[y[own]]]
        if a.shape[1] < b.shape[1]:
            a, b = b, a
        if a.shape[1] > b.shape[1]:
            a = np.bitwise_xor.reduce(a.reshape(len(a), -1, b.shape[1]), axis=1)
        out[own] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    return out


def _compared(percent: int):
    """From blocks (key, doc, label, n, sketch, left, right, minor), sorted by key: pairs (a, b) that may link.

    Rows that are left meet all of their block that are right and have another label; two minor rows
    meet once.
    """

    def block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "doc", "label", "n", "left", "right", "minor")}
        sketches = rows["sketch"].to_pylist()
        width = np.array([len(s) // 8 for s in sketches], dtype=np.int64)
        where, stacks = np.zeros(len(width), dtype=np.int64), {}
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            where[own] = np.arange(len(own))
            stacks[int(w)] = np.frombuffer(b"".join([sketches[i] for i in own]), dtype=np.uint64).reshape(len(own), w)
        key, doc, label, n, minor = col["key"], col["doc"], col["label"], col["n"], col["minor"].astype(bool)
        left, right = np.flatnonzero(col["left"]), np.flatnonzero(col["right"])
        begin, end = np.searchsorted(key[right], key[left]), np.searchsorted(key[right], key[left], side="right")
        upto = np.cumsum(end - begin)
        done, found = 0, []
        while done < len(left):
            stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PAIRS, side="right")))
            sizes = (end - begin)[done:stop]
            x = np.repeat(left[done:stop], sizes)
            y = right[np.repeat(begin[done:stop] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            fits = (label[x] != label[y]) & (~minor[y] | (doc[x] < doc[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            x, y = x[fits], y[fits]
            near = _least_distances(x, y, width, where, stacks) * (100 + percent) <= (100 - percent) * (n[x] + n[y])
            found.append(np.stack([np.minimum(doc[x[near]], doc[y[near]]), np.maximum(doc[x[near]], doc[y[near]])]))
            done = stop
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        if pairs.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= GATHER:
                rows = pa.Table.from_batches(held)
                cut = int(np.searchsorted(rows["key"].to_numpy(), rows["key"][-1].as_py()))
                if cut:
                    yield from block(rows.slice(0, cut))
                held, count = rows.slice(cut).to_batches(), rows.num_rows - cut
        if held:
            yield from block(pa.Table.from_batches(held))

    return run


def _blocks(rows: DataFrame, summaries: DataFrame, percent: int) -> DataFrame:
    """Plausible pairs (a, b) among rows(sig, doc, label): rows of other labels meet every row of their signature.

    Both sides are dealt into blocks by hash, so a task holds about 2 * BLOCK rows, however many a signature has.
    """
    counted = materialise(rows.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("c")), "label_counts")
    stats = counted.groupBy("sig").agg(F.sum("c").alias("g"), F.max(F.struct("c", "label"))["label"].alias("major"), F.max("c").alias("m"))
    stats = stats.filter("g > m").select("sig", "major", F.ceil((F.col("g") - F.col("m")) / BLOCK).alias("ys"), F.ceil(F.col("g") / BLOCK).alias("gs"))
    stats = materialise(stats, "signature_counts")
    dealt = rows.join(stats, "sig").withColumn("minor", F.col("label") != F.col("major"))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("doc", F.lit(1)), "ys")).withColumn("j", F.pmod(F.xxhash64("doc", F.lit(2)), "gs"))
    cells = F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda i: F.struct(i.alias("i"), F.col("j").alias("j")))
    more = F.transform(F.filter(F.sequence(F.lit(0), F.col("gs") - 1), lambda j: j != F.col("j")), lambda j: F.struct(F.col("i").alias("i"), j.alias("j")))
    dealt = dealt.withColumn("cell", F.explode(F.when(F.col("minor"), F.concat(cells, more)).otherwise(cells)))
    dealt = dealt.select(
        F.when((F.col("ys") == 1) & (F.col("gs") == 1), F.col("sig")).otherwise(F.xxhash64("sig", "cell.i", "cell.j")).alias("key"),
        "doc",
        "label",
        (F.col("minor") & (F.col("i") == F.col("cell.i"))).alias("left"),
        (F.col("j") == F.col("cell.j")).alias("right"),
        "minor",
    )
    carried = summaries.select(F.col("rep").alias("doc"), F.col("n_shingles").alias("n"), "carried")
    dealt = dealt.join(carried, "doc").select("key", "doc", "label", "n", F.col("carried").alias("sketch"), "left", "right", "minor")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_compared(percent), "a long, b long")


def _stars(rows: DataFrame) -> DataFrame:
    """(a, b): every row of rows(sig, doc, label) beside its signature's most central doc, where labels differ.

    Central is who shares signatures with most: of copies of one text the text itself, from which
    each copy differs less than from another copy. Ties go to the smallest id.
    """
    sizes = materialise(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes_of_sigs")
    shared = materialise(rows.join(sizes, "sig"), "shared")
    central = materialise(shared.groupBy("doc").agg(F.sum("n").alias("met")), "central")
    first = shared.select("sig", "doc", "label").join(central, "doc").groupBy("sig").agg(F.max(F.struct("met", (-F.col("doc")).alias("last"), "label")).alias("top"))
    first = materialise(first.select("sig", (-F.col("top.last")).alias("a"), F.col("top.label").alias("its")), "leaders")
    pairs = shared.select("sig", "doc", "label").join(first, "sig").filter("doc <> a AND label <> its")
    return pairs.select("a", F.col("doc").alias("b")).distinct()


def _may_link(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.array([least_distance(x, y) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)], dtype=np.int64)
            n = batch["n"].to_numpy(zero_copy_only=False)
            yield batch.select(["a", "b"]).filter(pa.array(least * (100 + percent) <= (100 - percent) * n))

    return run


def _plausible(pairs: DataFrame, summaries: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs whose sizes and sketches allow similarity; nothing similar leaves."""
    pairs = materialise(pairs, "pairs")
    side = lambda k, c, n: summaries.select(F.col("rep").alias(k), F.col("sketch").alias(c), F.col("n_shingles").alias(n))
    j = pairs.join(side("b", "y", "n_b"), "b").join(side("a", "x", "n_a"), "a")
    j = j.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return materialise(j.select("a", "b", "x", "y", (F.col("n_a") + F.col("n_b")).alias("n")).mapInArrow(_may_link(percent), "a long, b long"), name)


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = shingle_sets(batch["text"].to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc", "shingles"])

    return run


def components(links: DataFrame) -> DataFrame:
    """id, label (smallest id reachable) for the ids of links(a, b): labels spread over links, then follow labels."""
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    while True:
        told = both.join(labels, both["a"] == labels["id"]).select(F.col("b").alias("id"), "label").unionByName(labels)
        spread = materialise(told.groupBy("id").agg(F.min("label").alias("label")), "spread")
        up = spread.select(F.col("id").alias("label"), F.col("label").alias("top"))
        jumped = materialise(spread.join(up, "label").select("id", "top", "label"), "jumped")
        changed = jumped.select("id", F.col("top").alias("new")).join(labels, "id").filter("new <> label").limit(1).count()
        labels = jumped.select("id", F.col("top").alias("label"))
        if not changed:
            return labels


def _links(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) that are similar."""
    first = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    similar = 100 * common >= percent * (F.size("x") + F.size("y") - common)
    return materialise(pairs.join(second, "b").join(first, "a").filter(similar).select("a", "b"), name)


def _relabelled(told: DataFrame, links: DataFrame) -> DataFrame:
    """told(doc, label) after links(a, b) have joined components."""
    at = lambda k: told.select(F.col("doc").alias(k), F.col("label").alias("label_" + k))
    edges = links.join(at("a"), "a").join(at("b"), "b").filter("label_a <> label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()
    edges = materialise(edges, "edges")
    if edges.isEmpty():
        return told
    moved = components(edges).select(F.col("id").alias("label"), F.col("label").alias("top"))
    return materialise(told.join(moved, "label", "left").select("doc", F.coalesce("top", "label").alias("label")), "told")


def _mixed_only(rows: DataFrame, told: DataFrame) -> DataFrame:
    """rows(sig, doc) with the labels of told, of signatures with several labels."""
    rows = materialise(rows.select("sig", "doc").join(told, "doc"), "labelled")
    several = rows.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("sig")
    return materialise(rows.join(several, "sig", "left_semi"), "mixed_rows")


def join(docs: DataFrame, width: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id, row per row of docs(doc_id, text); links between representatives of unequal sets).

    row is a hash of the text, which tells rows of one id apart; while ids with several texts are
    linked, each of their texts has an id of its own, and links name it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    texts = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("row").alias("low"), F.max("row").alias("high"))
    several = materialise(texts.filter("low <> high").select("doc_id"), "ids_with_several_texts")
    if several.isEmpty():
        return _join(docs, width, percent)
    told = docs.join(several.withColumn("more", F.lit(True)), "doc_id", "left").withColumn("own", F.when(F.col("more"), F.xxhash64("doc_id", "row")).otherwise(F.col("doc_id")))
    found, links = _join(told.select(F.col("own").alias("doc_id"), "row", "text"), width, percent)
    names = materialise(told.select("own", "row", "doc_id").distinct(), "names")
    same = found["doc_id"].eqNullSafe(names["own"]) & (found["row"] == names["row"])
    found = materialise(found.join(names, same).select(names["doc_id"], "n_shingles", "component_id", found["row"]), "named")
    least = found.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return found.join(least, "component_id", "left").select("doc_id", "n_shingles", F.col("least").alias("component_id"), "row"), links


def _join(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession

    def sets_of(ids: DataFrame) -> DataFrame:
        ids = materialise(ids.distinct(), "asked")
        return materialise(docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_set_rows(width), "doc long, shingles array<long>"), "sets")

    def checked(pairs: DataFrame, reps: DataFrame, name: str) -> DataFrame:
        pairs = _plausible(pairs, reps, percent, "plausible")
        ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
        return _links(pairs, sets_of(ends), percent, name)

    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"), temporary(spark) as keep:
        with temporary(spark) as keep_early:
            rows = materialise(docs.mapInArrow(_summaries(width, percent), "doc_id long, row long, n_shingles long, one long, two long, sketch binary, early array<long>"), "summaries")
            own = ["n_shingles", "one", "two"]
            classes = materialise(rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*own).agg(F.min("doc_id").alias("rep")), "classes")
            is_rep = (rows["doc_id"] == classes["rep"]) & (rows["n_shingles"] == classes["n_shingles"]) & (rows["one"] == classes["one"]) & (rows["two"] == classes["two"])
            found = rows.join(classes, is_rep, "left_semi").select(F.col("doc_id").alias("rep"), "n_shingles", "sketch", "early")
            found = materialise(found.dropDuplicates(["rep", "n_shingles", "sketch"]), "found")
            reps = materialise(found.select("rep", "n_shingles", "sketch"), "reps")
            known = materialise(rows.join(classes, own, "left").select("doc_id", "row", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "known")
            early = materialise(found.select(F.explode("early").alias("sig"), F.col("rep").alias("doc"), F.col("rep").alias("label")), "early")
            links = checked(_stars(early), reps, "links")
            told = _relabelled(materialise(reps.select(F.col("rep").alias("doc"), F.col("rep").alias("label")).distinct(), "alone"), links)
            keep_early(known, reps, links, told)
        with temporary(spark) as keep_signed:
            labelled = docs.select("doc_id", "text").join(told.withColumnRenamed("doc", "doc_id").hint("shuffle_hash"), "doc_id")
            pairs = labelled.mapInArrow(_signature_labels(width, percent), "sig long, label long")
            mixed = materialise(pairs.repartition("sig").sortWithinPartitions("sig", "label").mapInArrow(_several, "sig long, label long"), "mixed")
            concerned = materialise(told.join(mixed.select("label").distinct(), "label", "left_semi").select(F.col("doc").alias("doc_id"), "label"), "concerned")
            again = docs.select("doc_id", "text").join(concerned.hint("shuffle_hash"), "doc_id")
            signed = again.mapInArrow(_signed_rows(width, percent), "sig long, doc long, label long").join(mixed, ["sig", "label"], "left_semi")
            signed = materialise(signed, "signed")
            keep_signed(signed)
        with temporary(spark) as keep_late:
            more = checked(_stars(signed), reps, "star_links")
            told = _relabelled(told, more)
            rest = _mixed_only(signed, told)
            carried = reps.join(rest.select(F.col("doc").alias("rep")).distinct(), "rep", "left_semi")
            carried = materialise(carried.select("rep", "n_shingles", "sketch").mapInArrow(_carried, "rep long, n_shingles long, carried binary"), "carried")
            late = materialise(_blocks(rest, carried, percent).distinct(), "late")
            last = checked(late, reps, "late_links")
            told = _relabelled(told, last)
            links = materialise(links.unionByName(more).unionByName(last), "all_links")
            keep_late(told, links)
        labels = told.select(F.col("doc").alias("rep"), "label")
        out = materialise(known.join(labels, "rep", "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"), "row"), "components")
        keep(out, links)
    return out, links


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs with the smallest id of their component, with docs' columns; rows without an id stay.

    Where rows of one id have different texts, each is judged by its own text's component.
    """
    with temporary(docs.sparkSession) as keep:
        found = join(docs, width, percent)[0]
        gone = materialise(found.filter("component_id <> doc_id").select("doc_id", "row").distinct(), "gone")
        keep(gone)
    same = (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["row"])
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")


def op6_ngram_jaccard(spark, sf_dir):
    from .common import table

    return join(table(spark, sf_dir, "documents"))[0].drop("row")
