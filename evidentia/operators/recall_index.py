"""The stored index of turns: postings and piece vectors in blocks, kept up to date by segments.

A segment holds the turns of one sync: blocks of at most 1,024 turns with their words (sorted, so that a prefix is a
range), postings in the order of words, and what questions filter and order by; and blocks of piece vectors.
A sync adds one segment of the turns whose revision is new. Forgotten turns are marks beside the blocks, merged when
these are read. compact() makes one segment of all, without the forgotten. If the table's size is
not explained by the new turns, the index is rebuilt as a new generation. Readers follow one pointer.

Word search reads every block twice: once for the documents that hold each asked prefix (corpus statistics
are those of all turns that were not forgotten), once for scores. A block cannot enter a question's best k
if the sum of its largest impacts stays below the k-th score found so far, and is passed over.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from evidentia.functions.text import pieces, query_terms, tokens
from evidentia.operators import blocks as bl
from evidentia.sources.generations import Generations
from evidentia.sources.scratch import kept

K1, B = 1.2, 0.75
META = "turn_ids array<string>, sessions array<string>, scopes array<string>, roles array<string>, at array<long>, revisions array<long>"
WORDS = f"block long, {META}, lengths array<int>, terms array<string>, starts array<int>, docs binary, counts binary"
VECTORS = f"block long, {META}, piece_starts array<int>, dims int, matrix binary"
DELETED = "block long, places array<int>"
_META = [x.split()[0] for x in META.split(", ")]
_SEARCHED = ("user", "document")
#: Where every turn is returned: questions of a block, slots at most, and questions scored at once.
ASKED, SPREAD, AT_ONCE = 8192, 256, 64


def _described(turns: DataFrame) -> list:
    """turn_id and what questions filter and order by; columns that turns lack are null, ids are texts."""
    have = {c.lower() for c in turns.columns}
    column = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    at = F.unix_micros(F.col("happened_at").cast("timestamp")) if "happened_at" in have else F.lit(None).cast("long")
    return [column("turn_id", "string").alias("turn_id"), column("session_id", "string").alias("session_id"), column("scope", "string").alias("scope"), column("role", "string").alias("role"), at.alias("at"), column("revision", "long").alias("revision")]


def _numbered() -> Iterator[int]:
    """Block numbers of a task, unlike those of other tasks; the random part keeps segments apart."""
    from secrets import randbits

    first = randbits(43) << 20
    return iter(range(first, first + (1 << 20)))


def _word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers, shape = _numbered(), bl.arrow_schema(WORDS)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        words = batch.column("words").fill_null([])
        lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary.cast(pa.binary())).to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        keys = place[coded.indices.to_numpy(zero_copy_only=False)] * n + np.repeat(np.arange(n), lengths) if len(coded) else np.zeros(0, np.int64)
        keys, counts = np.unique(keys, return_counts=True)
        starts = np.searchsorted(keys, np.arange(len(order) + 1) * n)
        values = [[next(numbers)], *[[batch.column(i).to_pylist()] for i in range(6)], [lengths.tolist()], [coded.dictionary.take(pa.array(order)).to_pylist()], [starts.tolist()], [(keys % n).astype(np.int32).tobytes()], [counts.astype(np.int32).tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, shape, strict=True)], schema=shape)


def _vector_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers, shape = _numbered(), bl.arrow_schema(VECTORS)
    for batch in batches:
        vectors = batch.column("embedding")
        use = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        for dims in sorted({len(vectors[int(i)]) for i in use}):
            rows = pa.array([int(i) for i in use if len(vectors[int(i)]) == dims], pa.int64())
            matrix = np.array(vectors.take(rows).to_pylist(), dtype=np.float32)
            values = [[next(numbers)], *[[batch.column(i).take(rows).to_pylist()] for i in range(7)], [dims], [matrix.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, shape, strict=True)], schema=shape)


@contextmanager
def block_rows(spark: SparkSession, rows: int = bl.ROWS):
    """Within it, jobs that make blocks put so many rows into one."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def word_blocks(turns: DataFrame) -> DataFrame:
    """Blocks of postings of turns(turn_id, content, and optionally session_id, scope, role, happened_at, revision)."""
    return turns.select(*_described(turns), tokens(F.coalesce("content", F.lit(""))).alias("words")).mapInArrow(_word_blocks, WORDS)


def vector_blocks(piece_rows: DataFrame) -> DataFrame:
    """Blocks of vectors of pieces: turns' columns with start and embedding; rows without a vector leave."""
    return _described_pieces(piece_rows).mapInArrow(_vector_blocks, VECTORS)


def _described_pieces(piece_rows: DataFrame) -> DataFrame:
    return piece_rows.select(*_described(piece_rows), F.col("start").cast("int").alias("start"), F.col("embedding").cast("array<float>").alias("embedding"))


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ROWS pieces of pieces sorted by turn; no turn is cut."""
    held = None
    for batch in batches:
        held = pa.concat_batches([held, batch]) if held is not None else batch
        while held.num_rows > bl.ROWS:
            ids = held.column("turn_id").slice(0, bl.ROWS + 1).to_pylist()
            at = next(i for i in range(bl.ROWS, 0, -1) if ids[i] != ids[i - 1])
            yield from _vector_blocks(iter([held.slice(0, at)]))
            held = held.slice(at)
    if held is not None:
        yield from _vector_blocks(iter([held]))


def held_blocks(rows: DataFrame) -> DataFrame:
    """Blocks written once, for a search without a stored index."""
    with block_rows(rows.sparkSession):
        return kept(rows)


def turn_pieces(turns: DataFrame, embed) -> DataFrame:
    """The 500-character pieces of turns with their vectors."""
    cut = turns.withColumn("_p", F.explode(pieces(F.col("content"))))
    return cut.select(*[c for c in turns.columns if c != "content"], F.col("_p.start").alias("start"), embed(F.col("_p.piece")).alias("embedding"))


# ---- questions ---------------------------------------------------------------------------------

_FILTERS = {"scopes": "array<string>", "since": "long", "until": "long", "about_assistant": "boolean"}


def questions_of(queries: DataFrame) -> DataFrame:
    """query_id with what a question may say about scopes, since, until and the assistant; absent is no condition."""
    have = set(queries.columns)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    out = [micros(c) if c in have and kind == "long" else F.col(c).cast(kind).alias(c) if c in have else F.lit(None).cast(kind).alias(c) for c, kind in _FILTERS.items()]
    return queries.select("query_id", *out, *[c for c in queries.columns if c not in _FILTERS and c != "query_id"])


def _mask(pair: dict, i: int, meta: dict, *, until_inclusive: bool, roles: bool) -> np.ndarray:
    """Rows of a block that a question may find."""
    mask = meta["alive"].copy()
    if roles and not pair["q_about_assistant"][i]:
        mask &= meta["searched"]
    if pair["q_scopes"][i]:
        mask &= np.isin(meta["scopes"], pair["q_scopes"][i])
    at = meta["at"]
    if (since := pair["q_since"][i]) is not None:
        mask &= at >= since
    if (until := pair["q_until"][i]) is not None:
        mask &= (at <= until) if until_inclusive else (at < until)
    return mask


def _meta(pair: dict) -> dict:
    alive = np.ones(len(pair["turn_ids"]), dtype=bool)
    alive[pair["places"] or []] = False
    none = np.iinfo(np.int64).min
    number = lambda name: np.array([none if x is None else x for x in pair[name]], dtype=np.int64)
    return {"alive": alive, "searched": np.array([r in _SEARCHED for r in pair["roles"]], dtype=bool), "scopes": np.array([s or "" for s in pair["scopes"]], dtype=object), "at": number("at"), "revisions": number("revisions"), "ids": pair["turn_ids"]}


class _Postings:
    """One block's postings by prefix."""

    def __init__(self, pair: dict):
        self.terms = pair["terms"].cast(pa.binary()).to_pylist()
        self.starts = np.array(pair["starts"], dtype=np.int64)
        self.docs, self.counts = np.frombuffer(pair["docs"], np.int32), np.frombuffer(pair["counts"], np.int32)
        self.n = len(pair["turn_ids"])

    def of(self, prefix: str, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents with a word that starts so, and how often."""
        start = prefix.encode()
        low, high = bisect_left(self.terms, start), bisect_left(self.terms, start + b"\xff")
        a, b = self.starts[low], self.starts[high]
        if a == b:
            return self.docs[:0], self.counts[:0]
        docs, counts = self.docs[a:b], self.counts[a:b]
        if high - low > 1:
            summed = np.bincount(docs, weights=counts, minlength=self.n)
            docs = np.flatnonzero(summed)
            counts = summed[docs]
        keep = alive[docs]
        return docs[keep], counts[keep]


def _frequencies():
    held: dict[tuple[int, str], int] = {}

    def take(pair: dict) -> None:
        postings, meta = _Postings(pair), _meta(pair)
        for prefix in {p for ps in pair["q_prefixes"] for p in ps}:
            if n := len(postings.of(prefix, meta["alive"])[0]):
                key = pair["question"], prefix
                held[key] = held.get(key, 0) + n

    return take, lambda: [(*key, n) for key, n in held.items()]


def _scores(k: int, docs: int, mean: float, roles: bool):
    best = bl.Best(k)

    def take(pair: dict) -> None:
        postings, meta = _Postings(pair), _meta(pair)
        lengths = np.array(pair["lengths"], dtype=np.float64)
        base = K1 * (1 - B + B * lengths / mean) if mean else lengths
        idf = dict(zip(pair["idf_prefixes"] or [], pair["idf_values"] or [], strict=True))
        impact: dict[str, tuple] = {}
        for prefix, weight in idf.items():
            found, tf = postings.of(prefix, meta["alive"])
            if len(found):
                w = weight * tf * (K1 + 1) / (tf + base[found])
                impact[prefix] = found, w, float(w.max())
        for i, query in enumerate(pair["q_query_id"]):
            own = [impact[p] for p in pair["q_prefixes"][i] if p in impact]
            floor = best.floor(query)
            if not own or (floor is not None and sum(x[2] for x in own) < -floor[0] - 1e-8):
                continue
            score = np.round(np.bincount(np.concatenate([x[0] for x in own]), weights=np.concatenate([x[1] for x in own]), minlength=postings.n), 9)
            mask = _mask(pair, i, meta, until_inclusive=True, roles=roles)
            # smaller than what the k-th has never enters; equal scores are told apart by time, revision and id
            hits = np.flatnonzero((score > 0) & mask & (score >= (-floor[0] if floor is not None else 0)))
            if len(hits) > k:
                hits = hits[score[hits] >= np.partition(score[hits], -k)[-k]]
            if len(hits):
                best.offer(query, [(-float(score[j]), -int(meta["at"][j]) if meta["at"][j] != np.iinfo(np.int64).min else 2**63, -int(meta["revisions"][j]), meta["ids"][j]) for j in hits])

    return take, lambda: [(q, key[3], key[0], _back(key[1]), _back(key[2])) for q, keys in best.held.items() for key in keys]


def _back(negated: int) -> int | None:
    return None if negated == 2**63 else -negated


def _similar(k: int, roles: bool):
    best = bl.Best(k)

    def take(pair: dict) -> None:
        meta = _meta(pair)
        n, dims = len(pair["turn_ids"]), pair["dims"]
        v = np.frombuffer(pair["matrix"], np.float32).reshape(n, dims).astype(np.float64)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        same = [i for i, q in enumerate(pair["q_embedding"]) if q is not None and len(q) == dims]
        if not same:
            return
        q = np.array([pair["q_embedding"][i] for i in same], dtype=np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        starts = np.array(pair["piece_starts"], dtype=np.int64)
        turn, ids = pd.factorize(np.array(meta["ids"], dtype=object))
        order = np.lexsort((starts, meta["revisions"], turn))
        for i, row in zip(same, np.round(q @ v.T, 9), strict=True):
            mask = _mask(pair, i, meta, until_inclusive=False, roles=roles)
            at = order[mask[order]]
            if not len(at):
                continue
            first = np.flatnonzero(np.concatenate([[True], turn[at[1:]] != turn[at[:-1]]]))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
            top = np.maximum.reduceat(row[at], first)
            hit = np.flatnonzero(row[at] == top[group])
            hit = at[hit[np.concatenate([[True], group[hit[1:]] != group[hit[:-1]]])]]  # the first of a turn's ties
            query = pair["q_query_id"][i]
            floor = best.floor(query)
            hit = hit[row[hit] >= (-floor[0] if floor is not None else -2)]
            if len(hit) > k:
                hit = hit[row[hit] >= np.partition(row[hit], -k)[-k]]
            # pieces of one turn may stand in several blocks: it counts once, by the best of them
            held = {x[3]: x for x in best.held.pop(query, ())}
            for j in hit:
                key = -float(row[j]), int(meta["revisions"][j]), int(starts[j]), meta["ids"][j]
                held[key[3]] = min(key, held.get(key[3], key))
            best.offer(query, list(held.values()))

    return take, lambda: [(q, key[3], -key[0], key[1], key[2]) for q, keys in best.held.items() for key in keys]


def _found(pair: dict, kind: pa.DataType, roles: bool) -> Iterator[list]:
    """Each question's best piece of every turn of a block, as columns, for a few questions at a time."""
    meta = _meta(pair)
    n, dims = len(pair["turn_ids"]), pair["dims"]
    v = np.frombuffer(pair["matrix"], np.float32).reshape(n, dims).astype(np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    same = np.flatnonzero(pc.equal(pc.list_value_length(pair["q_embedding"]), dims).fill_null(False).to_numpy(zero_copy_only=False))
    ids, starts = pa.array(meta["ids"], pa.string()).cast(kind), np.array(pair["piece_starts"], dtype=np.int64)
    turn = pd.factorize(np.array(meta["ids"], dtype=object))[0]
    order = np.lexsort((starts, meta["revisions"], turn))
    alike: dict[tuple, list[int]] = {}
    for i in same.tolist():
        alike.setdefault((tuple(pair["q_scopes"][i] or ()), pair["q_since"][i], pair["q_until"][i], pair["q_about_assistant"][i]), []).append(i)
    for members in alike.values():
        at = order[_mask(pair, members[0], meta, until_inclusive=False, roles=roles)[order]]
        if not len(at):
            continue
        first = np.flatnonzero(np.concatenate([[True], turn[at[1:]] != turn[at[:-1]]]))
        width = np.diff(np.append(first, len(at)))
        for low in range(0, len(members), AT_ONCE):
            own = pa.array(members[low : low + AT_ONCE])
            q = pair["q_embedding"].take(own).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), dims)
            q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            row = np.round(q @ v[at].T, 9)
            top = np.maximum.reduceat(row, first, axis=1)
            place = np.where(row == np.repeat(top, width, axis=1), np.arange(len(at)), len(at))
            place = np.minimum.reduceat(place, first, axis=1)  # the first of a turn's ties
            i, t = np.nonzero(place < len(at))
            j = at[place[i, t]]
            yield [pair["q_query_id"].take(own.take(pa.array(i))), ids.take(pa.array(j)), pa.array(top[i, t]), pa.array(meta["revisions"][j]), pa.array(starts[j].astype(np.int32))]


def _every(held: DataFrame, queries: DataFrame, roles: bool, kind: str = "string") -> DataFrame:
    """query_id, turn_id, similarity, revision, start: the best piece of every turn in every block, passed on as it is found.

    kind: of turn_id.
    """
    questions, n = bl.deal(questions_of(queries), ["query_id", *_FILTERS, "embedding"], ASKED)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, turn_id {kind}, similarity double, revision long, start int"
    shape = bl.arrow_schema(schema)
    raw = ("q_query_id", "q_embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = {name: batch.column(name)[i].values if name in raw else batch.column(name)[i].as_py() for name in batch.schema.names}
                for columns in _found(pair, shape.field("turn_id").type, roles):
                    yield pa.RecordBatch.from_arrays(columns, schema=shape)

    return bl.pairs(held, kept(questions), n, SPREAD).mapInArrow(run, schema)


def best_pieces(piece_rows: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, turn_id, similarity, revision, start: each question's best piece of every turn of pieces(turn_id, revision, start, embedding).

    Blocks hold turns whole, so what a block finds is the result: it is neither gathered in a task nor shuffled. Only turns of more pieces
    than a block may have are cut, and the best of their parts are compared afterwards.
    """
    kind = "long" if isinstance(piece_rows.schema["turn_id"].dataType, IntegralType) else "string"
    text = F.col("turn_id").cast("string")
    large = kept(piece_rows.groupBy(text.alias("_large")).count().filter(F.col("count") > bl.ROWS).select("_large"))
    if large.isEmpty():
        return _every(_held_whole(piece_rows), queries, False, kind)
    met = text.eqNullSafe(F.col("_large"))
    cut = similar_blocks(held_blocks(vector_blocks(piece_rows.join(large, met, "left_semi"))), queries, limit=None, roles=False)
    return _every(_held_whole(piece_rows.join(large, met, "left_anti")), queries, False, kind).unionByName(cut.withColumn("turn_id", F.col("turn_id").cast(kind)))


def _held_whole(piece_rows: DataFrame) -> DataFrame:
    return _with_deleted(kept(_described_pieces(piece_rows).repartition("turn_id").sortWithinPartitions("turn_id").mapInArrow(_whole_blocks, VECTORS)), None)


def _with_deleted(rows: DataFrame, deleted: DataFrame | None) -> DataFrame:
    if deleted is None:
        return rows.withColumn("places", F.lit(None).cast("array<int>"))
    marks = deleted.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    return rows.join(marks, "block", "left")


def search_blocks(rows: DataFrame, queries: DataFrame, *, limit: int, deleted: DataFrame | None = None, roles: bool = False) -> DataFrame:
    """query_id, turn_id, score (smaller is better), place: BM25 over prefix terms.

    queries(query_id, query) may have scopes, since, until (inclusive) and about_assistant; they apply after scoring and
    before the limit. roles: only turns of users and documents unless about_assistant.
    """
    held = _with_deleted(rows, deleted)
    alive = F.transform(F.col("lengths"), lambda x, i: F.when(F.array_contains(F.coalesce("places", F.array().cast("array<int>")), i), 0).otherwise(x))
    size = held.select(F.size("lengths") - F.coalesce(F.size(F.array_distinct("places")), F.lit(0)), F.aggregate(alive, F.lit(0).cast("long"), lambda a, x: a + x)).toDF("n", "words")
    row = size.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    docs, mean = int(row.n or 0), (row.words or 0) / row.n if row.n else 0.0
    asked = questions_of(queries).withColumn("prefixes", F.coalesce(query_terms(F.col("query")), F.array().cast("array<string>")))
    questions, n = bl.deal(asked, ["query_id", *_FILTERS, "prefixes"])
    questions = kept(questions)
    kind = queries.schema["query_id"].dataType.simpleString()
    postings = ["block", *_META, "lengths", "terms", "starts", "docs", "counts", "places"]
    found = bl.each(bl.pairs(held.select(*postings), questions, n), _frequencies, "question long, prefix string, n long", ("terms",))
    df = found.groupBy("question", "prefix").agg(F.sum("n").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    by_question = df.groupBy("question").agg(F.collect_list(F.struct("prefix", idf.alias("idf"))).alias("x")).select("question", F.col("x.prefix").alias("idf_prefixes"), F.col("x.idf").alias("idf_values"))
    weighed = kept(questions.join(by_question, "question", "left"))
    scored = bl.each(bl.pairs(held.select(*postings), weighed, n), lambda: _scores(limit, docs, mean, roles), f"query_id {kind}, turn_id string, score double, at long, revision long", ("terms",))
    order = Window.partitionBy("query_id").orderBy("score", F.col("at").desc_nulls_last(), F.desc("revision"), "turn_id")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def similar_blocks(rows: DataFrame, queries: DataFrame, *, limit: int | None, deleted: DataFrame | None = None, roles: bool = True) -> DataFrame:
    """query_id, turn_id, similarity, revision, start and, with a limit, place: each turn's best piece by cosine.

    queries(query_id, embedding) may have scopes, since, until (exclusive) and about_assistant; without that only turns of
    users and documents are found, if roles.
    """
    if limit is None:
        hits = _every(_with_deleted(rows, deleted), queries, roles)
    else:
        questions, n = bl.deal(questions_of(queries), ["query_id", *_FILTERS, "embedding"])
        kind = queries.schema["query_id"].dataType.simpleString()
        hits = bl.each(bl.pairs(_with_deleted(rows, deleted), kept(questions), n), lambda: _similar(limit, roles), f"query_id {kind}, turn_id string, similarity double, revision long, start int")
    first = Window.partitionBy("query_id", "turn_id").orderBy(F.desc("similarity"), "revision", "start")
    best = hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    if limit is None:
        return best
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "revision", "start", "turn_id")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


# ---- the stored index --------------------------------------------------------------------------


class RecallIndex:
    """Segments of word blocks, and of vector blocks if embed is given, below a folder."""

    def __init__(self, spark: SparkSession, path: str, embed=None, model: str = ""):
        self.spark, self.store, self.embed, self.model = spark, Generations(spark, path), embed, model

    def state(self) -> dict:
        return {"last": -1, "turns": 0, "model": self.model} | self.store.state()

    def sync(self, turns: DataFrame) -> str:
        """Take in the turns of revisions after the last; UNCHANGED, ADDED, or REBUILT if the table shrank or the model is another."""
        state = self.state()
        count, new = turns.count(), turns.filter(F.col("revision") > state["last"])
        arrived = new.agg(F.count(F.lit(1)).alias("n"), F.max("revision").alias("last")).first()
        if state["turns"] + arrived.n != count or state["model"] != self.model:
            return self._rebuild(turns, state)
        if not arrived.n:
            return "UNCHANGED"
        name = self._segment(new)
        self.store.commit(state, segments=[*state["segments"], name], last=arrived.last, turns=count)
        return "ADDED"

    def _segment(self, turns: DataFrame) -> str:
        name = self.store.segment()
        with block_rows(self.spark):
            self.store.write(word_blocks(turns), name, "words")
            if self.embed is not None:
                self.store.write(vector_blocks(turn_pieces(turns, self.embed)), name, "vectors")
        return name

    def _rebuild(self, turns: DataFrame, state: dict) -> str:
        row = turns.agg(F.count(F.lit(1)).alias("n"), F.max("revision").alias("last")).first()
        segments = [self._segment(turns)] if row.n else []
        self.store.commit(state, generation=state["generation"] + 1, segments=segments, deleted=[], last=-1 if row.last is None else row.last, turns=row.n, model=self.model)
        return "REBUILT"

    def forget(self, ids: DataFrame) -> int:
        """Mark turns(turn_id) as forgotten; how many were found. The table of turns loses them too, so counts still agree."""
        state = self.state()
        name, found = self.store.segment(), 0
        gone = kept(ids.select(F.col("turn_id").cast("string").alias("turn_id")).distinct())
        words = self.store.read(state["segments"], "words", WORDS)
        alive = self.deleted("words", state)
        for table, rows in (("words", words), ("vectors", self.store.read(state["segments"], "vectors", VECTORS))):
            marks = rows.select("block", F.posexplode("turn_ids").alias("place", "turn_id")).join(gone, "turn_id", "left_semi")
            if table == "words":
                old = alive.select("block", F.explode("places").alias("place"))
                found = marks.join(old, ["block", "place"], "left_anti").count()
            self.store.write(marks.groupBy("block").agg(F.collect_list("place").alias("places")), name, f"deleted_{table}")
        if found:
            self.store.commit(state, deleted=[*state["deleted"], name], turns=state["turns"] - found)
        return found

    def deleted(self, table: str, state: dict) -> DataFrame:
        return self.store.read(state["deleted"], f"deleted_{table}", DELETED)

    def search(self, queries: DataFrame, limit: int = 100, **options: bool) -> DataFrame:
        state = self.state()
        return search_blocks(self.store.read(state["segments"], "words", WORDS), queries, limit=limit, deleted=self.deleted("words", state) if state["deleted"] else None, **options)

    def similar(self, queries: DataFrame, limit: int | None = 100, **options: bool) -> DataFrame:
        state = self.state()
        return similar_blocks(self.store.read(state["segments"], "vectors", VECTORS), queries, limit=limit, deleted=self.deleted("vectors", state) if state["deleted"] else None, **options)

    def compact(self) -> str:
        """One segment of all, without forgotten turns; UNCHANGED if there is one and nothing is forgotten."""
        state = self.state()
        if len(state["segments"]) <= 1 and not state["deleted"]:
            return "UNCHANGED"
        name = self.store.segment()
        for table, schema, merge in (("words", WORDS, _merge_words), ("vectors", VECTORS, _merge_vectors)):
            rows = self.store.read(state["segments"], table, schema)
            held = _with_deleted(rows, self.deleted(table, state) if state["deleted"] else None)
            merged = held.repartition(F.xxhash64("block")).mapInArrow(merge, schema)
            self.store.write(merged, name, table)
        self.store.commit(state, generation=state["generation"] + 1, segments=[name], deleted=[])
        return "COMPACTED"


def _alive(row: dict) -> np.ndarray:
    keep = np.ones(len(row["turn_ids"]), dtype=bool)
    keep[row["places"] or []] = False
    return np.flatnonzero(keep)


def _merge(batches: Iterator[pa.RecordBatch], join, shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Join blocks of a task until the next would make one of more than bl.ROWS rows."""
    numbers, held, size = _numbered(), [], 0
    for batch in batches:
        for row in batch.to_pylist():
            n = len(_alive(row))
            if held and size + n > bl.ROWS:
                yield pa.RecordBatch.from_pylist([{"block": next(numbers)} | join(held)], schema=shape)
                held, size = [], 0
            if n:
                held.append(row)
                size += n
    if held:
        yield pa.RecordBatch.from_pylist([{"block": next(numbers)} | join(held)], schema=shape)


def _joined_words(rows: list[dict]) -> dict:
    out: dict = {name: [] for name in [*_META, "lengths"]}
    words: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for row in rows:
        alive, first = _alive(row), len(out["turn_ids"])
        place = np.full(len(row["turn_ids"]), -1)
        place[alive] = first + np.arange(len(alive))
        for name in out:
            out[name] += [row[name][i] for i in alive]
        docs, counts = place[np.frombuffer(row["docs"], np.int32)], np.frombuffer(row["counts"], np.int32)
        for term, a, b in zip(row["terms"], row["starts"], row["starts"][1:], strict=False):
            keep = docs[a:b] >= 0
            if keep.any():
                words.setdefault(term, []).append((docs[a:b][keep], counts[a:b][keep]))
    terms = sorted(words, key=str.encode)
    docs = [x[0] for t in terms for x in words[t]]
    counts = [x[1] for t in terms for x in words[t]]
    starts = np.concatenate([[0], np.cumsum([sum(len(x[0]) for x in words[t]) for t in terms])]).astype(int).tolist()
    empty = np.zeros(0, np.int32)
    return out | {"terms": terms, "starts": starts, "docs": np.concatenate([empty, *docs]).astype(np.int32).tobytes(), "counts": np.concatenate([empty, *counts]).astype(np.int32).tobytes()}


def _joined_vectors(rows: list[dict]) -> dict:
    out: dict = {name: [row[name][i] for row in rows for i in _alive(row)] for name in [*_META, "piece_starts"]}
    dims = rows[0]["dims"]
    matrix = [np.frombuffer(row["matrix"], np.float32).reshape(-1, dims)[_alive(row)] for row in rows]
    return out | {"dims": dims, "matrix": np.concatenate(matrix).tobytes()}


def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _merge(batches, _joined_words, bl.arrow_schema(WORDS))


def _merge_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _merge(batches, _joined_vectors, bl.arrow_schema(VECTORS))
