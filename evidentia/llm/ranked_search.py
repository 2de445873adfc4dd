r"""Ranked lexical search of all items over all documents, by sort-based accumulation.

Documents are indexed in blocks of at most BLOCK_DOCS rows and about BLOCK_BYTES of text, each a row of a
scratch table: the block's own vocabulary and, document after document, term numbers and occurrences. Corpus
statistics (documents, terms, documents by term) come from the blocks by partial sums. Items become
question blocks, each a row with its terms, weights and the items that ask them.

A task takes pairs of a document block and a question block. Matched postings are expanded to arrays of
(item, document, impact), concatenated; item and document pack into a 16-bit key, RANGE items at a time; the keys
are radix sorted (numpy's stable sort of 16-bit integers), and reduceat adds up the impacts of a key. Every
task keeps a heap of the best k of each item over all its pairs, and the heaps' rows are ranked by a window, which
drops all but k rows an item before its shuffle.

For scale, packed keys are range-partitioned: a (question block, document block) pair holds a range of items and a
set of documents whole, so sums need no later merging. Question blocks of at most SENT bytes, as measured, are
broadcast to the document blocks; larger ones meet them by a shuffled join on (question block, slot), for which they are
repeated once a slot. Nothing is capped: impacts over CHUNK are summed in several sorts.

Defined cases: a null or empty text has no terms and matches nothing; a null doc_id comes after others of its
score; rows that repeat a doc_id are documents of their own and each is ranked; items that repeat id and text count
once, and items that share an id with several texts ask all their terms; an item without terms has no rows; very long
texts are read whole (a block of their own, if need be); extra columns are not read; without documents or items
the result is empty.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, parts, settings, temporary

#: Bytes that are not part of a term, as bounds of code points: fixed values.
OUTSIDE = ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
BLOCK_DOCS = 1024
BLOCK_BYTES = 8 << 20
#: Blocks of a row group: a task that makes many blocks, or reads them, holds so many of them at once.
GROUP = 4
#: Items and documents of one sort: their packed keys fill 16 bits.
RANGE = 64
#: Impacts of one sort at most, but for a single posting's own.
CHUNK = 1 << 21
#: Items of a question block, on average.
ITEMS = 256
#: Bytes of question blocks, all together, that may be broadcast.
SENT = 4 << 20
#: Slots of document blocks for each shuffle partition.
SLOTS = 4

BLOCK = "block long, doc_ids array<long>, lengths array<int>, starts array<int>, terms array<binary>, docs_with array<int>, posting_terms binary, posting_counts binary"
QUESTIONS = "question long, items array<long>, terms array<binary>, weights array<long>, starts array<int>, asked_by binary, repeats binary"
BEST = "item_id long, doc_id long, score long"
_KINDS = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}

_TERM_BYTES = bytes(0x20 if any(low <= b <= high for low, high in OUTSIDE) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order. All bytes of characters beyond ASCII belong to terms."""
    return (text or b"").translate(_TERM_BYTES).split()


def _block(number: int, doc_ids: list, found: list[Counter], lengths: list[int]) -> dict:
    numbers: dict[bytes, int] = {}
    terms, counts, starts = [], [], [0]
    for own in found:
        terms += [numbers.setdefault(t, len(numbers)) for t in own]
        counts += own.values()
        starts.append(len(terms))
    term_numbers = np.array(terms, dtype=np.int32)
    with_term = np.bincount(term_numbers, minlength=len(numbers))
    return {"block": number, "doc_ids": doc_ids, "lengths": lengths, "starts": starts, "terms": list(numbers), "docs_with": with_term.tolist(), "posting_terms": term_numbers.tobytes(), "posting_counts": np.array(counts, dtype=np.int32).tobytes()}


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    shape = _arrow(BLOCK)
    doc_ids, found, lengths, size = [], [], [], 0

    def close():
        nonlocal doc_ids, found, lengths, size, number
        row = _block(number, doc_ids, found, lengths)
        doc_ids, found, lengths, size, number = [], [], [], 0, number + 1
        return pa.RecordBatch.from_pylist([row], schema=shape)

    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        for i in range(len(texts)):
            text = texts[i].as_py() or b""
            if doc_ids and (len(doc_ids) == BLOCK_DOCS or size + len(text) > BLOCK_BYTES):
                yield close()
            own = terms_of(text)
            doc_ids.append(ids[i].as_py())
            found.append(Counter(own))
            lengths.append(len(own))
            size += len(text)
    if doc_ids:
        yield close()


def index(docs: DataFrame) -> DataFrame:
    """Blocks of the documents' postings, written to the scratch folder. docs: doc_id, text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="256"):
        return materialise(rows.mapInArrow(_index, BLOCK), "blocks", GROUP)


def statistics(blocks: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents."""
    n = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    some = F.size(F.filter("lengths", lambda x: x > 0))
    row = blocks.select(some.cast("long").alias("some"), n.alias("n")).agg(F.sum("some"), F.sum("n")).first()
    return int(row[0] or 0), int(row[1] or 0)


def documents_with(blocks: DataFrame) -> DataFrame:
    """term, df over all blocks."""
    pairs = blocks.select(F.explode(F.arrays_zip("terms", "docs_with")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.docs_with").cast("long").alias("n"))
    return pairs.groupBy("term").agg(F.sum("n").alias("df"))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, repeats of items(item_id, text)."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(i, t, n) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True) for t, n in Counter(terms_of(text)).items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in own], type=kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))], ["item_id", "term", "repeats"])

    return rows.mapInArrow(split, "item_id long, term binary, repeats long").groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"))


def _question_block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    item, items = pd.factorize(frame["item_id"].astype("Int64"), use_na_sentinel=False)
    frame = frame.assign(item=item).sort_values(["term", "item"], kind="stable")
    first = ~frame["term"].duplicated().to_numpy()
    starts = np.append(np.flatnonzero(first), len(frame)).astype(np.int32)
    row = (int(key[0]), [None if pd.isna(i) else int(i) for i in items], frame["term"][first].tolist(), frame["weight"][first].tolist(), starts.tolist(), frame["item"].to_numpy(np.int32).tobytes(), frame["repeats"].to_numpy(np.int64).tobytes())
    return pd.DataFrame([row], columns=["question", "items", "terms", "weights", "starts", "asked_by", "repeats"])


def question_blocks(asked: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """Items with their terms' weights, dealt into blocks of about ITEMS items; terms of no weight leave."""
    count = asked.select("item_id").distinct().count()
    n_blocks = max(1, -(-count // ITEMS))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2.0) / (F.lit(2.0) * F.col("df") + 1.0))).cast("long")
    rows = asked.join(df, "term").withColumn("weight", weight).filter("weight > 0")
    rows = rows.select(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).alias("question"), "item_id", "term", "weight", "repeats")
    return rows.groupBy("question").applyInPandas(_question_block, QUESTIONS)


def _sums(keys: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 16-bit keys and the sums of their impacts."""
    order = np.argsort(keys, kind="stable")  # radix sort
    keys, impacts = keys[order], impacts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(impacts, first)


def _accumulate(matched: np.ndarray, docs: np.ndarray, base: np.ndarray, starts: np.ndarray, asked_by: np.ndarray, factor: np.ndarray, low: int) -> np.ndarray:
    """Scores of RANGE items from low by document. matched: question term of each posting; base: its impact without the weight.

    starts, asked_by, factor: by question term, the items of this range that ask it and weight times repeats.
    """
    scores = np.zeros(RANGE * BLOCK_DOCS, dtype=np.int64)
    wide = starts[matched + 1] - starts[matched]
    some = np.flatnonzero(wide)
    matched, docs, base, wide = matched[some], docs[some], base[some], wide[some]
    ends = np.cumsum(wide)
    at = 0
    while at < len(wide):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
        n = wide[at:to]
        entry = np.arange(ends[to - 1] - done) - np.repeat(ends[at:to] - done - n, n) + np.repeat(starts[matched[at:to]], n)
        keys = ((asked_by[entry] - low) * BLOCK_DOCS + np.repeat(docs[at:to], n)).astype(np.uint16)
        found, sums = _sums(keys, factor[entry] * np.repeat(base[at:to], n))
        scores[found] += sums
        at = to
    return scores.reshape(RANGE, BLOCK_DOCS)


class _Scorer:
    """Best k of each item over the pairs of blocks that a task reads."""

    def __init__(self, n_docs: int, n_terms: int, k: int):
        self.n_docs, self.n_terms, self.k = n_docs, n_terms, k
        self.best: dict[int | None, list[tuple]] = {}

    def add(self, row: dict) -> None:
        terms, lengths = row["terms"], np.array(row["lengths"], dtype=np.int64)
        place = pc.index_in(terms, value_set=row["asked"])
        of = place.fill_null(-1).to_numpy(zero_copy_only=False)
        posting = of[np.frombuffer(row["posting_terms"], dtype=np.int32)]
        use = np.flatnonzero(posting >= 0)
        starts = np.array(row["starts"], dtype=np.int64)
        docs = np.repeat(np.arange(len(lengths)), np.diff(starts))[use]
        tf = np.frombuffer(row["posting_counts"], dtype=np.int32)[use].astype(np.int64)
        # 75 * n * documents may pass 64 bits only beyond 10^17 words by documents; Python integers where it could
        product = lengths * (75 * self.n_docs) if int(lengths.max(initial=0)) * 75 * self.n_docs < 2**63 else np.array([75 * int(n) * self.n_docs for n in lengths], dtype=object)
        m = (25 + product // self.n_terms).astype(np.int64)
        base = (1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])
        matched = posting[use]
        asked_starts = np.array(row["asked_starts"], dtype=np.int64)
        asked_by = np.frombuffer(row["asked_by"], dtype=np.int32).astype(np.int64)
        of_entry = np.repeat(np.arange(len(asked_starts) - 1), np.diff(asked_starts))
        factor = np.frombuffer(row["repeats"], dtype=np.int64) * np.array(row["weights"], dtype=np.int64)[of_entry]
        doc_ids = row["doc_ids"]
        for low in range(0, len(row["items"]), RANGE):
            here = np.flatnonzero((asked_by >= low) & (asked_by < low + RANGE))
            own = np.concatenate(([0], np.cumsum(np.bincount(of_entry[here], minlength=len(asked_starts) - 1))))
            scores = _accumulate(matched, docs, base, own, asked_by[here], factor[here], low)
            for item, score in zip(row["items"][low : low + RANGE], scores, strict=False):
                self._offer(item, score, doc_ids)

    def _offer(self, item, score: np.ndarray, doc_ids: list) -> None:
        heap = self.best.setdefault(item, [])
        least = max(1, -heap[-1][0]) if len(heap) == self.k else 1
        hits = np.flatnonzero(score >= least)
        if len(hits) > self.k:
            least = np.partition(score[hits], len(hits) - self.k)[len(hits) - self.k]
            hits = hits[score[hits] >= least]
        if len(hits):
            new = [(-int(score[i]), doc_ids[i] is None, doc_ids[i] or 0) for i in hits]
            self.best[item] = heapq.nsmallest(self.k, heap + new)

    def rows(self) -> pa.RecordBatch:
        out = [(item, None if none else doc, -score) for item, heap in self.best.items() for score, none, doc in heap]
        return pa.RecordBatch.from_pylist([dict(zip(("item_id", "doc_id", "score"), x, strict=True)) for x in out], schema=_arrow(BEST))


def search(docs: DataFrame, items: DataFrame, k: int = 10, blocks: DataFrame | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item. blocks: an index of docs made before."""
    spark = docs.sparkSession
    with temporary(spark) as keep:
        blocks = index(docs) if blocks is None else blocks
        n_docs, n_terms = statistics(blocks)
        asked = materialise(item_terms(items), "asked")
        questions = materialise(question_blocks(asked, documents_with(blocks), n_docs), "questions", GROUP)
        best = _scored(blocks, questions, n_docs, n_terms, k)
        keep(best)
    by = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _scored(blocks: DataFrame, questions: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    slots = parts(blocks.sparkSession) * SLOTS
    held = F.octet_length("asked_by") + F.octet_length("repeats") + F.aggregate("terms", F.lit(0), lambda a, t: a + F.octet_length(t) + 16)
    last, size = questions.agg(F.max("question"), F.sum(held)).first()
    every = F.array().cast("array<bigint>") if last is None else F.sequence(F.lit(0).cast("long"), F.lit(int(last)).cast("long"))
    left = blocks.drop("docs_with").withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots))).withColumn("question", F.explode(every))
    right = questions.withColumnsRenamed({"terms": "asked", "starts": "asked_starts"})
    if size is not None and size <= SENT:
        keys, right = ["question"], F.broadcast(right)
    else:
        keys = ["question", "slot"]
        right = right.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))).hint("shuffle_hash")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(n_docs, n_terms, k)
        for batch in batches:
            for i in range(batch.num_rows):
                arrays = {"terms", "asked"}
                scorer.add({name: batch.column(name)[i].values if name in arrays else batch.column(name)[i].as_py() for name in batch.schema.names})
        yield scorer.rows()

    with settings(blocks.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="4"):
        pairs = left.join(right, keys).drop("slot", "question", "block")
        return materialise(pairs.mapInArrow(score, BEST), "best")


def op11_ranked_search(spark, sf_dir):
    from .common import table

    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


SQL = r"""
WITH raw AS (
  SELECT doc_id, row_number() OVER () AS row_no,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT doc_id, row_no, len(ts) AS n, unnest(ts) AS term FROM raw WHERE len(ts) > 0),
p AS (SELECT row_no, doc_id, n, term, count(*) AS tf FROM d GROUP BY ALL),
c AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM raw WHERE len(ts) > 0),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT n_docs FROM c) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY term),
q AS (
  SELECT item_id, term, count(*) AS r FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
i AS (
  SELECT row_no, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * (SELECT n_docs FROM c)) // (SELECT n_terms FROM c))) AS x FROM p),
s AS (SELECT item_id, row_no, doc_id, sum(r * w * x)::BIGINT AS score FROM q JOIN w USING (term) JOIN i USING (term) GROUP BY ALL),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS place FROM s WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM o WHERE place <= 10
"""
