"""Blocks of rows against blocks of questions, as a keyed join.

A search scores many rows for many questions. Rows are held in blocks (one row of arrays each, of bounded
size), questions are dealt into blocks of their own, and every pair of the two is made by a join on (question block,
slot): question blocks are repeated once a slot, as a broadcast would, but through a shuffle, so the plan doesn't
grow with the questions and they don't pass through the driver. A single question block of a measured small size is
broadcast instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Questions of a block, on average; slots for each shuffle partition.
QUESTIONS, SLOTS = 256, 4
#: Bytes of questions that may be broadcast.
SENT = 4 << 20
#: Rows of a block at most.
ROWS = 1024

_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow_type(kind: str) -> pa.DataType:
    kind = {"bigint": "long"}.get(kind, kind)
    return pa.list_(arrow_type(kind[6:-1])) if kind.startswith("array<") else _ARROW[kind]


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, arrow_type(kind)) for name, kind in (x.split() for x in ddl.split(", "))])


def deal(queries: DataFrame, columns: list[str], per_block: int | None = None) -> tuple[DataFrame, int]:
    """One row a question block: `question`, and an array of each column; and how many blocks there are."""
    n = max(1, -(-queries.count() // (per_block or QUESTIONS)))
    rows = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("question"), F.struct(*columns).alias("q"))
    # a null item keeps its place: the structs are collected whole and taken apart afterwards
    held = rows.groupBy("question").agg(F.collect_list("q").alias("q"))
    return held.select("question", *[F.col(f"q.{c}").alias(f"q_{c}") for c in columns]), n


def pairs(blocks: DataFrame, questions: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """Every block beside every question block. blocks: block (a long) and arrays; questions: from deal, already written.

    One question block whose measured size is within SENT bytes is broadcast; else both sides are dealt by (question, slot).
    most: slots at most, where question blocks are large.
    """
    if n == 1 and (questions.select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(F.sum("b")).first()[0] or 0) <= SENT:
        return blocks.withColumn("question", F.lit(0).cast("long")).join(F.broadcast(questions), "question")
    slots = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) * SLOTS
    slots = min(slots, most or slots)
    every = lambda upto: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(upto - 1).cast("long")))
    left = blocks.withColumn("_slot", F.pmod(F.xxhash64("block"), F.lit(slots))).withColumn("question", every(n))
    right = questions.withColumn("_slot", every(slots)).hint("shuffle_hash")
    return left.join(right, ["question", "_slot"]).drop("_slot")


def each(frame: DataFrame, task: Callable[[], tuple[Callable[[dict], None], Callable[[], list[tuple]]]], schema: str, raw: tuple[str, ...] = ()) -> DataFrame:
    """Run a task over the pairs of a partition: task() gives what takes a pair and what gives the rows at the end.

    Columns named in raw come as Arrow arrays, others as Python values.
    """
    shape = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, rows = task()
        for batch in batches:
            for i in range(batch.num_rows):
                take({name: batch.column(name)[i].values if name in raw else batch.column(name)[i].as_py() for name in batch.schema.names})
        out = rows()
        columns = zip(*out, strict=True) if out else [[] for _ in shape]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    return frame.mapInArrow(run, schema)


class Best:
    """The k best rows of each question seen so far, by a sort key (smaller is better)."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def floor(self, query) -> tuple | None:
        """The k-th best key, or None if there are fewer."""
        held = self.held.get(query, ())
        return held[-1] if len(held) == self.k else None

    def offer(self, query, keys: list[tuple]) -> None:
        import heapq

        self.held[query] = heapq.nsmallest(self.k, [*self.held.get(query, ()), *keys])
