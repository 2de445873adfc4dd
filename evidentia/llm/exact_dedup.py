"""Exact deduplication with keyed streaming state.

A store is a folder with the content of every row taken in so far (normalised text, digest, id), the
state and the groups. Each intake has a name; its rows are staged and then appear in the content by one rename,
so a row's locator is its intake's number and its place there. A structured stream reads digests, ids and
locators of new content and keeps per digest, in RocksDB and without expiry, the smallest (id, locator), the
oldest locator and the count. Its batches write the groups that they changed; an intake reads back those
written since it began.

An intake that died at any point is repeated under its name: rows that had appeared are not taken in
again and are judged as in an undisturbed run, staged rows that had not appeared count for nothing. One intake runs at a time.

Where a digest that rows of this intake have was seen more than once, the hit rows and the oldest row are
fetched by their locators from the intakes that hold them, and their full bytes are compared, in each task first. Rows of
digests whose bytes differ form groups by the text itself.

Defined cases: null text counts as empty; a null id sorts first; of rows that repeat an id and a
text exactly one stays; very long texts are compared whole; extra columns are not read by dedup and kept by
keep_first, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import SPACE, fresh, materialise, scratch, settings, temporary

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


CONTENT = "intake int, at long, digest string, doc_id {id}, body string"
_LOCATOR = ("intake", "at")


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", *_LOCATOR)).alias("first")


def keyed_state(rows: DataFrame) -> DataFrame:
    """The stateful operator on a stream of (intake, at, digest, doc_id): per digest its first and oldest row and its count."""
    return rows.groupBy("digest").agg(_first(), F.min(F.struct(*_LOCATOR)).alias("oldest"), F.count(F.lit(1)).alias("group_size"))


class Store:
    """The folder of a deduplication that goes on from intake to intake."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path, self.content_schema = spark, path.rstrip("/"), CONTENT.format(id=id_type)
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _folders(self, name: str) -> list[int]:
        return sorted(int(x.partition("=")[2]) for x in self._names(name) if "=" in x)

    def _intakes(self) -> dict[str, tuple[int, int, str]]:
        """By name: number, groups' batches before it, folder. A folder is number, batches and the name in hex."""
        found = {}
        for folder in self._names("content"):
            number, since, name = folder.split("-")
            found[bytes.fromhex(name).decode()] = int(number), int(since), f"{self.path}/content/{folder}"
        return found

    def intakes(self) -> list[str]:
        """Names of the intakes whose rows are in the content, oldest first."""
        return sorted(found := self._intakes(), key=found.get)

    def add(self, docs: DataFrame, digest, intake: str) -> tuple[int, int]:
        """Let docs(doc_id, text) appear in the content, unless this intake's rows did; its number and the batches before it."""
        if (known := self._intakes().get(intake)) is None:
            number, since = len(self._intakes()), len(self._folders("groups"))
            body = normalised(docs["text"])
            rows = docs.select(F.lit(number).alias("intake"), F.monotonically_increasing_id().alias("at"), digest(body).alias("digest"), "doc_id", body.alias("body"))
            staged = f"staged/{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{staged}")
            self.fs.mkdirs(self._path("content"))
            if not self.fs.rename(self._path(staged), self._path("content", f"{number:09d}-{since}-{intake.encode().hex()}")):
                raise OSError(f"intake {intake!r} could not appear in {self.path}")
            known = number, since, ""
        return known[:2]

    def content(self, numbers: set[int] | None = None) -> DataFrame:
        """Rows of the intakes with these numbers, or of all."""
        return self.spark.read.schema(self.content_schema).parquet(*[path for n, _, path in self._intakes().values() if numbers is None or n in numbers])

    def advance(self, **limits: str) -> None:
        """Take all new content through the state; each batch's changed groups become a part of the groups."""
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.path}/groups/batch={number}")

        with settings(self.spark, **_STATE):
            rows = self.spark.readStream.schema(self.content_schema).options(**limits, recursiveFileLookup="true").parquet(f"{self.path}/content").select(*_LOCATOR, "digest", "doc_id")
            stream = keyed_state(rows)
            self.shape = stream.schema
            stream.writeStream.outputMode("update").option("checkpointLocation", f"{self.path}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()

    def groups(self, since: int = 0) -> DataFrame:
        """The state's last word on every digest that batches from number `since` on changed."""
        batches = [n for n in self._folders("groups") if n >= since]
        if not batches:
            return self.spark.createDataFrame([], self.shape)
        shape = StructType([*self.shape.fields, StructField("batch", IntegerType())])
        rows = self.spark.read.schema(shape).option("basePath", f"{self.path}/groups").parquet(*[f"{self.path}/groups/batch={n}" for n in batches])
        if len(batches) == 1:
            return rows.drop("batch")
        return materialise(rows.groupBy("digest").agg(F.max_by(F.struct("first", "oldest", "group_size"), "batch").alias("x")).select("digest", "x.*"), "groups")

    def clashes(self, number: int, groups: DataFrame) -> DataFrame | None:
        """Digests with rows of different bytes, of this intake and earlier ones; None if there are none."""
        rows = self.content({number}).select(*_LOCATOR, "digest")
        several = groups.filter("group_size > 1")
        hits = rows.join(several.select("digest", "oldest"), "digest")
        fetch = hits.select("intake", "at").unionByName(hits.select("oldest.intake", "oldest.at")).distinct()
        with settings(self.spark, spark__sql__autoBroadcastJoinThreshold="-1"):  # one plan at every size
            fetch = materialise(fetch, "hits")
            held = {r[0] for r in fetch.select("intake").distinct().collect()}  # at most one row an intake
            fetched = self.content(held | {number}).join(fetch, [*_LOCATOR], "left_semi")
            met = fetched.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
            met.filter("low <> high").select("digest").write.mode("overwrite").parquet(f"{self.path}/clashes/number={number}")
        found = self.spark.read.schema("digest string").parquet(*[f"{self.path}/clashes/number={n}" for n in self._folders("clashes")])
        return None if found.isEmpty() else found.distinct()


def dedup(docs: DataFrame, digest=sha256, store: str | None = None, intake: str | None = None, **limits: str) -> DataFrame:
    """doc_id, intake, at, keep_id, group_size, kept, digest for every row of docs(doc_id, text).

    store: a folder that keeps content and state from call to call; rows are judged beside all that were
    taken in before them. It needs intake, the name of these rows: a call that died is repeated under the same
    name. Without a store a scratch folder is used once. digest may be any function of the
    normalised text; rows that only share it are told apart. limits: reader options of the stream, such
    as maxFilesPerTrigger.
    """
    if store and not intake:
        raise ValueError("a store needs the intake's name, so that an intake which died can be repeated")
    spark = docs.sparkSession
    held = Store(spark, store or scratch(spark, "store"), docs.schema["doc_id"].dataType.simpleString())
    number, since = held.add(docs.select("doc_id", "text"), digest, intake or "only")
    held.advance(**limits)
    groups = held.groups(since)
    clash = held.clashes(number, groups)
    own = held.content({number})
    out = _decided(own.drop("body").join(groups.drop("oldest"), "digest"))
    if clash is not None:
        rows = materialise(held.content().join(clash, "digest", "left_semi"), "apart")
        sizes = materialise(rows.groupBy("body").agg(_first(), F.count(F.lit(1)).alias("group_size")), "apart_groups")
        out = out.join(clash, "digest", "left_anti").unionByName(_decided(rows.filter(F.col("intake") == number).join(sizes, "body")))
    return out


def _decided(rows: DataFrame) -> DataFrame:
    kept = (F.col("intake") == F.col("first.intake")) & (F.col("at") == F.col("first.at"))
    return rows.select("doc_id", *_LOCATOR, F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "digest")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns; rows repeated under one id leave one."""
    digest = sha256(normalised(docs["text"]))
    with temporary(docs.sparkSession) as keep:
        found = materialise(dedup(docs), "decisions")
        dropped = found.groupBy("doc_id", "digest").agg(F.max("kept").alias("any"), F.count(F.lit(1)).alias("n"))
        dropped = materialise(dropped, "by_id")
        keep(dropped)
    own = fresh(docs, "_digest")[0]
    tagged = docs.withColumn(own, digest)
    on = lambda other: tagged["doc_id"].eqNullSafe(other["doc_id"]) & (tagged[own] == other["digest"])
    gone, twice = dropped.filter("NOT any"), dropped.filter("any AND n > 1")
    out = tagged.join(gone.hint("shuffle_hash"), on(gone), "left_anti")
    if not twice.isEmpty():
        once = tagged.join(twice, on(twice), "left_semi").dropDuplicates(["doc_id", own])
        out = out.join(twice, on(twice), "left_anti").unionByName(once)
    return out.select(*docs.columns)


def op3_exact_dedup(spark, sf_dir):
    from .common import table

    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
