"""Shared pieces of the training-data operators: scratch tables, word rule, folds."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured and Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_scopes: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/evidentia/{uuid.uuid4().hex}/{name}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession):
    """Deletes the scratch tables made inside when it ends, but for those passed to what it yields."""
    own: list[str] = []
    kept: set[str] = set()

    def keep(*tables: DataFrame) -> None:
        kept.update(t._scratch for t in tables)

    _scopes.append(own)
    try:
        yield keep
    finally:
        _scopes.pop()
        for path in own:
            if path in kept:
                if _scopes:
                    _scopes[-1].append(path)
            else:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def settings(spark: SparkSession, **conf: str):
    """Session settings for the jobs inside the block; keys use __ for a dot."""
    old = {}
    for key, value in conf.items():
        key = key.replace("__", ".")
        old[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def materialise(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    Shuffle files of the write are removed when it ends. group: rows of a row group at most, for rows of megabytes: Parquet's
    writer looks at the size of what it holds only after 100 rows, and its reader fills its arrays by row groups.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with settings(spark, **{_CLEAN: "true"}):
        (df.write.option("parquet.block.row.count.limit", group) if group else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0)).cast("int")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
