"""Folders that are replaced as a whole: generations of segments behind one versioned pointer.

A store is a folder of segments (each with its tables, written once) and of pointers. A pointer is a small JSON text
that names the current generation, its segments and what its owner wants to remember. A new one is written
aside and takes the next version's name by a rename that fails if that name is taken, so a reader sees the old state
or the new one and never a part of either, and of two writers one is told that it lost. Segments that no
recent pointer names are removed by vacuum.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

EMPTY = {"version": 0, "generation": 0, "segments": [], "deleted": []}


class Conflict(RuntimeError):
    """Another writer changed the store meanwhile."""


class Generations:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def _text(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("pointers") if n.isdigit())

    def state(self, version: int | None = None) -> dict:
        """The current state, or an earlier one."""
        versions = self.versions()
        if not versions:
            return dict(EMPTY)
        return json.loads(self._text(f"pointers/{versions[-1] if version is None else version:012d}"))

    def commit(self, before: dict, **changes) -> dict:
        """The state after `before`, with changes. Conflict if it isn't the latest any more."""
        after = before | changes | {"version": before["version"] + 1}
        self.fs.mkdirs(self._at("pointers"))
        aside = f"pointers/{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self._at(aside), False)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        name = self._at(f"pointers/{after['version']:012d}")
        if self.fs.exists(name) or not self.fs.rename(self._at(aside), name):
            self.fs.delete(self._at(aside), False)
            raise Conflict(f"version {after['version']} of {self.path} is another writer's")
        return after

    def segment(self) -> str:
        """A name for a new segment's folder."""
        return f"segments/{uuid.uuid4().hex}"

    def write(self, rows: DataFrame, segment: str, table: str) -> None:
        rows.write.parquet(f"{self.path}/{segment}/{table}")

    def read(self, segments: list[str], table: str, schema) -> DataFrame:
        paths = [f"{self.path}/{s}/{table}" for s in segments]
        paths = [p for p in paths if self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove segments that none of the last `keep` states name, and older pointers. A reader of those states is safe."""
        versions = self.versions()
        named = {s.partition("/")[2] for v in versions[-keep:] for s in [*self.state(v)["segments"], *self.state(v)["deleted"]]}
        gone = [s for s in self._names("segments") if s not in named]
        for s in gone:
            self.fs.delete(self._at(f"segments/{s}"), True)
        for v in versions[:-keep]:
            self.fs.delete(self._at(f"pointers/{v:012d}"), False)
        return gone
