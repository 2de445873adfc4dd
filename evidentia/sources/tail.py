"""Growing line files as a streaming source: every complete line once, from where the last batch ended.

The offset of a stream is a map of file to the byte after its last complete line and a mark, the SHA-256
of the 4 KiB before that byte. A file that is shorter than its offset, or holds something else before it, was
replaced and is read again from its start. A last line without a line feed waits for the batch in which it ends.
New bytes of a file are dealt into ranges of split_bytes, so one large file is read by many tasks and none holds it whole.

Options: path (a folder; any file system that pyarrow knows), glob (of the path below it), start ("beginning", or "end" to begin
with the lines added after the first start), max_bytes (a batch stops at the line in which so many new bytes
end; the stream's checkpoint folder must then be given as checkpoint, so that a restarted reader knows where
it stands), split_bytes, delete_idle (seconds: files read to their end and not written to for so long are deleted
once their batch is done), on_bad ("skip" lines that are not UTF-8, or "replace" their bad bytes).
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MARK_BYTES = 4096
WINDOW = 1 << 16
SPLIT_BYTES = 8 << 20


@dataclass
class Range(InputPartition):
    """Lines of a file that start at a byte from start on and before stop; the lines end by end."""

    path: str
    start: int
    stop: int
    end: int
    from_line: bool


class Files:
    """The files below a folder, by their full names."""

    def __init__(self, path: str, glob: str):
        from pyarrow import fs

        uri = path if re.match(r"[a-z][a-z0-9+.-]*:", path) else "file://" + path
        self.fs, self.root = fs.FileSystem.from_uri(uri)
        self.root, self.glob = self.root.rstrip("/"), glob
        self.prefix = "file://" if uri.startswith("file:") else uri[: uri.index(self.root)] if self.root in uri else uri

    def listed(self) -> dict[str, tuple[int, float]]:
        """Size and time of the last change of every file that matches."""
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        below = lambda f: f.path[len(self.root) :].lstrip("/")
        return {self.prefix + f.path: (f.size, f.mtime.timestamp() if f.mtime else 0.0) for f in found if f.is_file and (fnmatch(below(f), self.glob) or fnmatch(f.base_name, self.glob))}

    def open(self, name: str):
        return self.fs.open_input_file(name.removeprefix(self.prefix))

    def size(self, name: str) -> int | None:
        info = self.fs.get_file_info(name.removeprefix(self.prefix))
        return info.size if info.is_file else None

    def remove_if(self, name: str, size: int) -> bool:
        """Delete a file of this size. It is moved aside first: one that grew meanwhile goes back."""
        path = name.removeprefix(self.prefix)
        aside = path + ".read"
        self.fs.move(path, aside)
        if self.fs.get_file_info(aside).size != size:
            self.fs.move(aside, path)
            return False
        self.fs.delete_file(aside)
        return True


def whole_lines(handle, size: int, known: int = 0) -> int:
    """The byte after the last line feed before size; a line feed is known to end at `known`."""
    at = size
    while at > known:
        low = max(known, at - WINDOW)
        handle.seek(low)
        found = handle.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return known


def mark(handle, end: int) -> str:
    low = max(0, end - MARK_BYTES)
    handle.seek(low)
    return hashlib.sha256(handle.read(end - low)).hexdigest()


def lines_of(handle, part: Range) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines that start in a range."""
    at = part.start
    if not part.from_line:  # the line that runs into the range is another's
        handle.seek(at - 1)
        rest, at = b"", at - 1
        while b"\n" not in rest and at + len(rest) < part.end:
            at += len(rest)
            rest = handle.read(min(WINDOW, part.end - at))
            if not rest:
                return
        at += rest.find(b"\n") + 1
    handle.seek(at)
    held = b""
    while at < part.stop:
        while (feed := held.find(b"\n")) < 0:
            more = handle.read(min(WINDOW, part.end - at - len(held)))
            if not more:
                return
            held += more
        yield at, held[:feed]
        at, held = at + feed + 1, held[feed + 1 :]


class _Options:
    def __init__(self, options: dict):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.glob = low["path"], low.get("glob", "*.jsonl")
        self.start, self.on_bad, self.checkpoint = low.get("start", "beginning"), low.get("on_bad", "skip"), low.get("checkpoint")
        self.max_bytes, self.split_bytes = int(low.get("max_bytes", 0)), int(low.get("split_bytes", SPLIT_BYTES))
        self.delete_idle = float(low["delete_idle"]) if "delete_idle" in low else None
        if self.start not in ("beginning", "end") or self.on_bad not in ("skip", "replace"):
            raise ValueError("start is beginning or end; on_bad is skip or replace")

    def files(self) -> Files:
        return Files(self.path, self.glob)

    def ranges(self, name: str, start: int, end: int) -> list[Range]:
        return [Range(name, at, min(end, at + self.split_bytes), end, at == start) for at in range(start, end, self.split_bytes)]

    def read(self, part: Range) -> Iterator[tuple]:
        try:
            handle = self.files().open(part.path)
        except FileNotFoundError:  # deleted since it was listed
            return
        with handle:
            for offset, line in lines_of(handle, part):
                try:
                    yield line.decode("utf-8", "strict" if self.on_bad == "skip" else "replace"), part.path, offset
                except UnicodeDecodeError:
                    continue


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = _Options(options)

    def partitions(self) -> list[Range]:
        files, out = self.options.files(), []
        for name, (size, _) in sorted(files.listed().items()):
            with files.open(name) as handle:
                out += self.options.ranges(name, 0, whole_lines(handle, size))
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.options.read(partition)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = _Options(options)
        self.seen: dict[str, tuple] = {}
        self.handed: dict[str, list] | None = None

    def _entry(self, files: Files, name: str, info: tuple[int, float], most: int | None = None, known: list | None = None) -> list:
        """End of the last whole line and its mark; at most `most` bytes past the known end, but for the line in which these end."""
        size, _ = info
        if most is None and self.seen.get(name, (None,))[0] == info:
            return self.seen[name][1]
        with files.open(name) as handle:
            start = self._from(handle, size, known)
            end = whole_lines(handle, size, start)
            if most is not None and end - start > most:
                cut = whole_lines(handle, start + most, start)
                end = cut if cut > start else next((at for at, _ in self._ends(handle, start, end)), end)
            entry = [end, mark(handle, end)]
        if most is None:
            self.seen[name] = info, entry
        return entry

    @staticmethod
    def _ends(handle, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        for at, line in lines_of(handle, Range("", start, end, end, True)):
            yield at + len(line) + 1, line

    @staticmethod
    def _from(handle, size: int, known: list | None) -> int:
        """Where to read on: the known end, or 0 if the file is shorter or holds something else before it."""
        if not known or size < known[0] or (known[0] and mark(handle, known[0]) != known[1]):
            return 0
        return known[0]

    def initialOffset(self) -> dict:
        files = self.options.files()
        if self.options.start == "beginning":
            return {"files": {}}
        return {"files": {name: self._entry(files, name, info) for name, info in files.listed().items()}}

    def _last(self) -> dict[str, list]:
        """Offsets up to which batches were planned: this reader's own, or those in the stream's log."""
        if self.handed is None and self.options.checkpoint:
            log = Files(self.options.checkpoint.rstrip("/") + "/offsets", "*")
            batches = [name for name in log.listed() if name.rpartition("/")[2].isdigit()]
            if batches:
                with log.open(max(batches, key=lambda name: int(name.rpartition("/")[2]))) as handle:
                    self.handed = json.loads(handle.read().decode().splitlines()[-1])["files"]
        if self.handed is None:
            self.handed = self.initialOffset()["files"]
        return self.handed

    def latestOffset(self) -> dict:
        files, found = self.options.files(), {}
        left = self.options.max_bytes
        known = self._last() if left else {}
        for name, info in sorted(files.listed().items()):
            try:
                if not self.options.max_bytes:
                    found[name] = self._entry(files, name, info)
                elif left > 0:
                    found[name] = self._entry(files, name, info, left, known.get(name))
                    left -= max(0, found[name][0] - (known[name][0] if name in known and found[name][0] >= known[name][0] else 0))
                elif name in known:
                    found[name] = known[name]
            except FileNotFoundError:
                continue
        self.handed = found
        return {"files": found}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files, out = self.options.files(), []
        for name, (stop, stamp) in sorted(end["files"].items()):
            known = start["files"].get(name)
            if known == [stop, stamp]:
                continue
            try:
                with files.open(name) as handle:
                    # `stop` stands for the file's size: what came after the offset was taken is for the next batch
                    out += self.options.ranges(name, self._from(handle, stop, known), stop)
            except FileNotFoundError:
                continue
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.options.read(partition)

    def commit(self, end: dict) -> None:
        if self.options.delete_idle is None:
            return
        files, now = self.options.files(), time.time()
        for name, (size, changed) in files.listed().items():
            if end["files"].get(name, [None])[0] == size and now - changed > self.options.delete_idle:
                try:
                    files.remove_if(name, size)
                except OSError:  # gone already, or still being written
                    continue


class LineTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return "value string, path string, offset long"

    def reader(self, schema) -> LinesReader:
        return LinesReader(dict(self.options))

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail(spark: SparkSession, path: str, *, stream: bool = True, **options) -> DataFrame:
    """value, path, offset of complete lines below path, as they come (or those there are now)."""
    spark.dataSource.register(LineTail)
    reader = spark.readStream if stream else spark.read
    return reader.format("line_tail").options(path=path, **options).load()
