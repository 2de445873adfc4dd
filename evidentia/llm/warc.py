r"""WARC archives and a merged capture index.

A page becomes a WARC 1.1 record as text: header lines, an HTTP header and the payload. Spark's text
writer ends each record with the blank lines that the format asks for, so part files are archives.
Of records with one payload of at least 1000 bytes the one with the largest id is the response and
the others are revisits without a body. Reading parses the archives by Content-Length, digests each
response's payload again, and leaves one run of the capture index per archive, sorted by URL key,
time and id. Runs are cut at common keys into ranges, and each range is merged from its slices of the
runs by a loser tree, so ranges in order hold the capture histories in global order. The number of
ranges follows the number of records, and cuts may fall between any two records, those of one URL
too: a merging task holds about RANGE_ROWS index entries (never payloads), whatever the table's size.

Copies of one payload meet its response under one of SALTS salts, so no payload is a hot key.

Defined cases: null html is an empty payload; a null url is written as an empty one; a URL that cannot be parsed is
its own key; records with a
null id refer to a known one if there is one, else each is a response; equal rows are written twice;
an empty table gives an empty archive and index; a very long payload is one record, and a file of its
own size; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, parts, scratch, settings

LEAST_REVISIT = 1000
FILE_BYTES = 16 << 20
RANGE_ROWS = 100_000
SALTS = 16
BATCH_ROWS = 10_000
END = "\r\n\r\n"
INDEX = "page_id long, url_key string, captured timestamp, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, at long, length long"
INDEX_TYPES = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url_key", pa.string()),
        ("captured", pa.timestamp("us", "UTC")),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("run", pa.string()),
        ("at", pa.int64()),
        ("length", pa.int64()),
    ]
)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit("\r\n"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _date(page_id: Column) -> Column:
    at = F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.abs(page_id) % 100_000_000, F.lit(0)))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(pages: DataFrame) -> DataFrame:
    """page_id, record (text of a WARC record without its end) for pages(page_id, url, html)."""
    payload = F.coalesce(pages["html"], F.lit(""))
    url = F.regexp_replace(F.coalesce(pages["url"], F.lit("")), r"[\x00-\x20\x7F]", "%20")
    rows = pages.select("page_id", url.alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("n"), F.sha1(payload.cast("binary")).alias("digest"))
    groups = rows.filter(F.col("n") >= LEAST_REVISIT).groupBy("digest", "n").agg(F.max("page_id").alias("first"), F.max_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("copies"))
    groups = materialise(groups.filter("copies > 1").drop("copies"), "copies")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(groups, ["digest", "n", "salt"], "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    refers = F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
        _line("WARC-Refers-To", _urn(F.col("first"))),
        _line("WARC-Refers-To-Target-URI", F.col("first_url")),
        _line("WARC-Refers-To-Date", _date(F.col("first"))),
    )
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", _date(F.col("page_id"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, refers).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select("page_id", F.concat(head, F.lit("\r\n"), block).alias("record"))


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Gzipped WARC files of about file_bytes of records below path."""
    size = pages.agg(F.avg(F.octet_length(F.coalesce("html", F.lit(""))))).first()[0] or 0
    records(pages).select("record").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(file_bytes / (size + 600)))).text(path)


def url_key(url: str) -> str:
    """Host labels from the top level down, then path and query, in lower case: equal for the same resource.

    A URL that cannot be parsed (an open bracket, characters that make no host name) has itself as its key, in
    lower case after a bracket, so such URLs stand together.
    """
    try:
        split = urlsplit(url if "//" in url else "//" + url)
        host = (split.hostname or "").removeprefix("www.")
    except ValueError:
        return ")" + url.lower()
    tail = split.path + ("?" + split.query if split.query else "")
    return f"{','.join(reversed(host.split('.')))}){tail.lower()}"


def parse_archive(data: bytes) -> Iterator[tuple[dict, bytes, int, int]]:
    """Headers, block, offset and length of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if lines[0] != "WARC/1.1" or data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"no WARC record at {at}")
        yield headers, data[start:stop], at, stop + 4 - at
        at = stop + 4


def _page(urn: str | None) -> int | None:
    found = (urn or "")[len("<urn:page:") : -1]
    return int(found) if found else None


def _gunzip(data: bytes) -> bytes:
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def _runs(files: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in files:
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
            rows = []
            for headers, block, at, length in parse_archive(_gunzip(content)):
                http, _, body = block.partition(b"\r\n\r\n")
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(http.rpartition(b"Content-Length: ")[2])
                if headers["WARC-Type"] == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
                captured = datetime.fromisoformat(headers["WARC-Date"])
                rows.append((_page(headers["WARC-Record-ID"]), url_key(headers["WARC-Target-URI"]), captured, size, digest, headers["WARC-Type"], _page(headers.get("WARC-Refers-To")), path, at, length))
            rows.sort(key=lambda row: _order(row[1], row[2], row[0], row[7], row[8]))
            for start in range(0, len(rows), BATCH_ROWS):
                columns = zip(*rows[start : start + BATCH_ROWS], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, INDEX_TYPES, strict=True)], schema=INDEX_TYPES)


def _order(url: str, captured, page: int | None, run: str, at: int) -> tuple:
    return url, captured, page is not None, page or 0, run, at


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The capture index of all archives below path, one sorted run per archive."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    with settings(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.files.maxPartitionBytes": "8m"}):
        return materialise(files.mapInArrow(_runs, INDEX), "runs")


def loser_tree_merge(runs: list[list], key) -> Iterator:
    """Merge sorted runs; the tree holds at each inner node the run that lost there."""
    k = len(runs)
    if k == 0:
        return
    at = [0] * k
    heads = [(0, key(r[0]), i) if r else (1, (), i) for i, r in enumerate(runs)]
    tree = [-1] * k

    def replay(i: int) -> int:
        node, winner = (i + k) // 2, i
        while node > 0:
            if tree[node] < 0:
                tree[node] = winner
                return -1
            if heads[tree[node]] < heads[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        return winner

    winner = 0
    for i in range(k):
        if (top := replay(i)) >= 0:
            winner = top
    while heads[winner][0] == 0:
        run = runs[winner]
        yield run[at[winner]]
        at[winner] += 1
        heads[winner] = (0, key(run[at[winner]]), winner) if at[winner] < len(run) else (1, (), winner)
        winner = replay(winner) if k > 1 else 0


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the slices of one range: entries stay in columns, runs are lists of their positions."""
    batches = list(batches)
    if not batches:
        return
    held = pa.Table.from_batches(batches)
    keys = [held["url_key"].to_pylist(), held["captured"].cast(pa.int64()).to_pylist(), held["page_id"].to_pylist(), held["run"].to_pylist(), held["at"].to_pylist()]
    runs: dict[str, list[int]] = {}
    for i, run in enumerate(keys[3]):
        runs.setdefault(run, []).append(i)
    order = list(loser_tree_merge(list(runs.values()), lambda i: _order(*(k[i] for k in keys))))
    for start in range(0, len(order), BATCH_ROWS):
        some = held.take(order[start : start + BATCH_ROWS])
        yield from some.append_column("place", pa.array(range(start, start + len(some)), pa.int64())).to_batches()


def merge_runs(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The index in global order: by range, then place. Every range is merged from its slices of the runs."""
    keys = ["url_key", "captured", "page_id", "run", "at"]
    ranges = ranges or max(parts(runs.sparkSession), runs.count() // RANGE_ROWS + 1)
    sliced = runs.repartitionByRange(ranges, *keys).sortWithinPartitions("run", *keys)
    return sliced.mapInArrow(_merged, INDEX + ", place long").withColumn("range", F.spark_partition_id())


def histories(merged: DataFrame) -> DataFrame:
    """The merged index with position: an entry's place, from 0, among all entries of all ranges."""
    merged = materialise(merged, "merged")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row a range, of about RANGE_ROWS entries each
    starts = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return merged.join(starts.select("range", "start"), "range").withColumn("position", F.col("start") + F.col("place")).drop("start")


def op10_warc(spark, sf_dir):
    from .common import table

    path = scratch(spark, "warc")
    with settings(spark, **{"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    index = histories(merge_runs(capture_runs(spark, path)))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


SQL = r"""
WITH u AS (SELECT *, regexp_replace(coalesce(url, ''), '[\x00-\x20\x7F]', '%20', 'g') AS u FROM pages),
p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www[.]', ''), '.')), ',')
      || ')' || lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^#]*)', 1)) AS url_key FROM u),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, url_key, row_number() OVER (ORDER BY url_key, page_id % 100000000, page_id) - 1 AS position FROM g
"""
