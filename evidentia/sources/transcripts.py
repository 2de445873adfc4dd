"""Readers of agent transcripts, documents, workspaces, device logs and benchmark files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions.security import redact, redaction_count
from evidentia.functions.text import strip_blocks
from evidentia.sources.tail import tail

_BLOCKS = "array<struct<type:string,text:string,name:string>>"
LINE = "value string, path string, offset long"


def lines(spark: SparkSession, path: str, *, stream: bool = False, **options) -> DataFrame:
    """value, path, offset of complete text lines below path; offset is a line's first byte in its file.

    A last line without a line feed is still being written and left for later. As a stream, lines appended to a known
    file come in the next batch (sources.tail has the options); offsets depend on the file alone, so
    turns read again carry the ids that they had.
    """
    if stream:
        return tail(spark, path, **options)
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.jsonl", **options}
    rows = spark.read.options(**options, lineSep="\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"))
    before = Window.partitionBy("path").orderBy("block", "at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("length", F.octet_length("value") + 1).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.filter(F.col("offset") + F.col("length") <= F.col("size")).select("value", "path", F.col("offset").cast("long").alias("offset"))


def _texts(content: Column) -> Column:
    """Text of a content field that is a string or an array of blocks; other blocks leave. A text that only starts like an array is a text."""
    blocks = F.from_json(content, _BLOCKS)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text")), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    is_array = (F.left(content, F.lit(1)) == "[") & blocks.isNotNull() & ((F.size(blocks) == 0) | F.exists(blocks, lambda b: b["type"].isNotNull()))
    return F.when(is_array, joined).otherwise(content)


def _get(path: str) -> Column:
    return F.get_json_object("value", path)


def format_a(rows: DataFrame) -> DataFrame:
    """response_item lines whose payload is a message."""
    rows = rows.filter((_get("$.type") == "response_item") & (_get("$.payload.type") == "message"))
    return rows.select("path", F.coalesce(_get("$.ordinal").cast("long"), F.col("offset")).alias("source_ordinal"), _get("$.timestamp").alias("said_at"), _get("$.payload.role").alias("role"), strip_blocks(_texts(_get("$.payload.content"))).alias("content"), F.lit(None).cast("string").alias("record_id"))


def format_b(rows: DataFrame) -> DataFrame:
    """user and assistant lines with text blocks, and prompts queued while the assistant worked; no side chains, meta lines or summaries."""
    queued = (_get("$.type") == "attachment") & (_get("$.attachment.type") == "queued_command") & (_get("$.attachment.commandMode") == "prompt") & ~_get("$.attachment.humanTurn").eqNullSafe("false")
    side = (_get("$.isSidechain") == "true") | (_get("$.isMeta") == "true") | (_get("$.isCompactSummary") == "true")
    rows = rows.filter(~F.coalesce(side, F.lit(False)) & (F.coalesce(queued, F.lit(False)) | _get("$.type").isin("user", "assistant")))
    content = F.when(queued, _texts(_get("$.attachment.prompt"))).otherwise(_texts(_get("$.message.content")))
    return rows.select("path", F.col("offset").alias("source_ordinal"), _get("$.timestamp").alias("said_at"), F.when(queued, "user").otherwise(_get("$.type")).alias("role"), strip_blocks(content).alias("content"), _get("$.uuid").alias("record_id"))


def nested_only(rows: DataFrame) -> DataFrame:
    """Of a desktop tree: transcripts of the projects folders, not those of sub-agents."""
    return rows.filter(F.col("path").contains("/projects/") & ~F.col("path").contains("/subagents/"))


def format_c(rows: DataFrame) -> DataFrame:
    """user.message and assistant.message events."""
    rows = rows.filter(_get("$.type").isin("user.message", "assistant.message"))
    return rows.select("path", F.col("offset").alias("source_ordinal"), _get("$.timestamp").alias("said_at"), F.substring_index(_get("$.type"), ".", 1).alias("role"), _get("$.data.content").alias("content"), _get("$.id").alias("record_id"))


def format_d(rows: DataFrame) -> DataFrame:
    """Lines whose only time is inside the user's text, carried on to the replies; user text is what user_query wraps."""
    text = _texts(_get("$.message.content"))
    stamp = r"<timestamp>\s*\w+, (\w{3} \d{1,2}, \d{4}, \d{1,2}:\d{2} [AP]M) \(UTC([+-]\d{1,2})?(?::(\d{2}))?\)\s*</timestamp>"
    found = rows.withColumn("text", text).withColumn("role", _get("$.role")).filter("role IN ('user', 'assistant') AND text IS NOT NULL")
    local = F.try_to_timestamp(F.regexp_extract("text", stamp, 1), F.lit("MMM d, yyyy, h:mm a"))
    shift = F.coalesce(F.regexp_extract("text", stamp, 2).try_cast("int"), F.lit(0)) * 60
    shift = shift + F.when(shift < 0, -1).otherwise(1) * F.coalesce(F.regexp_extract("text", stamp, 3).try_cast("int"), F.lit(0))
    own = F.when((F.col("role") == "user") & F.col("text").rlike(stamp), F.timestamp_micros(F.unix_micros(local) - shift.cast("long") * 60_000_000))
    order = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.regexp_extract("text", r"(?s)<user_query>\s*(.*?)\s*</user_query>", 1)
    said = F.when(F.col("role") == "assistant", F.col("text")).when(F.col("text").contains("<user_query>"), asked).otherwise(F.trim(F.regexp_replace("text", "(?s)<timestamp>.*?</timestamp>", "")))
    carried = F.last(own, ignorenulls=True).over(order)
    return found.select("path", F.col("offset").alias("source_ordinal"), F.date_format(carried, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("said_at"), "role", said.alias("content"), F.lit(None).cast("string").alias("record_id"))


def to_turns(messages: DataFrame, client: str, scopes: DataFrame | None = None, known_at: Column | None = None) -> DataFrame:
    """Redacted turns with stable ids; empty ones leave. scopes(path, scope) may place sessions, else global."""
    known = F.current_timestamp() if known_at is None else known_at
    session = F.regexp_replace(F.regexp_replace("path", "^.*/", ""), r"\.jsonl$", "")
    clean = redact(F.col("content"))
    out = messages.filter("role IN ('user', 'assistant')").withColumn("session_id", session).withColumn("content_redacted", clean)
    out = out.filter(F.length(F.trim("content_redacted")) > 0)
    identity = F.concat_ws("‖", "session_id", F.coalesce("record_id", F.col("source_ordinal").cast("string")), F.sha2("content", 256))
    out = out.select(
        F.sha2(identity, 256).alias("turn_id"),
        F.lit(client).alias("client"),
        "session_id",
        F.coalesce(F.try_to_timestamp("said_at"), known).alias("happened_at"),
        known.alias("known_at"),
        "role",
        F.col("content_redacted").alias("content"),
        F.sha2("content", 256).alias("raw_sha256"),
        redaction_count(F.col("content"), F.col("content_redacted")).alias("redaction_count"),
        F.col("path").alias("source_path"),
        "source_ordinal",
    )
    if scopes is None:
        return out.withColumn("scope", F.lit("global"))
    return out.join(scopes.select(F.col("path").alias("source_path"), "scope"), "source_path", "left").withColumn("scope", F.coalesce("scope", F.lit("global")))


#: What a workspace snapshot reads and leaves out.
CODE_SUFFIXES = "py js jsx ts tsx java kt swift go rs cs c cc cpp h hpp sql toml yaml yml".split()
EXCLUDED = ".git .hg .svn .venv venv node_modules __pycache__ external runs".split()


def workspace(spark: SparkSession, root: str, most_bytes: int = 2 << 20) -> DataFrame:
    """path, size, sha256 of the code files below root; binary files leave."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.{" + ",".join(CODE_SUFFIXES) + "}").load(root)
    parts = F.split("path", "/")
    keep = (F.col("length") <= most_bytes) & ~F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED)))
    text = ~F.contains(F.decode("content", "ISO-8859-1"), F.lit("\0"))
    return files.filter(keep).filter(text).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified_at"))


#: Folders whose documents are not the user's own.
SKIPPED = "node_modules venv __pycache__ dist build target site-packages".split()


def documents(spark: SparkSession, root: str, most_bytes: int = 2 << 20, seen: DataFrame | None = None) -> DataFrame:
    """path, modified_at, size, content of text documents; with seen(path, modified_at, size) only new or changed ones.

    Folders below root that are hidden (their name starts with a point) or made by tools are left out.
    """
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.{md,markdown,txt,rst}").load(root)
    start = re.sub("/+", "/", re.sub("^[a-z0-9]+:(//[^/]*)?", "", root.rstrip("/"))) + "/"
    below = F.split(F.substring_index("path", start, -1), "/")
    folders = F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0)))
    files = files.filter(~F.exists(folders, lambda f: f.startswith(".") | f.isin(SKIPPED)))
    files = files.filter(F.col("length") <= most_bytes).select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), "content")
    if seen is not None:
        files = files.join(seen, ["path", "modified_at", "size"], "left_anti")
    return files.withColumn("content", F.decode("content", "UTF-8"))


LOG_BATCH_BYTES = 8 << 20
LOG = "kind string, device string, written_at string, record map<string,string>"


def device_log(spark: SparkSession, path: str, *, stream: bool = False, **options) -> DataFrame:
    """Log lines kind, id, device, written_at, record below a folder; torn lines leave.

    As a stream, at most 8 MiB a batch if the stream's checkpoint is given; a log that a sync client replaced is read again.
    """
    if stream:
        budget = {"max_bytes": LOG_BATCH_BYTES} if "checkpoint" in options else {}
        lines = tail(spark, path, on_bad="replace", **budget | options).select("value")
    else:
        lines = spark.read.format("text").schema("value string").load(path)
    rows = lines.select(F.from_json("value", LOG).alias("x")).select("x.*")
    return rows.filter("kind IS NOT NULL").withColumn("id", F.coalesce(F.col("record")["id"], F.col("record")["turn_id"], F.col("record")["memory_id"]))


def append_log(rows: DataFrame, path: str) -> None:
    rows.select("kind", "device", "written_at", "record").write.mode("append").json(path)


def after_revision(table: DataFrame, last: int) -> DataFrame:
    return table.filter(F.col("revision") > last)


def haystack(spark: SparkSession, path: str) -> DataFrame:
    """One row a turn of question files: three parallel arrays of a question unrolled twice."""
    q = spark.read.option("multiLine", "true").json(path)
    s = q.select("question_id", "question_type", "question", F.posexplode(F.arrays_zip("haystack_dates", "haystack_session_ids", "haystack_sessions")).alias("session_no", "s"))
    return s.select("question_id", "question_type", "question", "session_no", F.col("s.haystack_session_ids").alias("session_id"), F.col("s.haystack_dates").alias("session_date"), F.posexplode("s.haystack_sessions").alias("turn_no", "turn")).select("*", "turn.*").drop("turn")


def judged_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """corpus(doc, title, text), queries(query_id, query), judged(query_id, doc, gain) of a retrieval benchmark folder."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl").withColumnRenamed("_id", "doc")
    queries = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl").toDF("query_id", "query")
    judged = spark.read.option("sep", "\t").option("header", "true").schema("query_id string, doc string, gain double").csv(f"{path}/qrels/test.tsv")
    return corpus, queries, judged
