"""Selection, deduplication and neighbourhood of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_duplicates(turns: DataFrame, keys: list[str], order: str = "revision", protected: DataFrame | None = None) -> DataFrame:
    """The first row of each key; rows whose turn_id is in protected stay as well."""
    ranked = turns.withColumn("_copy", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    if protected is not None:
        ranked = ranked.join(protected.select("turn_id", F.lit(True).alias("_kept")), "turn_id", "left")
        return ranked.filter("_copy = 1 OR _kept").drop("_copy", "_kept")
    return ranked.filter("_copy = 1").drop("_copy")


def collisions(turns: DataFrame) -> DataFrame:
    """Ids that came with more than one content."""
    return turns.groupBy("turn_id").agg(F.countDistinct("raw_sha256").alias("contents")).filter("contents > 1")


def visible(rows: DataFrame, *, scopes: list[str] | None = None, as_of=None, knowledge_cutoff=None) -> DataFrame:
    """Rows of the scopes that were in effect and known by the given times."""
    if scopes:
        rows = rows.filter(F.col("scope").isin(scopes))
    if as_of is not None:
        rows = rows.filter(F.col("effective_at") <= as_of)
    if knowledge_cutoff is not None:
        rows = rows.filter(F.col("known_at") <= knowledge_cutoff)
    return rows


def between(rows: DataFrame, since=None, until=None, *, until_inclusive: bool = True) -> DataFrame:
    """since is inclusive; until is inclusive for word search and latest turns, exclusive for meaning search."""
    if since is not None:
        rows = rows.filter(F.col("happened_at") >= since)
    if until is not None:
        rows = rows.filter(F.col("happened_at") <= until if until_inclusive else F.col("happened_at") < until)
    return rows


def around_window(text: Column, slack_days: int = 7) -> Column:
    """struct<since, until> of a date or "a..b", widened; null where it can't be read."""
    first, last = F.substring_index(text, "..", 1), F.substring_index(text, "..", -1)
    day = lambda t: F.try_to_timestamp(F.trim(t), F.lit("yyyy-MM-dd"))
    since, until = F.date_sub(day(first), slack_days), F.date_add(day(last), slack_days + 1)
    return F.when(since.isNotNull() & until.isNotNull(), F.struct(since.alias("since"), until.alias("until")))


def latest(turns: DataFrame, limit: int, *, per: str | None = None) -> DataFrame:
    """The newest turns, overall or for each value of a column."""
    order = [F.desc("happened_at"), F.desc("revision")]
    if per is None:
        return turns.orderBy(*order).limit(limit)
    return turns.withColumn("place", F.row_number().over(Window.partitionBy(per).orderBy(*order))).filter(F.col("place") <= limit)


def around(turns: DataFrame, cited: DataFrame, before: int = 2, after: int = 4) -> DataFrame:
    """The turns before and after each cited (source_path, source_ordinal), with their offset."""
    order = Window.partitionBy("source_path").orderBy("source_ordinal")
    numbered = turns.withColumn("_n", F.row_number().over(order))
    at = numbered.join(cited.select("source_path", "source_ordinal").distinct(), ["source_path", "source_ordinal"], "left_semi").select("source_path", F.col("_n").alias("_at"), F.col("source_ordinal").alias("cited_ordinal"))
    offsets = at.select("source_path", "cited_ordinal", "_at", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")).withColumn("_n", F.col("_at") + F.col("offset"))
    return offsets.join(numbered, ["source_path", "_n"]).drop("_n", "_at")


def neighbours(turns: DataFrame, column: str) -> DataFrame:
    """Adds the column's values one and two turns before and after in the session."""
    order = Window.partitionBy("session_id").orderBy("source_ordinal")
    return turns.withColumns({f"{column}_{k}{n}": (F.lag if k == "before" else F.lead)(column, n).over(order) for k in ("before", "after") for n in (1, 2)})


def stalls(rows: DataFrame, limit: int = 2000) -> DataFrame:
    """Of rows(source, at, is_turn): sources whose rows since their last turn reach the limit."""
    order = Window.partitionBy("source").orderBy("at", "row_id")
    run = rows.withColumn("_run", F.sum(F.col("is_turn").cast("int")).over(order))
    since = run.groupBy("source", "_run").agg(F.count_if(~F.col("is_turn")).alias("idle"))
    return since.groupBy("source").agg(F.max("idle").alias("longest_idle")).withColumn("stalled", F.col("longest_idle") >= limit)


def searchable(turns: DataFrame, about_assistant: Column) -> DataFrame:
    """Turns that meaning search looks at: the assistant's only where the question is about what it said."""
    return turns.filter(F.coalesce(F.col("role").isin("user", "document"), F.lit(False)) | about_assistant)


def without_echoes(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits(query_id, content) but for those that say what the question(query_id, query) says, white space aside."""
    folded = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    asked = queries.select("query_id", folded(F.col("query")).alias("_said"))
    return hits.join(asked, "query_id").filter(~F.coalesce(folded(F.col("content")) == F.col("_said"), F.lit(False))).drop("_said")


def to_embed(turns: DataFrame, done: DataFrame, batch: int) -> DataFrame:
    """The next batch of turns without a vector: those of users and documents first, newest first."""
    rows = turns.filter(F.col("role").isin("user", "assistant", "document")).join(done.select("turn_id"), "turn_id", "left_anti")
    return rows.orderBy(F.col("role") == "assistant", F.desc("happened_at"), "turn_id").limit(batch)


def asks_total(question: Column) -> Column:
    """Whether the wording asks for a count or a total."""
    # fixed value: the cue
    return question.rlike(r"(?i)\b(how many|how much|total|in all|altogether|combined|sum of)\b")
