"""Evidence passages of a question: the source turns that its most relevant events cite, and a few similar windows.

A question has a main view (itself) and up to three views of named entities that it doesn't say. Its own events are ranked
for each view; the events of the main view come first, then those that other views add, and the turns that these cite
follow in that order, each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import pieces
from evidentia.operators.vectors import cosine

#: Views; events of the main and of another view; windows; characters of a turn and of a window, and its step.
VIEWS, TOP, PER_VIEW, WINDOWS, TURN_CHARS, SIZE, STEP = 4, 20, 5, 3, 500, 600, 300


def views(questions: DataFrame) -> DataFrame:
    """query_id, view_no, view: the question's text, then its entities(array) with underscores read as spaces, but for those it says."""
    texts = F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.trim(F.replace(e, F.lit("_"), F.lit(" "))))
    new = F.filter(texts, lambda e: (F.length(e) > 0) & ~F.contains(F.lower("question"), F.lower(e)))
    return questions.select("query_id", F.posexplode(F.slice(F.concat(F.array("question"), new), 1, VIEWS)).alias("view_no", "view"))


def event_text(relation: Column, detail: Column, value: Column) -> Column:
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.trim(F.concat(empty(relation), F.lit(" "), empty(detail), F.lit(" "), empty(value)))


def ranked_events(seen: DataFrame, events: DataFrame) -> DataFrame:
    """query_id, view_no, event_id, rank from 0: a question's own events by cosine to each of its views.

    seen(query_id, view_no, embedding), events(query_id, event_id, embedding); of equal cosines the earlier event.
    """
    met = seen.join(events.withColumnRenamed("embedding", "_e"), "query_id").withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("_e")), 9))
    order = Window.partitionBy("query_id", "view_no").orderBy(F.desc("similarity"), "event_id")
    return met.withColumn("rank", F.row_number().over(order) - 1).select("query_id", "view_no", "event_id", "rank")


def chosen_events(ranked: DataFrame, top: int = TOP, per_view: int = PER_VIEW) -> DataFrame:
    """query_id, event_id, place: the main view's top events, then each other view's that are not there yet."""
    kept = ranked.filter(F.col("rank") < F.when(F.col("view_no") == 0, top).otherwise(per_view))
    first = kept.groupBy("query_id", "event_id").agg(F.min(F.struct("view_no", "rank")).alias("first"))
    return first.select("query_id", "event_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "event_id")).alias("place"))


def cited_turns(chosen: DataFrame, events: DataFrame, turns: DataFrame, cap: int = TURN_CHARS) -> DataFrame:
    """query_id, place, session_id, turn_id, text: turns that chosen events cite, each at its first citation; unknown or empty ones leave.

    events(query_id, event_id, session_id, source_turn_ids), turns(session_id, turn_id, text).
    """
    cited = chosen.join(events.select("query_id", "event_id", "session_id", "source_turn_ids"), ["query_id", "event_id"])
    cited = cited.select("query_id", "place", "session_id", F.posexplode("source_turn_ids").alias("_at", "turn_id"))
    first = cited.groupBy("query_id", "session_id", "turn_id").agg(F.min(F.struct("place", "_at")).alias("_first"))
    said = first.join(turns.select("session_id", "turn_id", F.trim("text").alias("text")).filter("text <> ''"), ["session_id", "turn_id"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_first"))
    return said.select("query_id", place.alias("place"), "session_id", "turn_id", F.substring("text", 1, cap).alias("text"))


def windows(sessions: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """query_id, session_id, start, text: overlapping stretches of sessions(query_id, session_id, content); the last begins before the last full one ends."""
    cut = sessions.select("query_id", "session_id", F.greatest(F.lit(1), F.length("content") - size + step).alias("_end"), F.explode(pieces(F.col("content"), size, step)).alias("p"))
    return cut.filter(F.col("p.start") < F.col("_end")).select("query_id", "session_id", F.col("p.start").alias("start"), F.col("p.piece").alias("text"))


def similar_windows(asked: DataFrame, cut: DataFrame, most: int = WINDOWS) -> DataFrame:
    """The windows(…, embedding) nearest to the question(query_id, embedding), with place."""
    met = cut.join(asked.select("query_id", F.col("embedding").alias("_q")), "query_id").withColumn("similarity", F.round(cosine(F.col("embedding"), F.col("_q")), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "session_id", "start")
    return met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("query_id", "place", "session_id", "start", "text")


def evidence_passages(questions: DataFrame, sessions: DataFrame, events: DataFrame, turns: DataFrame, embed) -> DataFrame:
    """query_id, place, session_id, session_date, turn_id (null for a window), text: passages by the session's date, turns before windows.

    questions(query_id, question, entities), sessions(query_id, session_id, session_date, content), events(query_id,
    event_id, session_id, source_turn_ids, text), turns(session_id, turn_id, text).
    """
    seen = views(questions).withColumn("embedding", embed("view"))
    told = events.withColumn("embedding", embed("text"))
    anchored = cited_turns(chosen_events(ranked_events(seen, told)), events, turns).withColumn("kind", F.lit(0))
    near = similar_windows(seen.filter("view_no = 0"), windows(sessions).withColumn("embedding", embed("text"))).withColumn("kind", F.lit(1)).withColumn("turn_id", F.lit(None).cast(turns.schema["turn_id"].dataType))
    columns = ["query_id", "kind", "place", "session_id", "turn_id", "text"]
    both = anchored.select(*columns).unionByName(near.select(*columns)).join(sessions.select("query_id", "session_id", "session_date"), ["query_id", "session_id"])
    order = Window.partitionBy("query_id").orderBy("session_date", "kind", "place")
    return both.select("query_id", F.row_number().over(order).alias("place"), "session_id", "session_date", "turn_id", "text")
