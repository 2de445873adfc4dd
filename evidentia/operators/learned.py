"""What earlier questions and replies teach, and what a session's text and events give a reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import STOP_WORDS

#: Words of a counting question that say nothing about what is counted.
COUNTING_WORDS = "how many did the last months month in i my different what were was do does".split()


def learned_terms(text: Column) -> Column:
    """Distinct words of two letters or digits and more, without stop words; null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[\p{L}\p{N}]{2,}"), 0)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(STOP_WORDS)))


def history_features(pool: DataFrame, asked: DataFrame, learned: DataFrame) -> DataFrame:
    """pool(query_id, turn_id, session_id, number) with used_before, session_used, near_used and term_link.

    asked(query_id, question); learned(turn_id, session_id, number, question): a row for each turn
    that an earlier question's answer used. Counts enter as ln(1 + n). All joins are on equal keys:
    terms of a question meet learned terms only at the question's own candidates.
    """
    count = lambda keys, name: learned.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    steps = F.explode(F.transform(F.array(*[F.lit(s) for s in (-2, -1, 1, 2)]), lambda s: F.col("number") + s)).alias("number")
    near = learned.select("session_id", "number").distinct().select("session_id", steps).distinct().withColumn("_near", F.lit(1.0))
    links = learned.select("turn_id", F.explode(learned_terms(F.col("question"))).alias("term")).groupBy("turn_id", "term").agg(F.count(F.lit(1)).alias("_n"))
    terms = asked.select("query_id", F.explode(learned_terms(F.col("question"))).alias("term"))
    linked = pool.select("query_id", "turn_id").distinct().join(terms, "query_id").join(links, ["turn_id", "term"]).groupBy("query_id", "turn_id").agg(F.sum("_n").alias("_link"))
    out = pool.join(count(["turn_id"], "_used"), "turn_id", "left").join(count(["session_id"], "_session"), "session_id", "left")
    out = out.join(near, ["session_id", "number"], "left").join(linked, ["query_id", "turn_id"], "left")
    logged = lambda c: F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double"))
    return out.select(*pool.columns, logged("_used").alias("used_before"), logged("_session").alias("session_used"), F.coalesce("_near", F.lit(0.0)).alias("near_used"), logged("_link").alias("term_link"))


def rarity(corpus: DataFrame) -> DataFrame:
    """owner, term, rare: ln(turns / (1 + turns with the term)) over corpus(owner, text)."""
    words = corpus.select("owner", learned_terms(F.col("text")).alias("w"))
    size = words.groupBy("owner").agg(F.count(F.lit(1)).alias("_n"))
    df = words.select("owner", F.explode("w").alias("term")).groupBy("owner", "term").agg(F.count(F.lit(1)).alias("_df"))
    return df.join(size, "owner").select("owner", "term", F.log(F.col("_n") / (1 + F.col("_df"))).alias("rare"))


def used_by_reply(replies: DataFrame, shown: DataFrame, corpus: DataFrame, least: float = 4.0) -> DataFrame:
    """query_id, turn_id, weight: the shown turn that the reply drew on most, if its weight reaches least.

    replies(query_id, owner, question, reply), shown(query_id, turn_id, place, text). A turn weighs the
    rarity of the words it shares with the reply beyond the question's own; of equal ones the first shown.
    """
    said = F.array_except(learned_terms(F.col("reply")), learned_terms(F.col("question")))
    said = replies.select("query_id", "owner", F.explode(said).alias("term"))
    words = shown.select("query_id", "turn_id", "place", F.explode(learned_terms(F.col("text"))).alias("term"))
    weighed = said.join(words, ["query_id", "term"]).join(rarity(corpus), ["owner", "term"])
    weighed = weighed.groupBy("query_id", "turn_id", "place").agg(F.round(F.sum("rare"), 6).alias("weight"))
    best = weighed.groupBy("query_id").agg(F.min_by(F.struct("turn_id", "weight"), F.struct(-F.col("weight"), F.col("place"))).alias("b"))
    return best.select("query_id", "b.*").filter(F.col("weight") >= least)


def distractors(sessions: DataFrame, most: int, *, span: int = 10_000) -> DataFrame:
    """session_id, place, size, before: distinct sessions in order of place, until their sizes add up to most.

    sessions(session_id, place, size); a repeated session counts once, at its first place (of equal
    places the smallest size). Sums run in two steps, over spans of places and within a span, so no
    task orders all sessions.
    """
    first = F.min(F.struct("place", "size")).alias("f")
    once = sessions.groupBy("session_id").agg(first).select("session_id", "f.*").withColumn("_span", F.floor(F.col("place") / span))
    spans = once.groupBy("_span").agg(F.sum("size").alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("_span", start.alias("_start")).filter(F.col("_start") < most)
    inside = Window.partitionBy("_span").orderBy("place", "session_id").rowsBetween(Window.unboundedPreceding, -1)
    out = once.join(spans, "_span").withColumn("before", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return out.filter(F.col("before") < most).select("session_id", "place", "size", "before")


def last_said(turns: DataFrame, moments: DataFrame) -> DataFrame:
    """moments(session_id, at, ...) with last_at, the latest user turn of the session not after at (null without one).

    Both sides are put into one sequence a session and the last user turn is carried on.
    """
    rows = turns.filter("role = 'user'").select("session_id", F.col("happened_at").alias("_t"), F.lit(0).alias("_asks"), F.lit(None).cast(moments.select(F.struct("*")).schema[0].dataType).alias("_m"))
    asked = moments.select("session_id", F.col("at").alias("_t"), F.lit(1).alias("_asks"), F.struct(*moments.columns).alias("_m"))
    w = Window.partitionBy("session_id").orderBy("_t", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(asked).withColumn("last_at", F.last(F.when(F.col("_asks") == 0, F.col("_t")), ignorenulls=True).over(w))
    return both.filter("_asks = 1").select("_m.*", "last_at")


def serialised(turns: DataFrame) -> DataFrame:
    """session_id, content: a session's turns(session_id, source_ordinal, role, content) as one text, a labelled block a turn."""
    n = F.col("source_ordinal")
    block = F.concat(F.lit("TURN_"), n.cast("string"), F.lit(" ["), F.col("role"), F.lit("]: "), F.coalesce("content", F.lit("")))
    grouped = turns.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(n.alias("n"), block.alias("b")))).alias("bs"))
    return grouped.select("session_id", F.array_join("bs.b", "\n").alias("content"))


def turn_texts(sessions: DataFrame, role: str | None = None) -> DataFrame:
    """session_id, turn_id, role, text of the labelled blocks in sessions(session_id, content); role keeps one side."""
    label = r"TURN_\d+ \[(?:user|assistant)\]: "
    blocks = F.regexp_extract_all("content", F.lit(rf"(?smid)^{label}.*?(?=^{label}|\z)"), 0)
    rows = sessions.select("session_id", F.explode(blocks).alias("b"))
    got = lambda group: F.regexp_extract("b", r"(?si)\A(TURN_\d+) \[(user|assistant)\]: (.*)\z", group)
    out = rows.select("session_id", got(1).alias("turn_id"), F.lower(got(2)).alias("role"), F.regexp_replace(got(3), r"(?U)\A\s+|\s+\z", "").alias("text"))
    return out if role is None else out.filter(F.col("role") == role)


def dated_timeline(events: DataFrame) -> DataFrame:
    """query_id, place, date, fact: a question's dated events(query_id, event_id, date_value, session_date, object_text, relation_detail), oldest first."""
    given = lambda *cs: F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in cs])
    rows = events.select("query_id", "event_id", given("date_value", "session_date").alias("date"), F.substring(F.coalesce(given("object_text", "relation_detail"), F.lit("")), 1, 120).alias("fact"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("date", "event_id"))
    return rows.filter("date IS NOT NULL").select("query_id", place.alias("place"), "date", "fact")


def stored_totals(asked: DataFrame, events: DataFrame, top: int = 5) -> DataFrame:
    """query_id, place, session_date, value, sole: stored numbers that may answer counting questions, oldest first.

    An event of the question with a number scores the question's words that its text contains; the
    best top ones (of equal scores the earlier events) are listed, sole where it is the only one.
    """
    words = F.array_distinct(F.transform(F.regexp_extract_all("question", F.lit("[A-Za-z0-9]+"), 0), F.lower))
    words = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(COUNTING_WORDS))
    text = F.lower(F.concat_ws(" ", F.coalesce("object_text", F.lit("")), F.coalesce("relation_detail", F.lit(""))))
    met = events.filter("numeric_value IS NOT NULL").join(asked.select("query_id", words.alias("_w")), "query_id").withColumn("_text", text)
    met = met.withColumn("score", F.size(F.filter("_w", lambda w: F.contains(F.col("_text"), w)))).filter("score > 0")
    own = Window.partitionBy("query_id")
    met = met.withColumn("_best", F.row_number().over(own.orderBy(F.desc("score"), "event_id"))).filter(F.col("_best") <= top)
    place = F.row_number().over(own.orderBy(F.coalesce("session_date", F.lit("")), "_best"))
    return met.select("query_id", place.alias("place"), "session_date", F.col("numeric_value").alias("value"), (F.count(F.lit(1)).over(own) == 1).alias("sole"))


def located(projects: DataFrame, ledgers: DataFrame, rows: DataFrame) -> DataFrame:
    """project, status, copies: where a project is found among ledgers(ledger, reachable) holding rows(ledger, project).

    Not found is "absent" only if every ledger could be reached, else "unknown".
    """
    seen = rows.join(ledgers.filter("reachable").select("ledger"), "ledger", "left_semi").select("project", "ledger").distinct()
    copies = seen.groupBy("project").agg(F.count(F.lit(1)).alias("copies"))
    silent = ledgers.agg(F.coalesce(F.bool_or(~F.col("reachable")), F.lit(False)).alias("_silent"))
    out = projects.join(copies, "project", "left").join(F.broadcast(silent))  # one row
    status = F.when(F.col("copies") > 0, "found").when(F.col("_silent"), "unknown").otherwise("absent")
    return out.select("project", status.alias("status"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))


def chosen_ledgers(projects: DataFrame, ledgers: DataFrame, rows: DataFrame) -> DataFrame:
    """project, status, ledger: of the reachable ledgers(ledger, rank, reachable) that hold a project, the first by rank.

    rows(ledger, project, ...). Not found is "absent" only if every ledger could be reached, else "unknown".
    """
    held = rows.select("ledger", "project").distinct().join(ledgers.filter("reachable").select("ledger", "rank"), "ledger")
    first = held.groupBy("project").agg(F.min_by("ledger", F.struct("rank", "ledger")).alias("ledger"))
    silent = ledgers.agg(F.coalesce(F.bool_or(~F.col("reachable")), F.lit(False)).alias("_silent"))
    out = projects.join(first, "project", "left").join(F.broadcast(silent))  # one row
    status = F.when(F.col("ledger").isNotNull(), "found").when(F.col("_silent"), "unknown").otherwise("absent")
    return out.select("project", status.alias("status"), "ledger")


def fan_in(ledgers: DataFrame, rows: DataFrame) -> DataFrame:
    """rows(ledger, row_id, ...) of all reachable ledgers, each row_id once: as the first ledger by rank has it, and how many copies there are."""
    order = Window.partitionBy("row_id").orderBy("rank", "ledger")
    held = rows.join(ledgers.filter("reachable").select("ledger", "rank"), "ledger")
    held = held.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("row_id"))).withColumn("_n", F.row_number().over(order))
    return held.filter("_n = 1").drop("_n", "rank")
