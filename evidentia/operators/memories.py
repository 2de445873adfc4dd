"""Curated memories: two clocks, supersession, keyed facts, lexical recall, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.turns import visible


def current(memories: DataFrame, **view) -> DataFrame:
    """Visible memories that no visible memory supersedes: filtered first, then superseded ids leave."""
    seen = visible(memories, **view)
    return seen.join(seen.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("memory_id")), "memory_id", "left_anti")


def superseded_flags(memories: DataFrame, **view) -> DataFrame:
    seen = visible(memories, **view)
    by = seen.filter("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("memory_id")).agg(F.min(F.col("memory_id")).alias("superseded_by"))
    return seen.join(by, "memory_id", "left").withColumn("superseded", F.col("superseded_by").isNotNull())


def current_facts(memories: DataFrame, earlier: int = 5) -> DataFrame:
    """The latest value of each (scope, fact) and up to `earlier` values before it, newest first."""
    order = Window.partitionBy("scope", "fact").orderBy(F.desc("effective_at"), F.desc("known_at"), F.desc("memory_id"))
    ranked = memories.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= earlier + 1)
    item = F.struct("_n", "content")
    before = F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") > 1, item))), lambda x: x["content"])
    return ranked.groupBy("scope", "fact").agg(F.max(F.when(F.col("_n") == 1, F.col("memory_id"))).alias("memory_id"), F.max(F.when(F.col("_n") == 1, F.col("content"))).alias("content"), before.alias("earlier"))


def recall_scores(memories: DataFrame, query_text: str) -> DataFrame:
    """Score of memories(title, identity array, body) for a normalised question, by substring.

    An identity item inside the question counts 100; a question word inside the body counts 12, else
    20 if it is part of an identity item or the other way round; a word scores once.
    """
    words = list(dict.fromkeys(w for w in query_text.split() if len(w) >= 2))
    asked = F.lit(query_text)
    named = F.filter("identity", lambda i: (F.length(i) > 0) & asked.contains(i))
    word_score = lambda w: F.when(F.col("body").contains(w), 12).when(F.exists("identity", lambda i: (F.length(i) > 0) & (i.contains(w) | w.contains(i))), 20).otherwise(0)
    score = F.size(named) * 100
    for w in words:
        score = score + word_score(F.lit(w))
    return memories.withColumn("named", F.size(named)).withColumn("score", score.cast("long"))


def recent(scored: DataFrame, limit: int) -> DataFrame:
    """The newest memories, of the named ones if there are any."""
    newest = [F.desc("effective_at"), F.desc("memory_id")]
    first = lambda rows, named: rows.orderBy(*newest).limit(limit).withColumn("_named", F.lit(named))
    both = first(scored.filter("named > 0"), True).unionByName(first(scored, False))  # at most twice the limit
    pool = both.withColumn("_any", F.max("_named").over(Window.partitionBy())).filter("_named = _any").drop("_any", "_named")
    return pool.orderBy(*newest).limit(limit)


def meaning_fallback(scored: DataFrame, floor: float = 0.2, margin: float = 0.1) -> DataFrame:
    """Of rows(query_id, score, similarity): for questions without a word match, rows near the best similarity."""
    per = Window.partitionBy("query_id")
    rows = scored.withColumn("_words", F.max("score").over(per)).filter("_words = 0").filter(F.col("similarity") >= floor)
    return rows.withColumn("_best", F.max("similarity").over(per)).filter(F.col("similarity") >= F.col("_best") - margin).drop("_words", "_best")


#: The first token found in a kind names its class; likewise for sources and modalities.
CLASSES = {"PREFERENCE": "PREFERENCE", "DECISION": "DECISION", "TASK": "TASK", "ACTION": "TASK", "FILE": "ARTIFACT", "DOCUMENT": "ARTIFACT", "CODE": "ARTIFACT", "RELATION": "RELATION", "STATE": "STATE", "SUMMARY": "SUMMARY", "FACT": "FACT", "PROJECT": "STATE"}
MODALITIES = {"conversation": "CONVERSATION", "codex": "CONVERSATION", "document": "DOCUMENT", "code": "CODE", "git": "CODE", "file": "FILE", "web": "WEB", "browser": "WEB", "manual": "MANUAL", "mcp": "MANUAL", "system": "SYSTEM"}
DURABLE = ["FACT", "PREFERENCE", "DECISION", "STATE", "SUMMARY"]


def _first(text: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for token, value in reversed(table.items()):
        out = F.when(text.contains(token), F.lit(value)).otherwise(out)
    return out


def default_profile(memory_type: Column, source_type: Column) -> Column:
    kind = _first(F.upper(F.coalesce(memory_type, F.lit(""))), CLASSES, "EPISODE")
    durable = kind.isin(DURABLE)
    return F.struct(
        kind.alias("memory_class"),
        _first(F.lower(F.coalesce(source_type, F.lit(""))), MODALITIES, "OTHER").alias("modality"),
        F.when(durable, "DURABLE").otherwise("EPISODIC").alias("retention"),
        F.when(durable, 0.7).otherwise(0.5).alias("importance"),
        F.lit(1.0).alias("confidence"),
    )


def validate(memories: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Adds errors: the rules that a memory to be stored breaks."""
    say = lambda test, name: F.when(test, F.lit(name))
    errors = [
        say(F.coalesce(F.length(F.trim("title")), F.lit(0)) == 0, "TITLE_REQUIRED"),
        say(F.coalesce(F.length(F.trim("content")), F.lit(0)) == 0, "CONTENT_REQUIRED"),
        say(F.col("effective_at") > F.col("known_at"), "KNOWN_BEFORE_EFFECTIVE"),
    ]
    for name in ("importance", "confidence"):
        if name in memories.columns:
            errors.append(say(~F.col(name).between(0, 1), f"INVALID_{name.upper()}"))
    if known is not None:
        target = known.select(F.col("memory_id").alias("supersedes"), F.col("scope").alias("_scope"), F.lit(True).alias("_there"))
        memories = memories.join(target, "supersedes", "left")
        errors.append(say(F.col("supersedes").isNotNull() & F.col("_there").isNull(), "SUPERSEDES_UNKNOWN"))
        errors.append(say(F.col("_scope") != F.col("scope"), "SUPERSEDES_OTHER_SCOPE"))
    out = memories.withColumn("errors", F.array_compact(F.array(*errors)))
    return out.drop("_scope", "_there")


def with_profiles(memories: DataFrame, profiles: DataFrame) -> DataFrame:
    """Memories with the stored profile(memory_id, memory_class, modality, retention, importance, confidence), or the default of their kind and source."""
    names = ["memory_class", "modality", "retention", "importance", "confidence"]
    stored = profiles.select("memory_id", F.struct(*names).alias("_stored"))
    out = memories.join(stored, "memory_id", "left").withColumn("_default", default_profile(F.col("memory_type"), F.col("source_type")))
    return out.withColumns({n: F.coalesce(F.col("_stored")[n], F.col("_default")[n]) for n in names}).drop("_stored", "_default")
